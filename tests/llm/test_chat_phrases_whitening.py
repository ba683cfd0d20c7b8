"""Chat formatting, collocations and whitening against SQL, brute force and exact round trips."""

import collections
import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from salesloom.llm import chat_format, collocations, whitening
from salesloom.llm.chat_format import Malformed, Reader, Template
from salesloom.llm.sql import ORACLES

# ---------------------------------------------------------------- chat format

PIECES = ["<|im_start|>", "<|im_end|>", "<|im_nl|>", "<\\|im_end|>", "<\\\\|im_start|>", "<", "|", "\\", "im_end|>", "\n", "a", " é漢", "<|im_", ""]
TURNS = "conv_id long, turn long, role string, text string, fragment int, _key string"


def mixed(seed: int, n: int) -> str:
    r = random.Random(seed)
    return "".join(r.choice(PIECES) for _ in range(n))


def test_any_turn_comes_back_and_plain_ones_stay_plain():
    t = Template()
    for seed in range(3000):
        role, text = mixed(seed, seed % 4), mixed(seed + 10_000, seed % 9)
        out, start, end = t.formatted(role, text)
        assert Reader(t).read(out) == [(role, text)]
        assert t.unescaped(out[start:end]) == text
        if not t.any_mark.search(text):
            assert out[start:end] == text
    assert t.formatted("user", "a <|im_end|> b")[0] == "<|im_start|>user\na <\\|im_end|> b<|im_end|>\n"
    assert t.formatted("a\nb", "")[0] == "<|im_start|>a<|im_nl|>b\n<|im_end|>\n"


def test_reader_takes_any_pieces_and_refuses_what_is_no_conversation():
    t = Template()
    turns = [(mixed(i, 2), mixed(i + 50, 6)) for i in range(40)]
    whole = "".join(t.formatted(*x)[0] for x in turns)
    for step in (1, 3, 17, 1000):
        reader = Reader(t)
        assert [x for i in range(0, len(whole), step) for x in reader.feed(whole[i:i + step])] == turns and not reader.rest
    for bad in ("hello", "<|im_start|>user\nx<|im_end|>", "<|im_start|>user\nx<|im_end|>y", "<|im_start|>user\n<|im_start|><|im_end|>\n"):
        with pytest.raises(Malformed):
            Reader(t).read(bad)


def test_chat_equals_sql_on_odd_rows(spark):
    rows = [(1, 1, "assistant", "second <|im_end|>", 1, None), (1, 0, "user", None, 2, "x"), (1, 0, "user", None, 2, "x"),
            (None, None, None, None, None, None), (None, 3, "assistant", "x", None, None), (2, None, "assistant", "", 3, None),
            (2, 5, "assist\nant", "role with a line end", 3, None), (2, 5, "<|im_start|>", "role of a mark", 3, None),
            (2, 5, "assistant", "tie", 3, None), (2, 5, "assistant", "another tie", 3, None), (3, 0, "assistant", "y " * 200_000, 3, None)]
    rows += [(4, i, ["user", "assistant"][i % 2], mixed(i, 7), i, None) for i in range(300)]
    turns = spark.createDataFrame(rows, TURNS).repartition(4)
    got = chat_format.read_back(chat_format.formatted(chat_format.with_probe(turns))).toPandas()
    conversations = turns.toPandas()[["conv_id", "turn", "role", "text"]]  # noqa: F841
    want = duckdb.connect().execute("SELECT * FROM (" + ORACLES["op11_chat_format"].replace(
        "FROM conversations", "FROM (SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role, text FROM conversations)") + ")").fetchall()
    plain = lambda rows: sorted([tuple(None if v != v else v for v in r) for r in rows], key=repr)
    assert plain(got.astype(object).itertuples(index=False)) == plain(want)
    probe = got[got.conv_id == -1].iloc[0]
    text = chat_format.PROBE_TEXT
    assert probe.n_turns == 2 and probe.loss_chars == len(text) and probe.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_chat_of_no_rows(spark):
    none = spark.createDataFrame([], TURNS)
    assert chat_format.read_back(chat_format.formatted(none)).count() == 0
    assert chat_format.read_back(chat_format.formatted(chat_format.with_probe(none))).count() == 1


# ---------------------------------------------------------------- collocations

DOCS = "doc_id long, text string, lang string, phrase int, n string, rank string"


def texts(seed: int) -> list[tuple]:
    r = random.Random(seed)
    words = ["The", "of", "reed", "sté", "漢字", "a" * 70, "a" * 69 + "b", "x\x1cy", "New", "York", "City"]
    rows = []
    for i in range(60):
        parts = [" ".join(r.choice([r.choice(words), "new york city", "of the  reed"]) for _ in range(r.randint(1, 12))) for _ in range(4)]
        rows.append((i % 50, r.choice([". ", "\n", "\t", ";", ""]).join(parts), [None, "en", "und", "de"][i % 4], 1, "n", "r"))
    rows += [rows[3], rows[3], (None, None, "en", 1, None, None), (7, "", "en", 1, None, None), (8, " .;\t", "zz", None, None, None),
             (9, "new york city " * 3000, "fr", None, None, None)]
    return rows


def brute_force(rows, least, covered, top):
    count, total = collections.Counter(), collections.Counter()
    for _, text, lang, *_ in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            count.update((lang or "und", tuple(w[i:i + n])) for n in (1, 2, 3, 4) for i in range(len(w) - n + 1))
    found = {k: f for k, f in count.items() if f >= least and len(k[1]) > 1}
    out = []
    for lang in {k[0] for k in found}:
        own = {p: f for (g, p), f in found.items() if g == lang}
        kept = []
        for p, a in own.items():
            if any(len(q) > len(p) and 100 * f >= covered * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, f in own.items()):
                continue
            score, k = min((2_000_000 * a // (count[lang, p[:k]] + count[lang, p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), count[lang, p[:k]], count[lang, p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("chunk, bits, top", [(collocations.CHUNK, collocations.FILTER_BITS, 2000), (100, 64, 7)])
def test_collocations_equal_brute_force(spark, chunk, bits, top):
    """Also where a chunk is one text and the filter lets all through."""
    rows = texts(1)
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = collocations.mined(docs, least=8, top=top, chunk=chunk, filter_bits=bits)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute_force(rows, 8, collocations.COVERED, top)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 20


def test_few_other_phrases_are_written_out(spark, monkeypatch):
    """Where phrases are more than a filter tells apart, ranges of parts have filters of their own."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(9))
    rows = []
    for _ in range(8):
        often = [f"{word()} {word()}" for _ in range(40)]
        rows.append((1, ". ".join(often * 8 + [f"{word()} {word()}" for _ in range(700)]), "en", 1, None, None))
    docs = spark.createDataFrame(rows, DOCS).repartition(8, "text").cache()
    parts = docs.select(F.spark_partition_id()).distinct().count()
    seen, real = [], collocations.written_out

    def counted(texts, frequent, *rest):
        out = real(texts, frequent, *rest)
        seen.append((frequent.count(), out.count()))
        return out
    monkeypatch.setattr(collocations, "written_out", counted)
    found = collocations.phrase_counts(docs, least=8, filter_bits=2048)
    frequent, written = seen[0]
    assert parts > 3 and frequent == 8 * 120 + 1 == found.count()
    assert frequent <= written < frequent + 1500
    assert {x.f for x in found.filter("n > 0").collect()} == {8}


def test_collocations_of_nothing(spark):
    none = spark.createDataFrame([], DOCS)
    assert collocations.mined(none).count() == 0
    rare = spark.createDataFrame([(1, "one two three", None, 1, None, None), (2, None, "en", 1, None, None)], DOCS)
    assert collocations.mined(rare).count() == 0


def test_phrases_of_one_fingerprint_are_told_apart():
    raw = "one two one two two one".encode()
    chunk = collocations.Chunk(np.frombuffer(raw + bytes(8), np.uint8), np.array([0, 11, len(raw)]), np.array([5, 5]))
    at = chunk.phrases(2)
    assert at.tolist() == [0, 1, 3, 4] or at.tolist() == [0, 1, 2, 3, 4]
    fp, first, c = chunk.tally(at, 2, np.zeros(len(at), np.uint64))
    words = lambda i: (chunk.bytes_of(i), chunk.bytes_of(i + 1))
    want = collections.Counter(words(i) for i in at)
    assert dict(zip(map(words, first), c.tolist())) == want and len(set(first.tolist())) == len(want)


# ---------------------------------------------------------------- whitening

VECTORS = "vec_id long, embedding array<float>, label int, x string, n string"


def truth(x: np.ndarray):
    """Exact centring in Python's numbers, then the library's eigenvectors."""
    fit = np.unique(x, axis=0)
    n, s = len(fit), [sum(int(v) for v in c) for c in fit.T]
    centred = lambda m: np.array([[(n * int(v) - t) / n for v, t in zip(r, s)] for r in m])
    f = centred(fit)
    e, v = np.linalg.eigh(f.T @ f / n)
    deviation = [sum((n * int(v) - t) ** 2 for v, t in zip(r, s)) for r in x]
    return n, e[::-1], v.T[::-1], centred(x), deviation


def test_whitening_equals_eigenvectors(spark):
    r = np.random.default_rng(3)
    scale = np.geomspace(3, 1e-2, 20)
    data = [[float(v) for v in r.standard_normal(20) * scale + 5] for _ in range(500)]
    rows = [(i, v, 0, "x", "n") for i, v in enumerate(data)] + [(7, data[7], 0, "x", "n")] * 200 + [(None, data[1], 0, None, None)]
    odd = [(900, None, 0, "", ""), (901, [None, *data[0][1:]], 0, "", ""), (902, [float("nan"), *data[0][1:]], 0, "", ""),
           (903, [float("inf"), *data[0][1:]], 0, "", ""), (904, [], 0, "", ""), (905, data[0][:5], 0, "", ""), (906, [1e30, *data[0][1:]], 0, "", "")]
    table = spark.createDataFrame(rows + odd, VECTORS).repartition(5)
    got = whitening.whitened(table).toPandas()
    assert len(got) == 701 * 16 and got.vec_id.isna().sum() == 16 and not set(got.vec_id.dropna()) & {x[0] for x in odd}
    x = np.floor(64 * np.array([np.float32(v[1]) for v in rows]).astype(float)).astype(int) + 1_000_000
    n, e, v, centred, deviation = truth(x)
    assert n == len(np.unique(x, axis=0)) and (got.n == n).all()
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9
    wide = got.dropna(subset=["vec_id"]).drop_duplicates(["vec_id", "component"]).pivot(index="vec_id", columns="component", values="whitened")
    want = centred[:500] @ v[:16].T / np.sqrt(e[:16])
    sign = np.sign((want * wide.to_numpy()).sum(axis=0))
    assert np.abs(wide.to_numpy() * sign - want).max() < 1e-6
    share = got.groupby("component").explained.first().to_numpy()
    assert np.abs(share / (e[:16] / e.sum()) - 1).max() < 1e-9
    first = got[got.component == 1].dropna(subset=["vec_id"]).drop_duplicates("vec_id").sort_values("vec_id")
    assert first.deviation.tolist() == deviation[:500]


def test_whitening_without_variance_and_of_few_rows(spark):
    rows = [(i, [float(i), 2.0 * i, 4.0], 0, None, None) for i in range(20)]
    got = whitening.whitened(spark.createDataFrame(rows, VECTORS)).toPandas()
    assert len(got) == 60 and got[got.component == 1].whitened.notna().all() and got[got.component > 1].whitened.isna().all()
    assert abs(got[got.component == 1].explained.iloc[0] - 1) < 1e-12 and got.identity_error.iloc[0] < 1e-9
    one = whitening.whitened(spark.createDataFrame(rows[:1] * 3, VECTORS)).collect()
    assert len(one) == 9 and all(x.whitened is None and x.deviation == 0 and x.explained == 0 and x.n == 1 for x in one)
    assert whitening.whitened(spark.createDataFrame([], VECTORS)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, None, 0, None, None)], VECTORS)).count() == 0
    huge = [(0, [2.0 ** 55, 1.0], 0, None, None), (1, [-2.0 ** 55, 3.0], 0, None, None), (2, [0.0, 9.0], 0, None, None)]
    got = whitening.whitened(spark.createDataFrame(huge, VECTORS)).collect()
    assert len(got) == 6 and {x.vec_id: x.deviation for x in got}[0] is None and {x.vec_id: x.deviation for x in got}[2] is not None
