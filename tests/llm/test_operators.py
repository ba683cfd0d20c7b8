"""Every numbered operator against brute force or a library, on odd rows: nulls, empty and long texts, ties, repeats."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from salesloom.llm import (bpe, exact_dedup, html_extract, jaccard_join, language_id, line_dedup, packing, quality_rules,
                           sharding, toxicity)
from salesloom.llm.linking import components
from salesloom.llm.queries import BYTE_BPE, WORD_BPE
from salesloom.llm.sql import ORACLES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size string, words int, _own int"
WORDS = "the of and anther reed stion blen thing hean orly wher inges atom ther eness ould ring sted".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", str(r.randint(0, 99)), ","]) for _ in range(n))


def near(text: str) -> str:
    found = text.split(" ")
    found[len(found) // 2] = "changed"
    return " ".join(found)


TEXTS = [prose(1, 120), near(prose(1, 120)), prose(1, 120), None, "", " \t\n", "one two", "one  two", "One two", prose(2, 60),
         prose(2, 60) + "\n" + prose(3, 40), prose(4, 30) + "\n" + prose(3, 40), prose(5, 9000), "ünïcödé ’quotes’ 漢字 \x1c x" * 9,
         "<|endoftext|> a<|endoftext|>", "x" * 5000, "a b c", prose(6, 300), near(near(prose(6, 300))),
         "THE END!! " * 40, "idiot scum " + prose(7, 50), "clown idiot " + prose(8, 50), prose(9, 50), "12 34 !?"]
ROWS = [(i, t, [None, "en", "xx"][i % 3], None, None, None, "s", i, 1) for i, t in enumerate(TEXTS)]
ROWS += [ROWS[0], ROWS[9], (None, prose(10, 40), "en", None, 1, True, None, None, None), (None, None, None, None, None, None, None, None, None)]
ROWS += [(100 + i, prose(50 + i, 40), ["en", "fr"][i % 2], None, 1, True, None, 0, 0) for i in range(30)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def ids(rows):
    return sorted(rows, key=repr)


def test_bpe_equals_library(docs, none):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(WORD_BPE)
    want = [(r[0], library.encode(r[1] or "", add_special_tokens=False).ids) for r in ROWS]
    got = [(r.doc_id, list(r.ids)) for r in bpe.encoded(docs, WORD_BPE).collect()]
    assert ids(got) == ids(want)
    texts = {r.doc_id: r.decoded for r in bpe.encoded(docs, WORD_BPE).collect()}
    assert all(texts[d] == library.decode(x, skip_special_tokens=False) for d, x in want if d is not None)
    digest = {r.doc_id: r for r in bpe.digests(docs, WORD_BPE).collect()}
    for d, x in want:
        if d is not None:
            assert digest[d].n_tokens == len(x)
            assert digest[d].ids_sha256 == hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest()
    assert bpe.digests(none, WORD_BPE).count() == 0


def test_bpe_fuzz_and_both_mergers():
    from tokenizers import Tokenizer
    library, own, r = Tokenizer.from_file(WORD_BPE), bpe.WordBpe(WORD_BPE), random.Random(5)
    letters = "abAB \t\n'stdlre <|>endofx12éÉßΣςſİ́ \x1c\x85中²½ ​"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(1500)] + ["ab" * 3000, "thinging" * 99]
    assert list(own.encode_batch(texts)) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for word in ("thinganding", "aaaaaaa", "ab" * 40):
        tokens = [own.vocab[c] for c in word[:-1]] + [own.vocab[word[-1] + "</w>"]]
        assert own.merged_short(list(tokens)) == own.merged_long(list(tokens))


def test_bpe_words_are_proposed_and_merged_side_by_side(monkeypatch):
    """A batch takes as many steps as its longest word has merges, not one call for each word that fails."""
    from tokenizers import Tokenizer
    library, own, r = Tokenizer.from_file(WORD_BPE), bpe.WordBpe(WORD_BPE), random.Random(6)
    words = ["".join(r.choice("thingandreblsoßé") for _ in range(r.randint(1, 30))) for _ in range(3000)] + ["ab" * 70, "</w>a", "\x00"]
    plain = [w.encode("utf-8").decode("latin-1").translate(own.bytes) for w in words]
    want = [library.encode(w, add_special_tokens=False).ids for w in words]
    whole = [i for i, w in enumerate(words) if w.isalpha()]
    got = own.merged(plain)
    assert [got[i] for i in whole] == [want[i] for i in whole] and own.merged([]) == []
    monkeypatch.setattr(bpe.WordBpe, "merged_short", None)
    calls, test = [], bpe.WordBpe.ranks_of
    monkeypatch.setattr(bpe.WordBpe, "ranks_of", lambda *a: calls.append(1) or test(*a))
    assert list(own.encode_batch(words)) == want
    assert len(calls) < 300


PAGES = {
    "<html><nav><a>Home</a></nav><article><h1>T&amp;t</h1><p>One, two,\n three.<p>Four <b>fi</b>ve<br>six</article>"
    "<div class='comments'><p>bad, bad, bad</p></div><footer>f</footer>": "T&t One, two, three. Four five six",
    "<div id=sidebar><p>links, and, more</p></div><div><h2>Head</h2><p>Text, of the, article.</p></div><form>x</form>":
        "Head Text, of the, article.",
    "<script>var t='</p>';</script><main><p>a &lt; b &eacute;</p></main>": "a < b é",
    "": "", "no tags, at all": "no tags, at all", "<p>open": "open", "</div></p><p>x, y</p>": "x, y", "<nav>only</nav>": "",
}


def test_html(spark):
    rows = [(i, None if i % 2 else "u", h) for i, h in enumerate(PAGES)] + [(None, None, None), (0, "u", next(iter(PAGES)))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html_extract.extracted(pages).collect()
    want = [(i, u, PAGES.get(h, "")) for i, u, h in rows]
    assert ids((r.page_id, r.url, r.text) for r in got) == ids(want)
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_extract.extracted(pages.limit(0)).count() == 0
    deep = "<div>" * 20000 + "<p>deep, text</p>"
    assert html_extract.main_text(deep) == "deep, text"


def test_packing(docs, none):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(BYTE_BPE)
    want = {r[0]: library.encode(r[1] or "", add_special_tokens=False).ids + [0] for r in ROWS if r[0] is not None}
    got = packing.pack(docs, BYTE_BPE).collect()
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
        if r.doc_id is not None:
            part = np.array(want[r.doc_id][r.start:r.start + r.length], "<u4")
            assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32
            assert len(want[r.doc_id]) > 2048 or r.piece == 0
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in got)
    rows = sum(len(want[r[0]]) if r[0] is not None else len(library.encode(r[1] or "").ids) + 1 for r in ROWS)
    assert total == rows and len(bins) <= -(-total // 2048) + 1
    assert packing.pack(none, BYTE_BPE).count() == 0


def test_packing_of_long_white_space():
    """Runs that the split pattern cannot take; shorter runs show what the ids must be."""
    for c in " \n":
        short = packing.token_ids(f"one{c * 20001} two <|endoftext|>", BYTE_BPE).tolist()
        long = packing.token_ids(f"one{c * 2000001} two <|endoftext|>", BYTE_BPE).tolist()
        with pytest.raises(ValueError):
            packing.byte_tokenizer(BYTE_BPE).encode(f"one{c * 2000001} two")
        assert long[:20] == short[:20] and long[-20:] == short[-20:]
        decoded = packing.byte_tokenizer(BYTE_BPE).decode(long)
        assert decoded == f"one{c * 2000001} two <|endoftext|>"


def fewest(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins) if b + items[i] <= capacity}.values():
            bins[k] += items[i]
            go(i + 1, bins)
            bins[k] -= items[i]
        go(i + 1, [*bins, items[i]])
    go(0, [])
    return best[0]


def test_dominance_keeps_the_optimum():
    r = random.Random(2)
    for _ in range(150):
        items = [r.randint(2, 20) for _ in range(9)]
        left = packing.Counts(collections.Counter(items), 20)
        fixed = sum(n for _, n in packing.dominant_sets(left, 20))
        rest = [s for s in range(21) for _ in range(int(left.of[s]))]
        assert fixed + fewest(rest, 20) == fewest(items, 20)


def test_exact_dedup_in_batches(spark, docs, none):
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = con.sql(ORACLES["op4_exact_dedup"]).fetchall()
    index = exact_dedup.DigestIndex(spark, "test_digests", 4)
    got = exact_dedup.deduplicate(docs, index).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")))
    nan = lambda x: None if x != x else x
    assert ids(tuple(r) for r in got.collect()) == ids(tuple(map(nan, r)) for r in want)
    later = spark.createDataFrame([(900, TEXTS[0]), (901, "new text")], "doc_id long, text string")
    again = {r.doc_id: (r.kept, r.keep_id) for r in exact_dedup.deduplicate(later, index).collect()}
    assert again == {900: (False, 0), 901: (True, 901)}
    assert exact_dedup.deduplicate(none, index).count() == 0
    assert index.rows().groupBy("digest").count().filter("count > 1").count() == 0


def test_quality_equals_sql_and_brute_force(docs, none):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas())
    want = {r[0]: r for r in con.sql(ORACLES["op6_quality_rules"]).fetchall() if r[0] == r[0]}
    got = quality_rules.judged(docs).collect()
    assert len(got) == len(ROWS)
    for r in got:
        if r.doc_id is not None:
            mine = (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept)
            assert mine == tuple(want[r.doc_id])
            words = re.findall(r"[^\x20\x09-\x0D]+", TEXTS[r.doc_id] if r.doc_id < 100 else prose(r.doc_id - 50, 40)) if (
                r.doc_id >= 100 or TEXTS[r.doc_id]) else []
            windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
            n = collections.Counter(windows)
            assert r.n_repeat_words == len({i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(8)})
    assert quality_rules.judged(none).count() == 0


def test_language(docs, none, spark):
    codes = language_id.codewords(4)
    assert min(int((codes[i] != codes[j]).sum()) for i in range(4) for j in range(i)) == 4
    many = language_id.codewords(9)
    assert len({tuple(r) for r in many.tolist()}) == 9
    model = language_id.fit(docs)
    got = language_id.identified(docs, model).collect()
    assert len(got) == len(ROWS)
    for r in got:
        letters = any(map(str.isalpha, r.text or ""))
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
    assert language_id.identified(none, model).count() == 0
    nothing = language_id.fit(none)
    assert {r.lang_pred for r in language_id.identified(docs, nothing).collect()} == {"und"}


def test_texts_of_no_learned_language_do_not_fit(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.fit(docs)
    assert model.floor > 0
    kept = language_id.identified(docs, model).agg(F.avg(F.col("fits").cast("int"))).first()[0]
    assert kept > 0.995
    r = random.Random(3)
    foreign = ["".join(r.choice("бвгджзклмнпрст аеиоу") for _ in range(400)), "漢字仮名交じり文 " * 40, "zxqj vkzq wqxz jkqv " * 40]
    odd = spark.createDataFrame([(i, t) for i, t in enumerate(foreign)], "doc_id long, text string")
    assert [r.fits for r in language_id.identified(odd, model).collect()] == [False] * 3


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.identified(docs, language_id.fit(docs)).filter(language_id.held_out(F.col("doc_id")))
    right = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98


def test_toxicity_nearest_is_exact_and_tells(spark, docs, none):
    folder = "/root/testdata/sf0.01"
    documents, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    index, found = toxicity.build(documents, labels)
    rows = [r for r in found.collect() if r.terms][:60]
    dense = np.zeros((len(index.ids), len(index.terms)))
    for (t, block), (places, weights) in index.postings.items():
        dense[block * toxicity.BLOCK + places, t] = weights
    for r in rows:
        terms, counts = np.array(r.terms), np.array(r.counts, float)
        all_scores = dense[:, terms] @ index.vector(terms, counts)
        near = index.nearest(terms, counts, 15)
        assert [s for s, _ in near] == pytest.approx(sorted(all_scores[all_scores > 1e-12], reverse=True)[:15], abs=1e-8)
        assert [all_scores[i] for _, i in near] == pytest.approx([s for s, _ in near], abs=1e-8)
    few = spark.createDataFrame([(20, 1), (21, 1), (22, 0), (None, 1), (9, None)], "doc_id long, toxic int")
    assert toxicity.scored(docs, few).count() == len(ROWS)
    assert {r.score for r in toxicity.scored(docs, few.limit(0)).collect()} == {0.0}
    assert toxicity.scored(none, few).count() == 0


def test_term_counts_are_one_row_a_part(spark):
    """Rows counted do not grow with the terms of a text."""
    rows = [(i, list(range(i % 40)), [1] * (i % 40)) for i in range(400)]
    found = spark.createDataFrame(rows, "doc_id long, terms array<int>, counts array<int>").repartition(3)
    parts = toxicity.part_counts(found, 45).collect()
    assert len(parts) == 3
    assert [sum(c) for c in zip(*(p.counts for p in parts))] == [sum(t in r[1] for r in rows) for t in range(45)]
    assert toxicity.part_counts(found.limit(0), 0).rdd.treeAggregate(0, lambda n, r: n + sum(r.counts), int.__add__) == 0


def test_toxicity_held_out(spark):
    """Measured where some hundred held-out rows are toxic; at 0.01 there are a dozen."""
    folder = "/root/testdata/sf0.1"
    documents, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.scored(documents, labels).join(labels, "doc_id").filter(language_id.held_out(F.col("doc_id"))).toPandas()
    rank, y = scored["score"].rank(), scored["toxic"]
    assert (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum())) > 0.93
    assert scored["predicted"][y == 0].mean() < 0.02 and scored["predicted"][y == 1].mean() > 0.8


def union_find(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    r = random.Random(4)
    links = [(i, i + 1) for i in range(40)] + [(r.randint(100, 160), r.randint(100, 160)) for _ in range(40)] + [(500, i) for i in range(600, 640)]
    got = {x.id: x.comp for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = union_find(links, {x for link in links for x in link})
    assert got == {k: v for k, v in want.items() if any(a != b and k in (a, b) for a, b in links)}


@pytest.mark.parametrize("often", [10, 0])
def test_jaccard_equals_brute_force(docs, none, often):
    sets = {r[0]: set(jaccard_join.shingles(r[1]).tolist()) for r in ROWS if r[0] is not None}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and
             100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = union_find(links, sets)
    got = jaccard_join.similar(docs, often).collect()
    assert len(got) == len(ROWS) and len(links) > 3
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want[r.doc_id])
    if often:
        assert jaccard_join.similar(none).count() == 0


def test_prefixes_of_linked_sets_meet():
    r = random.Random(8)
    for _ in range(3000):
        base = r.sample(range(200), r.randint(1, 60))
        x, y = (set(base) | set(r.sample(range(200), r.randint(0, len(base) // 3))) for _ in range(2))
        x -= set(r.sample(sorted(x), r.randint(0, len(x) // 6)))
        if not x or 4 * len(x & y) < 3 * len(x | y) or x == y:
            continue
        often = np.array(sorted(r.sample(range(200), r.randint(0, 200))), np.uint64)
        a, b = (set(jaccard_join.prefix(np.array(sorted(s), np.uint64), often)[0].tolist()) for s in (x, y))
        assert a & b


def test_crowded_sets_are_not_all_paired(spark, monkeypatch):
    """Many copies of one text with other words put in: most are too far from each other to be linked. Only those that
    have enough tokens in common with others are paired at all, and no link is lost."""
    r = random.Random(12)
    base, texts = [f"w{i}" for i in range(120)], []
    for i in range(160):
        found = list(base)
        for k in r.sample(range(120), r.choice([1, 4, 5, 9])):
            found[k] = f"x{i}y{k}"
        texts.append(" ".join(found))
    sets = [set(jaccard_join.shingles(t).tolist()) for t in texts]
    links = [(a, b) for a in range(160) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = union_find(links, range(160))
    pairs, reachable = [], jaccard_join.reachable
    monkeypatch.setattr(jaccard_join, "reachable", lambda x: pairs.append(reachable(x)) or pairs[-1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in jaccard_join.similar(docs).collect()}
    assert got == want and len(set(want.values())) > 40
    assert pairs and pairs[-1].count() < 160


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_sets_are_built_in_small_pieces(spark):
    """A worker holds the sets of few rows at a time; ids beyond 2^53 beside null ones stay exact."""
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"text": [None, "", *(f"a{i} b c d e f" for i in range(1500))]})
    parts = list(jaccard_join.slices(iter([batch])))
    assert max(p.num_rows for p, _ in parts) <= jaccard_join.ROWS and sum(len(s) for _, s in parts) == 1502
    rows = [(2 ** 60 + 1, "one two three four five six"), (None, "seven eight"), (2 ** 60 + 3, "one two three four five six")]
    got = jaccard_join.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(2 ** 60 + 1, 2 ** 60 + 1), (2 ** 60 + 3, 2 ** 60 + 1), (None, None)}


def test_lines_equal_brute_force(spark, none):
    long, r = prose(20, 60), random.Random(1)
    texts = [long + "\nshort one\n" + prose(21, 12), "intro words are here now\n" + long.upper() + "!", near(long) + "\nshort one", None, "",
             prose(22, 12) + "\n\n" + long.replace(",", ";"), "\n".join(prose(r.randint(30, 34), 30) for _ in range(9))]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "x"), (None, prose(21, 12), "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines string")
    places = {(x.doc_id, x.text_key, x.pos) for x in line_dedup.occurrences(docs, 5).collect()}
    simple = lambda s: re.sub(r"[^a-z0]+", " ", re.sub(r"\d+", "0", s.lower())).strip()
    seen = {}
    for key in places:
        text = next(t for d, t, _ in rows if d == key[0] and t)
        seen[key] = simple(text.split("\n")[key[2]])
    keys = sorted(seen, key=lambda k: (k[0] is not None, k[0] or 0, k[1], k[2]))
    links = []
    for i, a in enumerate(keys):
        for j in range(i):
            x, y = seen[a], seen[keys[j]]
            if x == y or edit_distance(x, y) <= int(max(len(x), len(y)) * 0.1 + 1e-9):
                links.append((j, i))
    group = union_find(links, range(len(keys)))
    gone = {k for i, k in enumerate(keys) if group[i] != i}
    assert len(gone) >= 4
    got = line_dedup.deduplicated(docs).collect()
    assert len(got) == len(rows)
    for x in got:
        text = next(t for d, t, _ in rows if d == x.doc_id)
        if text is None:
            assert x.text is None and x.n_lines == 0
            continue
        drop = {k[2] for k in gone if k[0] == x.doc_id}
        kept = [line for i, line in enumerate(text.split("\n")) if i not in drop]
        assert x.text == "\n".join(kept) and x.n_dropped == len(drop)
    assert line_dedup.deduplicated(none).count() == 0


def test_lines_recall_by_edit_similarity_alone(spark):
    """Lines of 10 to 40 words and near copies of them with a changed word or some typos; no SimHash in the truth."""
    r = random.Random(5)
    spell = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8)))
    lines = []
    for i in range(120):
        words = [spell() for _ in range(r.randint(10, 40))]
        copy = list(words)
        if i % 2:
            copy[r.randrange(len(copy))] = spell()
        else:
            for k in r.sample(range(len(copy)), len(copy) // 10):
                copy[k] = copy[k][:-1] + "z"
        lines += [" ".join(words), " ".join(copy)]
    alike = lambda x, y: edit_distance(x, y) <= int(max(len(x), len(y)) * 0.1 + 1e-9)
    want = {2 * i + 1 for i in range(120) if alike(lines[2 * i], lines[2 * i + 1])}
    got = line_dedup.deduplicated(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()
    gone = {x.doc_id for x in got if x.n_dropped}
    assert len(want) > 90 and gone <= want and len(gone) >= 0.95 * len(want), (len(gone), len(want))


def test_unlike_lines_share_no_bucket(spark):
    """Lines stand in a few buckets each, and those of words from one vocabulary hardly meet, however many there are."""
    r = random.Random(9)
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8))) for _ in range(3000)]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(5, 60)))) for i in range(1500)]
    marks = line_dedup.occurrences(spark.createDataFrame(rows, "doc_id long, text string"), 5)
    most = line_dedup.SHORT_SKETCH + line_dedup.LONG_SKETCH
    assert all(0 < len(m.sigs) <= most for m in marks.collect())
    assert line_dedup.buckets(marks).count() < len(rows) / 5


def test_lines_with_a_common_passage_are_not_all_paired(spark, monkeypatch):
    """Unlike lines that hold one passage meet in the buckets of its grams; near copies among them are found all the same."""
    r = random.Random(4)
    spell = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8)))
    passage, lines = " ".join(spell() for _ in range(8)), []
    for i in range(500):
        words = [spell() for _ in range(r.randint(12, 24))]
        words.insert(r.randrange(12), passage)
        lines.append(" ".join(words))
    copies = {i: lines[i].rsplit(" ", 1)[0] + " it" for i in range(0, 500, 50)}
    rows = [*enumerate(lines), *((1000 + i, text) for i, text in copies.items())]
    tested, check = [], line_dedup.edit_check

    def counted(*args):
        verify = check(*args)

        def run(pairs):
            tested.append(pairs.count())
            return verify(pairs)
        return run
    monkeypatch.setattr(line_dedup, "edit_check", counted)
    got = line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id for x in got if x.n_dropped} == {1000 + i for i in copies}
    assert sum(tested) < 10 * len(rows), tested


def test_lines_of_crowded_buckets_are_all_compared(spark):
    """Two alike lines may share nothing of their sketches but the grams of a passage that many unlike lines hold."""
    r = random.Random(11)
    spell = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(3, 5)))
    shared = lambda x, y: set(x.sigs) & set(y.sigs)
    texts = spark.createDataFrame([(" ".join(spell() for _ in range(4)),) for _ in range(400)], "t string").filter("length(t) > 15")
    first = texts.select("t", line_dedup.least_grams(F.col("t"), line_dedup.LONG_GRAM, 1)[0].alias("h"))
    passage, lines = min(first.collect(), key=lambda x: x.h).t, []  # its gram stands in all sketches
    for i in range(60):
        words = [spell() for _ in range(24)]
        lines.append(f"{passage} {' '.join(words)}")
        changed = [w if k % 3 else w[:-1] + ("x" if w[-1] != "x" else "z") for k, w in enumerate(words)]
        lines.append(f"{passage} {' '.join(changed)}")
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    marks = {m.doc_id: m for m in line_dedup.occurrences(docs, 5).collect()}
    common = collections.Counter(s for m in marks.values() for s in m.sigs)
    alike = [2 * i + 1 for i in range(60) if edit_distance(lines[2 * i], lines[2 * i + 1]) <= len(lines[2 * i]) // 10]
    crowded = [i for i in alike if shared(marks[i], marks[i - 1]) and all(common[s] > 16 for s in shared(marks[i], marks[i - 1]))]
    assert len(crowded) > 5
    gone = {x.doc_id for x in line_dedup.deduplicated(docs).collect() if x.n_dropped}
    assert gone == {i for i in alike if shared(marks[i], marks[i - 1])}


def test_counts_of_characters_drop_no_alike_pair(spark):
    """Lines at the edge of similarity, some of them long enough for counts to run over their codes."""
    r = random.Random(12)
    rows = []
    for i in range(150):
        x = [r.choice("etaoinshrdlu ") for _ in range(r.choice([20, 90, 400, 3000]))]
        y = list(x)
        for _ in range(len(x) // 10):
            at = r.randrange(len(y))
            kind = r.randrange(3)
            if kind == 0:
                y[at] = r.choice("etz ")
            elif kind == 1 and len(y) > len(x) - len(x) // 20:
                del y[at]
            else:
                y.insert(at, "e")
        x, y = "".join(x), "".join(y)
        rows.append((2 * i, 2 * i + 1, x, y))
    size = lambda c: F.struct(F.length(c).alias("length"), *line_dedup.counts(F.col(c)))
    pairs = spark.createDataFrame(rows, "a long, b long, x string, y string").withColumn("size_a", size("x")).withColumn("size_b", size("y"))
    near = pairs.filter("levenshtein(x, y) <= floor(greatest(length(x), length(y)) * 0.1)")
    assert near.count() > 100 and line_dedup.fits(line_dedup.SIMILAR)(near).count() == near.count()
    other = pairs.select("a", "size_a").join(pairs.select("b", "size_b"), F.col("b") != F.col("a") + 1)
    assert line_dedup.fits(line_dedup.SIMILAR)(other).count() < other.count() / 4


def test_normal_lines_of_a_whole_text(spark):
    """Lines of a text are what the plain rule gives for each of them."""
    raw = ["A  B, c-12 34.5d", " x ,y ", "", "Ὀδυσσεύς ΣΑΣ\u0085Σ", "²③Ⅷ 7up", "tab\tstop\r", "\u2028 0 00 ", "İI ß", "𐐀😀a"]
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower("raw"), r"\p{N}+", "0"), r"[^\p{L}0]+", " "))
    want = [w.n for w in spark.createDataFrame([(i, t) for i, t in enumerate(raw)], "i int, raw string").orderBy("i").select(plain.alias("n")).collect()]
    docs = spark.createDataFrame([(1, "\n".join(raw))], "doc_id long, text string")
    got = {x.pos: x.normal for x in line_dedup.split_lines(docs, 1).collect()}
    assert got == dict(enumerate(want))
    assert {x.pos for x in line_dedup.split_lines(docs, 3).collect()} == {i for i, n in enumerate(want) if len(n.split(" ")) >= 3}


def test_enough_edits_are_never_too_few(spark):
    r = random.Random(8)
    words = ["ab", "cd", "abc", "d", "eta", "shr"]
    pairs = []
    for _ in range(150):
        x = [r.choice(words) for _ in range(r.randint(1, 9))]
        y = [r.choice(words) if r.random() < 0.2 else w for w in x if r.random() < 0.8] or ["ab"]
        pairs.append((" ".join(x), " ".join(y)))
    pairs += [("a b c", "a c"), ("a c", "a b c"), ("a", "a b c"), ("a b c", "a"), ("a b", "a b")]
    table = spark.createDataFrame(pairs, "x string, y string")
    for row in table.select("x", "y", line_dedup.enough(F.col("x"), F.col("y")).alias("n")).collect():
        assert row.n >= edit_distance(row.x, row.y)
        assert row.n == edit_distance(row.x, row.y) or (row.x, row.y) not in pairs[-5:]


def test_line_votes_do_not_run_over(spark):
    """One line of 70,000 distinct words, and one text in 1,500 rows without an id."""
    spell = lambda n: "".join("abcdefghij"[int(c)] for c in str(n))
    often = " ".join(spell(500000 + 37 * i) for i in range(66))
    rows = [(None, often)] * 1500 + [(3, often)]
    schema = "doc_id long, text string"
    huge = spark.createDataFrame([(1, " ".join(spell(100000 + i) for i in range(70000)))], schema)
    marks = line_dedup.occurrences(spark.createDataFrame(rows, schema).unionByName(huge), 5).collect()
    assert len(marks) == len(rows) + 1 and all(r.bits is not None for r in marks)
    assert len({r.bits for r in marks if r.doc_id != 1}) == 1
    got = line_dedup.deduplicated(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == len(rows) and {(r.doc_id, r.n_dropped) for r in got} == {(None, 0), (3, 1)}


def test_shards(docs, none):
    got = sharding.shard(docs).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert ids((r.doc_id, r.size, r.text_crc32) for r in got) == ids(
        (r[0], size(r[1]), zlib.crc32((r[1] or "").encode())) for r in ROWS)
    shards = collections.defaultdict(list)
    for r in got:
        shards[r.shard].append(r)
    assert set(shards) <= set(range(16)) and all(sorted(r.slot for r in s) == list(range(len(s))) for s in shards.values())
    largest, mean = max(r.size for r in got), sum(r.size for r in got) / 16
    assert all(sum(r.size for r in s) <= mean + largest for s in shards.values())
    assert sharding.shard(none).count() == 0


def test_shards_split_one_hot_text(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("same text " * 9)).otherwise(
        F.concat(F.lit("own "), F.col("id").cast("string"))).alias("text"))
    loads = [r["n"] for r in sharding.shard(docs).groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert len(loads) == 16 and max(loads) - min(loads) <= 400


def test_a_filter_on_the_verdict_splits_each_text_once(docs):
    """Nothing that is asked of the verdict reaches below the generator that gives the counts."""
    for asked in (quality_rules.judged(docs).filter("kept"), quality_rules.judged(docs).filter("n_stuttered > 3 AND NOT base_failed")):
        plan = asked._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("09-") == 1 and "Filter" in plan.split("Generate")[0] and "Filter" not in plan.split("Generate")[1]


def test_pipeline(spark, docs, tmp_path):
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    base = spark.read.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality rules"](spark, base, str(tmp_path))
    good = {r.doc_id for r in quality_rules.judged(docs).filter("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == good and kept.columns == base.columns
    lang = stages["language"](spark, kept, str(tmp_path))
    assert {r.doc_id for r in lang.collect()} <= good and lang.columns == base.columns
    unlabelled = kept.withColumn("lang", F.lit(None).cast("string"))
    assert stages["language"](spark, unlabelled, str(tmp_path)).count() == kept.count()
    packed = corpus_pipeline.run(spark, str(tmp_path))
    out = packed.collect()
    found = {r.doc_id for r in out}
    assert found <= good and 100 in found and not {2, 18} & found
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(packed.columns)


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    """Repeated ids with unlike texts, nulls everywhere, ties, more columns, nothing at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, score int"
    one, other = prose(1, 80), prose(2, 80)
    rows = [(1, one, "en", "a", 1, "k", 0), (2, one, "en", "a", 1, "k", 0), (2, other, "en", None, None, None, None), (2, other, "en", None, None, None, None),
            (None, prose(3, 70), None, None, None, None, None), (None, None, None, None, None, None, None), (4, "", "en", "b", 0, None, None)]
    docs = spark.createDataFrame(rows, schema)
    got = corpus_pipeline.near_copies(spark, docs, "").collect()
    assert sorted([(r.doc_id, r.text) for r in got], key=repr) == sorted(
        [(1, one), (2, other), (2, other), (None, rows[4][1]), (None, None), (4, "")], key=repr)
    none = spark.createDataFrame([], schema)
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, none):
            out = stage(spark, table, "")
            assert out.count() >= 0 and (name == "packing" or out.columns == corpus_pipeline.COLUMNS)
        assert stage(spark, none, "").count() == 0


def test_language_counts_every_labelled_row(spark):
    import zlib
    rows = [(i, f"{'alpha beta' if i % 2 else 'omega psi'} w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}",
             "aa" if i % 2 else "bb") for i in range(8000)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    sums = np.zeros((2, language_id.FEATURES))
    for i, text, lang in rows:
        if zlib.crc32(str(i).encode()) % 5:
            for found in language_id.trigrams(text):
                sums[["aa", "bb"].index(lang)] += np.bincount(found, minlength=language_id.FEATURES)
    chance = (sums + 0.5) / (sums + 0.5).sum(1, keepdims=True)
    assert np.allclose(np.abs(model.weights[:, 0]), np.abs(np.log(chance[0] / chance[1])), atol=1e-5)
