"""Language identification by error-correcting output codes.

Each language has a codeword of plus and minus bits. For each bit a binary classifier over byte trigrams, fitted on the
languages of either side, gives a margin. A text gets the language whose codeword loses least, bits weighing as much as
they were reliable in training; if two codewords lose almost the same, the text is flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from salesloom.session import stored

#: Hashed trigrams.
FEATURES = 1 << 15
UNDETERMINED = "und"
#: A second codeword with more than this share of the best one's weight makes a text ambiguous.
RIVAL = 0.5
#: A text fits no learned language if it agrees with its codeword less than this share of what all but a few (in a
#: thousand) of the training rows do.
FLOOR_SHARE, FEW = 0.5, 1
#: Bytes looked at in one step; a longer text takes more steps.
STEP = 1 << 18

_BYTES = np.full(256, 32, np.uint32)
_BYTES[97:123], _BYTES[128:] = np.arange(97, 123), np.arange(128, 256)


def trigrams(text: str) -> Iterator[np.ndarray]:
    """Hashed trigrams of lower-cased letters and the gaps between them, in steps."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-8"), np.uint8)
    for at in range(0, max(1, len(raw) - 2), STEP):
        b = _BYTES[raw[at:at + STEP + 2]]
        if len(b) < 3:
            continue
        code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
        code = code[(b[:-2] != 32) | (b[1:-1] != 32)]  # runs of gaps say nothing
        yield ((code * np.uint32(2654435761)) >> np.uint32(17)).astype(np.intp)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1. Up to six languages have all ways to split them; more get the best of many random codes."""
    if n <= 1:
        return np.ones((n, 0), np.int8)
    if n <= 6:
        splits = [[1 if i == 0 or mask >> (i - 1) & 1 else -1 for i in range(n)] for mask in range(2 ** (n - 1) - 1)]
        return np.array(splits, np.int8).T
    random, length = np.random.default_rng(0), max(15, int(np.ceil(10 * np.log2(n))))
    best, apart = None, -1
    for _ in range(200):
        code = random.choice(np.array([-1, 1], np.int8), (n, length))
        near = min(int((code[i] != code[j]).sum()) for i, j in combinations(range(n), 2))
        if near > apart and not (np.abs(code.sum(0)) == n).any():
            best, apart = code, near
    return best


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray  # trigram x bit
    scale: np.ndarray    # a bit's usual margin
    trust: np.ndarray    # a bit's share in the loss
    floor: float = 0.0   # texts that agree less with their language's codeword fit no learned language

    def margins(self, text: str) -> np.ndarray:
        total, n = np.zeros(self.weights.shape[1]), 0
        for found in trigrams(text):
            total += self.weights[found].sum(0, dtype=np.float64)
            n += len(found)
        return total / max(n, 1)

    def agreement(self, margins: np.ndarray, place: int) -> float:
        """How far the bits' margins go the way of a language's codeword; about 1 for usual texts of the language."""
        if not self.codes.shape[1]:
            return 1.0
        return float((self.trust * np.clip(self.codes[place] * (margins / self.scale), -1, 1)).sum() / self.trust.sum())

    def decode(self, margins: np.ndarray) -> tuple[str, float, bool]:
        """Language, its share of the weight of all, and whether a second one comes near."""
        loss = (self.trust * np.logaddexp(0, -4 * self.codes * (margins / self.scale))).sum(1)
        weight = np.exp(loss.min() - loss)
        order = np.argsort(-weight, kind="stable")
        rival = float(weight[order[1]]) if len(order) > 1 else 0.0
        return self.languages[order[0]], float(weight[order[0]] / weight.sum()), rival > RIVAL


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text divides by 5. A row without an id is held out too."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame) -> Model:
    """Fit on all labelled rows, whole texts. Held-out rows and null labels are left out.

    Trigram counts are summed by Spark; the driver gets languages x FEATURES sums and, for each bit, a few moments. Texts are
    read twice: for the counts, and for each row's margins, which are stored.
    """
    known = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.select("text", "lang")
    languages = [r["lang"] for r in known.select("lang").distinct().orderBy("lang").collect()]  # a row for each language
    if not languages:
        return Model([], codewords(0), np.zeros((FEATURES, 0)), np.ones(0), np.ones(0))
    place = {lang: i for i, lang in enumerate(languages)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((len(place), FEATURES), np.int64)
        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"]):
                for found in trigrams(text):
                    sums[place[lang]] += np.bincount(found, minlength=FEATURES)
        at = np.nonzero(sums)
        yield pd.DataFrame({"lang": at[0].astype(np.int32), "feature": at[1].astype(np.int32), "n": sums[at]})

    got = known.mapInPandas(count, "lang int, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    table = got.toPandas()
    sums = np.zeros((len(languages), FEATURES))
    sums[table["lang"], table["feature"]] = table["n"]
    chance = (sums + 0.5) / (sums + 0.5).sum(1, keepdims=True)
    codes = codewords(len(languages))
    plus, minus = (codes == 1).astype(float), (codes == -1).astype(float)
    side = lambda s: np.log((chance.T @ s) / s.sum(0))
    weights = (side(plus) - side(minus)).astype(np.float32) if codes.shape[1] else np.zeros((FEATURES, 0), np.float32)
    model = Model(languages, codes, weights, np.ones(codes.shape[1]), np.ones(codes.shape[1]))
    bits = codes.shape[1]

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"lang": batch["lang"], "margins": [model.margins(text) for text in batch["text"]]})

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        right, size, rows = np.zeros(bits), np.zeros(bits), 0
        for batch in batches:
            for m, lang in zip(batch["margins"], batch["lang"]):
                right += m * codes[place[lang]] > 0
                size += np.abs(m)
                rows += 1
        yield pd.DataFrame({"bit": np.arange(bits, dtype=np.int32), "right": right, "size": size, "rows": float(rows)})

    if bits:
        measured = stored(known.mapInPandas(measure, "lang string, margins array<double>"), "language-margins")
        seen = measured.mapInPandas(test, "bit int, right double, size double, rows double").groupBy("bit").agg(
            F.sum("right").alias("right"), F.sum("size").alias("size"), F.sum("rows").alias("rows")).orderBy("bit").toPandas()
        sure = (seen["right"].to_numpy() + 1) / (seen["rows"].to_numpy() + 2)
        trust = np.maximum(np.log(sure / (1 - sure)), 0.01)
        model.trust = trust / trust.sum() * 4
        model.scale = np.maximum(seen["size"].to_numpy() / np.maximum(seen["rows"].to_numpy(), 1), 1e-6)

        def agree(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame({"a": [model.agreement(m, place[lang]) for m, lang in zip(batch["margins"], batch["lang"])]})

        low = measured.mapInPandas(agree, "a double").agg(F.percentile_approx("a", FEW / 1000, 100_000)).first()[0]
        model.floor = max(0.0, FLOOR_SHARE * (low or 0.0))
    return model


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, score (0 to 1), ambiguous and fits; columns of docs by these names are replaced.

    fits is false for a text that agrees with the codeword of its language far less than texts it was learned from do, and
    for one that is `und`.

    A text that is null or has no letter is `und` with score 0, as is any text if no language was learned. Only the
    text is looked at, all of it, where it lies: no shuffle. Other columns pass through, null or not; repeated rows are
    judged alike; an empty table gives an empty one.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "ambiguous", "fits")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judged(m: Model, text: str) -> tuple[str, float, bool, bool]:
        if not m.languages or not has_letter(text):
            return UNDETERMINED, 0.0, False, False
        margins = m.margins(text)
        lang, score, ambiguous = m.decode(margins)
        return lang, score, ambiguous, m.agreement(margins, m.languages.index(lang)) >= m.floor

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean, fits boolean")
    def judge(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([judged(shared.value, t) for t in texts], columns=["lang_pred", "score", "ambiguous", "fits"])

    return docs.select(*kept, judge("text").alias("_judged")).select(*kept, "_judged.*")
