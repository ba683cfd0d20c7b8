"""Toxicity by the nearest labelled examples.

Terms that tell the labels apart are chosen on a bounded sample of labelled rows; their idf is counted over all
documents. The sample's TF-IDF vectors stand in an inverted index whose postings are cut into blocks of examples, each
with its largest weight for every term. A text's blocks are visited from the highest bound down until no block can still
hold a nearer example, so the nearest ones are exact. They vote by their cosine; votes and their sources are the evidence.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from salesloom.llm.language_id import held_out
from salesloom.session import stored

#: Labelled rows in the index, half of them of each label if there are as many; terms; neighbours; examples in a block.
SAMPLE, TERMS, NEIGHBOURS, BLOCK = 4096, 4096, 15, 64
#: Least chi-square of a term against the label, and the weight of the base rate among the votes.
TELLING, PRIOR = 25.0, 0.5
#: A word is a term, and so is its beginning in each of these lengths, which catches inflected and compound forms.
STEMS = (3, 5, 7)
#: Words whose terms a task remembers; a full memory starts anew.
REMEMBERED = 300_000
_WORD = re.compile(r"\w+")


@dataclass
class Index:
    terms: dict[str, int]
    idf: np.ndarray
    ids: list            # example -> doc_id
    label: np.ndarray
    weight: np.ndarray   # what one example of its label stands for
    bounds: np.ndarray   # term x block: largest weight
    postings: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]  # (term, block) -> examples in it, weights
    base: float          # share of label 1 among examples without any term
    opened: dict[int, np.ndarray] = field(default_factory=dict)  # a task's blocks: term x example

    def block(self, at: int) -> np.ndarray:
        """The weights of a block's postings; a term is one row, so a text's terms are summed in one product."""
        if at not in self.opened:
            rows = np.zeros((len(self.terms), BLOCK))
            for term in range(len(self.terms)):
                if (p := self.postings.get((term, at))) is not None:
                    rows[term, p[0]] = p[1]
            self.opened[at] = rows
        return self.opened[at]

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        v = (1 + np.log(counts)) * self.idf[terms]
        return v / (np.sqrt((v * v).sum()) or 1.0)

    def nearest(self, terms: np.ndarray, counts: np.ndarray, k: int) -> list[tuple[float, int]]:
        """The k largest cosines above 0 and their examples; of equal ones the first examples."""
        q = self.vector(terms, counts)
        bound = np.einsum("i,ij->j", q, self.bounds[terms])  # no threads of its own in a task
        best: list[tuple[float, int]] = []
        for block in np.argsort(-bound, kind="stable"):
            if bound[block] <= 0 or len(best) == k and bound[block] < best[-1][0] - 1e-9:
                break
            score = np.einsum("i,ij->j", q, self.block(int(block))[terms])
            least = best[-1][0] - 1e-9 if len(best) == k else 0.0
            found = np.flatnonzero(score > max(least, 0.0))
            best += [(round(float(score[i]), 9), int(block) * BLOCK + int(i)) for i in found]
            best.sort(key=lambda x: (-x[0], x[1]))
            del best[k:]
        return best

    def score(self, terms: np.ndarray, counts: np.ndarray, k: int) -> tuple[float, list[tuple[float, int]]]:
        near = self.nearest(terms, counts, k) if len(terms) else []
        vote = sum(s * self.weight[i] * self.label[i] for s, i in near)
        total = sum(s * self.weight[i] for s, i in near)
        return (vote + PRIOR * self.base) / (total + PRIOR), near


def terms_of(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in STEMS if len(word) > n)]


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def examples(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, dict[int, int]]:
    """About `sample` labelled rows (doc_id, text, toxic), and how many rows there are of each label."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    luck = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    share = F.when(F.col("toxic") == 1, sample / 2 / max(1, sizes.get(1, 0))).otherwise(sample / 2 / max(1, sizes.get(0, 0)))
    # The drawn ids are as few as the sample, whatever the tables hold.
    drawn = known.filter(luck < share)
    texts = docs.select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(drawn), "doc_id")
    return stored(texts.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("text").alias("text")), "toxic-examples"), sizes


def telling_terms(drawn: DataFrame, most: int = TERMS) -> list[str]:
    """The terms with the largest chi-square against the label, most of them at most."""
    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(t, y) for text, y in zip(batch["text"], batch["toxic"]) for t in {t for w in set(words_of(text)) for t in terms_of(w)}]
            yield pd.DataFrame(rows, columns=["term", "toxic"]).groupby("term")["toxic"].agg(["sum", "count"]).reset_index()
    n = drawn.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("y")).first()
    a, with_term = F.sum("sum").alias("a"), F.sum("count").alias("c")
    table = drawn.mapInPandas(split, "term string, sum long, count long").groupBy("term").agg(a, with_term)
    a, c, y, rows = F.col("a").cast("double"), F.col("c").cast("double"), float(n["y"]), float(n["n"])
    chi = rows * F.pow(a * rows - c * y, 2) / F.greatest(c * (rows - c) * y * (rows - y), F.lit(1.0))
    table = table.filter("c > 1").select("term", chi.alias("chi")).filter(F.col("chi") >= TELLING)
    return [r["term"] for r in table.orderBy(F.desc("chi"), "term").limit(most).collect()]


def hits(docs: DataFrame, terms: dict[str, int]) -> DataFrame:
    """doc_id with the numbers and counts of the chosen terms in its whole text; written once."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, known = shared.value, {}
        for batch in batches:
            rows = []
            for text in batch["text"]:
                found = words_of(text)
                if len(known) > REMEMBERED:
                    known.clear()
                for w in set(found):  # a difference of sets would walk the whole memory for every text
                    if w not in known:
                        known[w] = [place[t] for t in terms_of(w) if t in place]
                got = Counter(chain.from_iterable(map(known.__getitem__, found)))
                rows.append(sorted(got.items()))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "terms": [[t for t, _ in r] for r in rows],
                                "counts": [[n for _, n in r] for r in rows]})
    found = docs.select("doc_id", "text").mapInPandas(run, "doc_id long, terms array<int>, counts array<int>")
    return stored(found, "term-hits")


def part_counts(found: DataFrame, terms: int) -> DataFrame:
    """In how many rows of a part each chosen term stands: one row for each part, however many terms its texts hold."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(terms, np.int64)
        for batch in batches:
            if len(batch):
                total += np.bincount(np.concatenate(batch["terms"].to_list()).astype(np.int64), minlength=terms)
        yield pd.DataFrame({"counts": [total]})
    return found.select("terms").mapInPandas(count, "counts array<long>")


def build(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Index, DataFrame]:
    """The index of the sample, and the hits of all documents that its idf was counted on."""
    drawn, sizes = examples(docs, labels, sample)
    terms = {t: i for i, t in enumerate(telling_terms(drawn))}
    found = hits(docs, terms)
    counts = part_counts(found, len(terms)).rdd.treeAggregate(
        np.zeros(len(terms), np.int64), lambda total, row: total + np.array(row["counts"], np.int64), np.add)
    idf = np.log((1 + found.count()) / (1 + counts)) + 1
    own = sorted(hits(drawn, terms).join(drawn.select("doc_id", "toxic"), "doc_id").collect(), key=lambda r: r["doc_id"])
    label = np.array([r["toxic"] for r in own], np.int64)
    stands = np.array([sizes.get(y, 0) / max(1, int((label == y).sum())) for y in (0, 1)])
    weight = stands[label] / max(stands.max(), 1e-9) if len(label) else np.zeros(0)
    blocks = max(1, -(-len(own) // BLOCK))
    index = Index(terms, idf, [r["doc_id"] for r in own], label, weight, np.zeros((len(terms), blocks)), {}, 0.0)
    raw: dict[tuple[int, int], list[tuple[int, float]]] = {}
    none = np.zeros(len(own), bool)
    for i, r in enumerate(own):
        t, n = np.array(r["terms"], np.int64), np.array(r["counts"], float)
        none[i] = not len(t)
        for term, w in zip(t.tolist(), index.vector(t, n).tolist()):
            raw.setdefault((term, i // BLOCK), []).append((i % BLOCK, w))
            index.bounds[term, i // BLOCK] = max(index.bounds[term, i // BLOCK], w)
    index.postings.update({k: (np.array([i for i, _ in v]), np.array([w for _, w in v])) for k, v in raw.items()})
    index.base = float((weight * label * none).sum() / (weight * none).sum()) if none.any() else 0.0
    return index, found


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, neighbours: int = NEIGHBOURS) -> DataFrame:
    """doc_id, score (0 to 1), predicted, and as evidence the nearest examples, their cosines and labels.

    A null or empty text, or one without any chosen term, has no neighbours and gets the share of label 1 among such
    examples. With no labelled rows every score is 0. Null ids and repeated rows are scored like others. Rows of labels
    with a null id or a label other than 0 and 1 are not read; of an id labelled twice the higher label counts. Only
    doc_id and text of docs are read; ids only find the labelled texts. An empty table gives an empty one.
    """
    index, found = build(docs, labels, sample)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix = shared.value
        for batch in batches:
            rows = []
            for terms, counts in zip(batch["terms"], batch["counts"]):
                score, near = ix.score(np.asarray(terms, np.int64), np.asarray(counts, float), neighbours)
                rows.append((score, int(score >= 0.5), [ix.ids[i] for _, i in near], [s for s, _ in near],
                             [int(ix.label[i]) for _, i in near]))
            out = pd.DataFrame(rows, columns=["score", "predicted", "nearest", "cosines", "nearest_labels"])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out
    return found.mapInPandas(run, "doc_id long, score double, predicted int, nearest array<long>, "
                                  "cosines array<double>, nearest_labels array<int>")
