"""Similarity groups by the Jaccard coefficient of word shingles, with token-combination prefixes.

A document's tokens are its distinct shingles, in one order for all documents: rare tokens before frequent ones, each by
hash. Two linked documents have their first common token early in both. If that token is rare, it is among the first
n - t + 1 tokens of both (t: what a set of n must share), and these are indexed alone. If it is frequent, the two have no
rare token in common; then their frequent tokens are nearly all common, and many that are neighbours in one document are
neighbours in the other: at most n/3 tokens lie in one document only, and each parts one pair of neighbours. So documents
whose prefix reaches into frequent tokens index combinations of two neighbouring ones, as many as it takes to have one in
common for certain. Indexing is linear in n, and no linked pair is missed whichever tokens count as frequent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh3_64_intdigest

from salesloom.llm.frames import lookup_hot
from salesloom.llm.linking import grouped
from salesloom.session import stored

WORDS = 5
#: Linked: PART * intersection >= WHOLE * (size of one + size of the other), which is a Jaccard coefficient of 0.75.
PART, WHOLE = 7, 3
#: A token of more documents than this is frequent. The frequent class holds the MOST most frequent of these, which
#: bounds what is broadcast; others are indexed as rare ones, and large buckets cost no more than their members.
OFTEN, MOST = 10, 1 << 19
#: Up to so many ids are broadcast; more meet in a shuffle.
BROADCAST_IDS = 1 << 20
#: Rows a Python worker holds the sets of at a time.
ROWS = 512
#: Bytes of text whose words are hashed at a time.
PIECE = 1 << 20

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F],
                np.uint64)


_WHITE = np.zeros(256, bool)
_WHITE[list(b" \t\n\x0b\x0c\r")] = True
#: Masks of the first n of eight bytes.
_HEAD = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def word_hashes(text: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words text[start:end], eight bytes of all words at a time."""
    eight = np.ndarray(len(text) + 1, "<u8", text + bytes(8), strides=(1,))
    size, h, on, at = ends - starts, (ends - starts).astype(np.uint64) * _MIX[0], np.arange(len(starts)), 0
    while len(on):
        part = eight[starts[on] + at] & _HEAD[np.minimum(size[on] - at, 8)]
        h[on] = mixed(mixed((h[on] ^ part) * _MIX[1]) + _MIX[2])
        at += 8
        on = on[size[on] > at]
    return h


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles: words between ASCII white space, A-Z lowered."""
    flat = (b" " + b" ".join(texts) + b" ").lower()
    edges = np.flatnonzero(np.diff(_WHITE[np.frombuffer(flat, np.uint8)]))
    starts, ends = edges[::2] + 1, edges[1::2] + 1
    h = word_hashes(flat, starts, ends)
    total = np.zeros(max(0, len(h) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        total += h[k:k + len(total)] * _MIX[k]
    total = mixed(total)
    bounds = np.searchsorted(starts, np.cumsum([1] + [len(t) + 1 for t in texts])).tolist()
    for first, last in zip(bounds, bounds[1:]):
        if last - first >= WORDS:
            found = np.sort(total[first:last - WORDS + 1])
            yield found[np.append(True, found[1:] != found[:-1])]
        else:
            n = last - first
            whole = (h[first:last] * _MIX[:n]).sum(dtype=np.uint64, keepdims=True) + n * _MIX[-1:]
            yield mixed(whole)[:n]


def shingles(text: str | None) -> np.ndarray:
    return next(shingle_sets([(text or "").encode("utf-8")]))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """The batches in pieces of ROWS rows at most, each with the sets of its texts, which are built from about PIECE bytes
    of text at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            sets, texts, held = [], [], 0
            for text in part.column("text").to_pylist():
                texts.append((text or "").encode("utf-8"))
                held += len(texts[-1])
                if held >= PIECE:
                    sets += shingle_sets(texts)
                    texts, held = [], 0
            yield part, sets + list(shingle_sets(texts))


def set_ids(sets: list[np.ndarray]) -> pa.Array:
    return pa.array(np.array([xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64))


def lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0] + [len(a) for a in arrays]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays).view(np.int64)))


def needed(n: int) -> int:
    """What a set of n tokens shares at least with any linked one."""
    return -(-3 * n // 4)


def prefix(tokens: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, bool]:
    """What a document indexes, and whether that is rare tokens only."""
    n = len(tokens)
    if not n:
        return tokens, True
    often = among(tokens, frequent)
    rare, common = tokens[~often], tokens[often]
    first = n - needed(n) + 1
    if len(rare) >= first:
        return rare[:first], True
    pairs = np.unique(mixed(common[:-1] * _MIX[0] + common[1:] * _MIX[1]))
    shared = max(1, needed(n) - 1 - (n // 3 - len(rare)))
    return np.concatenate([rare, pairs[:max(0, len(pairs) - shared + 1)]]), False


def among(tokens: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    """Which tokens are in the sorted set."""
    if not len(sorted_set):
        return np.zeros(len(tokens), bool)
    return sorted_set[np.minimum(np.searchsorted(sorted_set, tokens), len(sorted_set) - 1)] == tokens


def reach(n: int) -> int:
    """How many of n tokens are counted: the prefix, and a few more in place of frequent ones."""
    return (n - needed(n) + 1) * 7 // 4


def most_frequent(docs: DataFrame, counted: Callable[[np.ndarray], np.ndarray], often: int, most: int) -> np.ndarray:
    """Of the counted part of all sets, the tokens of more than `often` documents, `most` at most; sorted."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in slices(batches):
            token, n = np.unique(np.concatenate([counted(s) for s in sets]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n.astype(np.int64))], ["token", "n"])
    table = docs.select("text").filter("text IS NOT NULL").mapInArrow(count, "token long, n long")
    table = table.groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") > often)
    rows = table.orderBy(F.desc("n"), "token").limit(most).select("token").toPandas()
    return np.sort(rows["token"].to_numpy(np.int64).view(np.uint64))


def frequent_tokens(docs: DataFrame, often: int = OFTEN, most: int = MOST) -> np.ndarray:
    """Tokens that more than `often` documents have in the first part of their set or, once those are set aside, in
    what stands in their place; `most` at most. Counted over all documents."""
    first = most_frequent(docs, lambda tokens: tokens[:reach(len(tokens))], often, most)
    if not len(first) or len(first) >= most:
        return first
    shared = docs.sparkSession.sparkContext.broadcast(first)

    def behind(tokens: np.ndarray) -> np.ndarray:
        """Tokens that move up into the first part when frequent ones leave it."""
        n = reach(len(tokens))
        if n >= len(tokens):
            return tokens[:0]
        rare = tokens[~among(tokens, shared.value)][:n]
        return rare[rare > tokens[n - 1]]

    return np.union1d(first, most_frequent(docs, behind, often, most - len(first)))


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def profiles(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """doc_id, text_key (hash of the text), id (fingerprint of the set), size (negative: not rare tokens only) and sigs of every row; written once."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for part, sets in slices(batches):
            found = [prefix(s, often) for s in sets]
            size = np.array([len(s) if rare else -len(s) for s, (_, rare) in zip(sets, found)], np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text_key"), set_ids(sets), pa.array(size),
                 lists([sigs for sigs, _ in found])], ["doc_id", "text_key", "id", "size", "sigs"])
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), "text")
    return stored(keyed.mapInArrow(run, "doc_id long, text_key long, id long, size int, sigs array<long>"),
                  "shingle-profiles")


def sets_of(docs: DataFrame, classes: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, tokens) of the sets with these distinct ids, from the text of one document each; written once."""
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in slices(batches):
            yield pa.RecordBatch.from_arrays([set_ids(sets), lists(sets)], ["id", "tokens"])

    firsts = stored(classes.join(ids, "id").select(F.col("first").alias("doc_id")), "first-docs")
    side = F.broadcast(firsts) if firsts.count() <= BROADCAST_IDS else firsts
    texts = docs.select("doc_id", "text").join(side, "doc_id", "left_semi").select("text")
    return stored(texts.mapInArrow(hashed, "id long, tokens array<long>").dropDuplicates(["id"]), "sets")


def linked_pairs(docs: DataFrame, classes: DataFrame):
    """The exact test of pairs of sets: texts of one document for each set, and the size of their intersection."""
    def verify(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
        sets = sets_of(docs, classes, ids)
        met = pairs.join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("x")), "a")
        met = met.join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("y")), "b")
        common = F.size(F.array_intersect("x", "y"))
        return met.filter(PART * common >= WHOLE * (F.size("x") + F.size("y"))).select("a", "b")

    return verify


def rarest_first(docs: DataFrame, classes: DataFrame):
    """Posts of crowded sets by their first tokens in the order of how many of these sets have them.

    A set's tokens that no other crowded set has come first and are no post, so a set that has too many of them to be
    linked has none. size: the number of tokens, the place of the post's token among them, and the number of own tokens.
    The sets with the fewest own tokens, which most others are near, lead.
    """
    def reindexed(ids: DataFrame) -> DataFrame:
        each = sets_of(docs, classes, ids).select("id", F.size("tokens").alias("n"), F.explode("tokens").alias("sig"))
        shared = each.groupBy("sig").agg(F.count(F.lit(1)).alias("often")).filter("often > 1")
        met = each.join(stored(shared, "crowd-tokens"), "sig").groupBy("id", "n").agg(
            F.sort_array(F.collect_list(F.struct("often", "sig"))).alias("common"))  # tokens of one set
        own = F.col("n") - F.size("common")
        first = (F.col("n") - F.ceil(3 * F.col("n") / 4) + 1 - own).cast("int")
        posts = met.select("id", "n", own.alias("own"), F.posexplode(F.slice("common", 1, F.greatest(first, F.lit(0)))))
        return posts.select(F.col("col.sig").alias("sig"), "id", 
                            F.struct("n", (F.col("own") + F.col("pos") + 1).alias("at"), "own").alias("size"))
    return reindexed


def reachable(pairs: DataFrame) -> DataFrame:
    """Drops pairs at a token behind which too few can be common. At the first common token of linked sets enough are."""
    x, y = F.col("size_a"), F.col("size_b")
    most = F.least(x["n"] - x["at"], y["n"] - y["at"]) + 1
    return pairs.filter(PART * most >= WHOLE * (x["n"] + y["n"]))


def fits(pairs: DataFrame) -> DataFrame:
    """Drops pairs whose sizes differ too much."""
    x, y = F.abs("size_a"), F.abs("size_b")
    return pairs.filter((4 * x >= 3 * y) & (4 * y >= 3 * x))


def alike(pairs: DataFrame) -> DataFrame:
    """Drops pairs that both index rare tokens only and share too few of them: tokens behind the shorter prefix are all
    that can be common besides."""
    x, y = F.abs("size_a"), F.abs("size_b")
    behind = F.ceil(3 * F.greatest(x, y) / 4) - 1
    enough = PART * (F.col("shared") + behind) >= WHOLE * (x + y)
    return pairs.filter((F.col("size_a") < 0) | (F.col("size_b") < 0) | enough)


def similar(docs: DataFrame, often: int = OFTEN, most: int = MOST) -> DataFrame:
    """doc_id, n_shingles, component_id and text_key, a hash of the text, of every row.

    Two documents are linked when their sets' Jaccard coefficient is 0.75 or more; component_id is the smallest doc_id
    that links reach. A null or empty text, or one without words, has no shingles and is linked with nothing; with fewer
    words than a shingle the whole sequence is the one shingle. Rows with equal sets are one class and are indexed once.
    A row without doc_id is no link to others, and its component_id is the least id of rows with the same set. Rows
    repeated with one doc_id get one row each. Columns besides doc_id and text are not read. An empty table gives an
    empty one.

    Shingles and sets are compared by 64-bit hashes; among n sets some n * n / 4e19 would meet by chance.
    """
    rows = profiles(docs, frequent_tokens(docs, often, most))
    classes = stored(rows.filter("size != 0").groupBy("id").agg(
        F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows")), "shingle-classes")
    posts = rows.select(F.explode("sigs").alias("sig"), "id", "size")
    twice = stored(posts.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("sig"), "shared-sigs")
    posts = posts.join(twice, "sig", "left_semi").distinct()
    comp = grouped(posts, linked_pairs(docs, classes), fits, alike, crowded=(rarest_first(docs, classes), reachable, "size.own"))
    whole = classes.join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    whole = stored(whole, "class-groups")
    least = stored(whole.groupBy("comp").agg(F.min("first").alias("component_id")), "group-ids")
    named = stored(whole.join(least, "comp").select("id", "component_id", "rows"), "named-classes")
    found = lookup_hot(rows.filter("size != 0").select("doc_id", "text_key", "id", "size"), named, "id", "rows", rows.count())
    alone = rows.filter("size = 0").select("doc_id", "text_key", "size", F.col("doc_id").alias("component_id"))
    out = found.select("doc_id", "text_key", "size", "component_id").unionByName(alone)
    return out.select("doc_id", F.abs("size").cast("long").alias("n_shingles"), "component_id", "text_key")
