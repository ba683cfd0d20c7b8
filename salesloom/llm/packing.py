"""Packing documents into sequences: dominance reduction, then best fit.

Tokenizing runs in parallel tasks and is written once. How many pieces there are of each length is a table of at most
`capacity` rows, whatever the corpus; the plan is made on these counts, never on single pieces, and says how many
sequences hold which lengths. Pieces of a length are numbered in parallel and look their place up in the plan.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame, Window as W, functions as F
from tokenizers import Tokenizer

from salesloom.llm.bpe import byte_alphabet
from salesloom.session import stored

CAPACITY = 2048
END = 0
# Fixed value: the split pattern of byte-level BPE files that name none.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(2)
def byte_tokenizer(path: str) -> tiktoken.Encoding:
    """The merges of a byte-level BPE file; entries beyond the merges are its special tokens."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    special = {t["content"]: t["id"] for t in data["added_tokens"]}
    byte = {c: b for b, c in byte_alphabet().items()}
    ranks = {bytes(byte[c] for c in t): i for t, i in data["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


@functools.lru_cache(2)
def library_tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def token_ids(text: str | None, path: str) -> np.ndarray:
    """Ids of any text. On a run of some hundred thousand white spaces the split pattern exceeds its stack; the
    tokenizers library, which is slower, then gives the same ids."""
    tokenizer = byte_tokenizer(path)
    try:
        return tokenizer.encode_to_numpy(text or "", allowed_special=tokenizer.special_tokens_set)
    except ValueError:
        return np.array(library_tokenizer(path).encode(text, add_special_tokens=False).ids, np.uint32)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and the place of a piece among those of its length in its task."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                # A null text has no ids but the end.
                ids = np.append(token_ids(text, path), np.uint32(END)).astype("<u4")
                first = len(ids) % capacity or min(len(ids), capacity)
                at = 0
                for k, stop in enumerate(range(first, len(ids) + 1, capacity)):
                    rows.append((doc, k, at, stop - at, zlib.crc32(ids[at:stop].tobytes()), seen[stop - at]))
                    seen[stop - at] += 1
                    at = stop
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "nth"]).astype(
                {"doc_id": "Int64"})
    return docs.select("doc_id", "text").mapInPandas(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, nth long")


class Counts:
    """How many items there are of each size; all queries look at sizes only."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.of = np.zeros(capacity + 2, np.int64)
        for size, n in counts.items():
            self.of[size] = n

    def largest(self, most: int) -> int:
        """The largest size not above most; 0 if there is none."""
        there = np.flatnonzero(self.of[1:max(most, 0) + 1])
        return int(there[-1]) + 1 if len(there) else 0

    def smallest_sum(self, items: int) -> int:
        """The sum of the smallest so many items; very large if there are fewer."""
        total = 0
        for size in np.flatnonzero(self.of):
            take = min(items, int(self.of[size]))
            total, items = total + take * int(size), items - take
            if not items:
                return total
        return 1 << 60

    def best_pair(self, most: int) -> int:
        """The largest sum of two items that is not above most; 0 if there is none."""
        sizes = np.flatnonzero(self.of)
        if not len(sizes):
            return 0
        partner = np.searchsorted(sizes, most - sizes, "right") - 1
        partner = np.where((partner >= 0) & (sizes[partner] == sizes) & (self.of[sizes] < 2), partner - 1, partner)
        good = partner >= 0
        return int((sizes[good] + sizes[partner[good]]).max(initial=0))


def dominant_sets(counts: Counts, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Sequences that some best packing holds, as (sizes, how many); they are taken out of counts.

    For an item s with room r = capacity - s and f the largest other item that fits into r, {s, f} dominates all
    sets with s when f fills r, when no two others fit into r, or when at most two others fit and the best two are no
    larger than f, since both could take f's place elsewhere. With no f, s is alone. Conditions only get truer as items
    leave, so all equal cases are fixed at once.
    """
    fixed = []

    def take(sizes: tuple[int, ...], n: int) -> None:
        for size in sizes:
            counts.of[size] -= n
        fixed.append((sizes, n))

    changed = True
    while changed:
        changed = False
        for s in np.flatnonzero(counts.of)[::-1].tolist():
            while (n := int(counts.of[s])):
                room = capacity - s
                counts.of[s] -= 1
                f = counts.largest(room)
                alone = f == 0
                pair = not alone and (f == room or counts.smallest_sum(2) > room or (
                    counts.smallest_sum(3) > room and counts.best_pair(room) <= f))
                counts.of[s] += 1
                if alone:
                    # Two equal items that fit together are no lone ones: f would be s.
                    take((s,), n)
                elif pair:
                    take((s, f), n // 2 if f == s else min(n, int(counts.of[f])))
                else:
                    break
                changed = True
    return fixed


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, from, to, sequence, each, offset): pieces from..to-1 of a length lie in sequences from `sequence`
    on, `each` of them in one, the first at `offset`. Rows are bounded by the number of lengths, not of pieces."""
    left, out, used, opened = Counts(counts, capacity), [], dict.fromkeys(counts, 0), 0

    def place(size: int, sequence: int, bins: int, each: int, offset: int) -> None:
        out.append((size, used[size], used[size] + bins * each, sequence, each, offset))
        used[size] += bins * each

    for sizes, n in dominant_sets(left, capacity):
        offset = 0
        for size in sizes:
            place(size, opened, n, 1, offset)
            offset += size
        opened += n
    # Best fit of the rest, large items first; alike sequences form one group (first sequence, how many) by free room.
    rooms: dict[int, list[tuple[int, int]]] = {}
    for size in np.flatnonzero(left.of)[::-1].tolist():
        n = int(left.of[size])
        for room in sorted(r for r in rooms if r >= size):
            groups, each = rooms.pop(room), room // size
            while groups and n:
                sequence, bins = groups.pop()
                full = min(bins, n // each)
                if full:
                    place(size, sequence, full, each, capacity - room)
                    rooms.setdefault(room - size * each, []).append((sequence, full))
                    n -= full * each
                if full < bins and 0 < n < each:
                    place(size, sequence + full, 1, n, capacity - room)
                    rooms.setdefault(room - n * size, []).append((sequence + full, 1))
                    full, n = full + 1, 0
                if full < bins:
                    groups.append((sequence + full, bins - full))
            if groups:
                rooms.setdefault(room, []).extend(groups)
            if not n:
                break
        each = capacity // size
        for bins, inside in ((n // each, each), (1 if n % each else 0, n % each)):
            if bins:
                place(size, opened, bins, inside, 0)
                rooms.setdefault(capacity - inside * size, []).append((opened, bins))
                opened += bins
    return out


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece's sequence and place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece of the end token alone. Only documents longer than capacity are cut, the first
    piece being the short one. Repeated rows are packed once each; a null doc_id stays null. Columns besides doc_id and
    text are not read. An empty table gives an empty one. path must exist on the workers. Piece rows are written once,
    so that numbers hold when a lost task runs again.
    """
    spark = docs.sparkSession
    cut = stored(pieces(docs, path, capacity).withColumn("task", F.spark_partition_id()), "pieces")
    by_task = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    by_task = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    # At most one row for each length.
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = np.array(sorted(plan(counts, capacity)), np.int64).reshape(-1, 6)
    numbered = cut.join(by_task, ["length", "task"]).withColumn("nth", F.col("nth") + F.col("before"))
    shared = spark.sparkContext.broadcast(rows)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = shared.value
        base = int(table[:, 2].max(initial=0)) + 1
        keys = table[:, 0] * base + table[:, 1]
        for batch in batches:
            if not len(batch):
                continue
            length, nth = batch["length"].to_numpy(), batch["nth"].to_numpy()
            found = table[np.searchsorted(keys, length * base + nth, "right") - 1]
            at = nth - found[:, 1]
            yield batch[["doc_id", "piece", "start", "length", "ids_crc32"]].assign(
                sequence_id=found[:, 3] + at // found[:, 4], offset=found[:, 5] + at % found[:, 4] * length)

    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "nth").mapInPandas(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
