"""Collocations: phrases of two to four words that occur together more than their parts do.

Words of a chunk of texts are hashed, and prefix polynomials over these hashes, modulo 2^64, give the fingerprint of every
phrase in arrays. A task counts equal fingerprints of a chunk and compares each occurrence with the first one word by word;
a phrase that shares a fingerprint with another is counted for itself. What a task hands on is a count, a pointer to the
part of the texts where the phrase occurs first, and a second fingerprint of another base, which keeps apart what met in
other chunks: over tasks, phrases are equal if all 96 bits are. A shuffle sums the counts. Only where the sum is large is
the pointer followed: the task that reads that part finds the phrase in its texts and writes it out. A phrase can be
frequent only if its parts are, so words are counted first, then pairs, then longer phrases, and what a filter of bounded
size proves to have a rare part is not handed on.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from salesloom.session import stored

#: Least count of a phrase, share of its count in per cent from which a longer one stands for it, phrases to a language.
LEAST, COVERED, TOP = 30, 80, 2000
SCALE = 2_000_000
UNKNOWN = "und"
LONGEST = 4
#: Bytes of text that a task counts at once (a longer text is taken whole), and bits of a filter of frequent phrases: SPARE
#: for a phrase or more, FILTER_LEAST at least and FILTER_BITS at most.
CHUNK = 4 << 20
FILTER_LEAST, FILTER_BITS, SPARE = 1 << 16, 1 << 27, 16
#: A task merges its sums of fingerprints at so many, and gives out rows by so many.
MOST_SUMS, GIVEN = 2_000_000, 1 << 16
#: Bits of a row number within a part, as Spark gives them.
PART_BITS = 33
#: Words beyond so many bytes are hashed and compared one by one.
LONG_WORD = 64
#: Odd bases of the polynomials of the two fingerprints.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
KINDS = {"fp": np.uint64, "mark": np.uint32, "n": np.int32, "c": np.int64, "part": np.int32}


def byte_classes() -> np.ndarray:
    """What each byte of a text becomes: A-Z lower case, marks that end a piece a line end, the tab a space."""
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    out[[*b".,;:!?", *range(0x0A, 0x0E)]] = 0x0A
    out[0x09] = 0x20
    return out


CLASSES = byte_classes()


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


@functools.lru_cache(4)
def powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Chunk:
    """Words of a few texts: where they lie, the piece they belong to, their hashes."""

    def __init__(self, raw: np.ndarray, starts: np.ndarray, langs: np.ndarray):
        """raw: bytes of all texts, eight more at its end; starts: where each text begins, and the end of the last one."""
        self.low = CLASSES[raw]
        total = int(starts[-1])
        body = self.low[:total]
        first = np.zeros(total + 1, bool)
        first[starts[:-1]] = True
        inside = (body != 0x20) & (body != 0x0A)
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1] | first[1:-1]
        closes[:-1] &= ~inside[1:] | first[1:-1]
        self.start = np.flatnonzero(opens)
        self.size = np.flatnonzero(closes) + 1 - self.start
        cuts = np.flatnonzero((body == 0x0A) | first[:-1])
        self.piece = np.searchsorted(cuts, self.start, "right")
        self.text = np.searchsorted(starts, self.start, "right") - 1
        self.lang = langs[self.text]
        # Eight bytes from every place on, read as one number.
        self.eight = np.ndarray((len(self.low) - 7,), "<u8", self.low.tobytes(), strides=(1,))
        self.sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def polynomial(self, base: int) -> tuple[np.ndarray, np.ndarray]:
        """Prefix sums of word hashes times powers of the base, and the powers that undo them."""
        if base not in self.sums:
            h = self.word_hashes(np.uint64(base))
            room = 1 << max(len(h), 1).bit_length()
            prefix = np.zeros(len(h) + 1, np.uint64)
            np.cumsum(h * powers(room, base)[:len(h)], out=prefix[1:])
            self.sums[base] = prefix, powers(room, pow(base, -1, 1 << 64))
        return self.sums[base]

    def word_hashes(self, base: np.uint64) -> np.ndarray:
        h = self.lang.astype(np.uint64) * base + self.size.astype(np.uint64)
        left = np.flatnonzero(self.size <= LONG_WORD)
        step = 0
        while len(left):
            h[left] = mix((h[left] + self.part(left, step)) * base)
            step += 8
            left = left[self.size[left] > step]
        for i in np.flatnonzero(self.size > LONG_WORD):
            digest = hashlib.blake2b(self.bytes_of(i), digest_size=8, salt=int(base).to_bytes(8, "little")).digest()
            h[i] ^= np.uint64(int.from_bytes(digest, "little"))
        return mix(h)

    def part(self, words: np.ndarray, step: int) -> np.ndarray:
        """Up to eight bytes of each word from byte `step` on; bytes behind its end are 0."""
        over = np.clip(8 - (self.size[words] - step), 0, 7).astype(np.uint64) * np.uint64(8)
        return self.eight[self.start[words] + step] << over

    def bytes_of(self, i: int) -> bytes:
        return self.low[self.start[i]:self.start[i] + self.size[i]].tobytes()

    def same_words(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Are words a and b the same bytes?"""
        same = self.size[a] == self.size[b]
        left = np.flatnonzero(same & (a != b))
        for i in left[self.size[a[left]] > LONG_WORD]:
            same[i] = self.bytes_of(a[i]) == self.bytes_of(b[i])
        left = left[self.size[a[left]] <= LONG_WORD]
        step = 0
        while len(left):
            good = self.part(a[left], step) == self.part(b[left], step)
            same[left[~good]] = False
            step += 8
            left = left[good]
            left = left[self.size[a[left]] > step]
        return same

    def phrases(self, n: int) -> np.ndarray:
        """First words of all phrases of n words within a piece."""
        if len(self.piece) < n:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.piece[n - 1:] == self.piece[:len(self.piece) - n + 1])

    def fingerprints(self, at: np.ndarray, n: int, base: int = BASES[0]) -> np.ndarray:
        prefix, back = self.polynomial(base)
        return mix((prefix[at + n] - prefix[at]) * back[at] + np.uint64(n))

    def tally(self, at: np.ndarray, n: int, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint, first occurrence and count of each phrase; phrases of one fingerprint are told apart by text."""
        found = []
        while len(at):
            order = np.argsort(fp, kind="stable")
            at, fp = at[order], fp[order]
            head = np.flatnonzero(np.r_[True, fp[1:] != fp[:-1]])
            leader = np.repeat(at[head], np.diff(np.r_[head, len(fp)]))
            same = self.lang[at] == self.lang[leader]
            for i in range(n):
                same &= self.same_words(at + i, leader + i)
            found.append((fp[head], at[head], np.add.reduceat(same.astype(np.int64), head)))
            at, fp = at[~same], fp[~same]
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (fp, at, at)


def chunks_of(batch: pa.RecordBatch, limit: int) -> Iterator[tuple[Chunk, int, int]]:
    """The texts of a batch, so many bytes of one part at a time, with the part and the place of the first."""
    texts = batch.column("text").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    parts, langs = batch.column("row").to_numpy() >> PART_BITS, batch.column("code").to_numpy()
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        to = at + int(np.searchsorted(parts[at:to] != parts[at], True))
        raw = np.concatenate([data[offsets[at]:offsets[to]], np.zeros(8, np.uint8)])
        yield Chunk(raw, offsets[at:to + 1] - offsets[at], langs[at:to]), int(parts[at]), at
        at = to


def passes(bits: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """False only for fingerprints that were not put into the filter."""
    def test(place):
        return (bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1)
    last = np.uint64(len(bits) * 64 - 1)
    return (test(fp & last) & test((fp >> np.uint64(32)) & last)).astype(bool)


def chosen(texts: Chunk, n: int, filters: dict[int, np.ndarray]) -> np.ndarray:
    """First words of the phrases of n words all of whose parts, of the most words that there is a filter for, pass it."""
    at = texts.phrases(n)
    m = max((m for m in filters if m <= n), default=0)
    if m:
        heads = texts.phrases(m)
        good = np.zeros(len(texts.start) + LONGEST, bool)
        good[heads[passes(filters[m], texts.fingerprints(heads, m))]] = True
        for i in range(n - m + 1):
            at = at[good[at + i]]
    return at


def signed_of(values: np.ndarray) -> np.ndarray:
    return values.view({np.dtype(np.uint64): np.int64, np.dtype(np.uint32): np.int32}.get(values.dtype, values.dtype))


class Sums:
    """Counts of many chunks by fingerprint and mark, with the pointer of the first; given out when there are many."""

    columns = tuple(KINDS)

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, *values: np.ndarray) -> None:
        self.parts.append([v.astype(KINDS[c], copy=False) for c, v in zip(self.columns, values)])
        self.size += len(values[0])

    def merge(self) -> None:
        values, parts, order, new = [], self.parts, None, None
        self.parts = []
        for i, c in enumerate(self.columns):  # one column at a time: the pieces of it go before those of the next are joined
            whole = np.concatenate([p[i] for p in parts])
            for p in parts:
                p[i] = None
            if order is None:
                order, new = np.argsort(whole, kind="stable"), np.zeros(len(whole), bool)
            values.append(whole[order])
            del whole
            if c in ("fp", "mark"):
                new[1:] |= values[i][1:] != values[i][:-1]
        new[:1] = True
        del order
        head = np.flatnonzero(new)
        counts = np.add.reduceat(values[self.columns.index("c")], head) if len(head) else values[0][:0].view(np.int64)
        self.parts, self.size = [[counts if c == "c" else v[head] for c, v in zip(self.columns, values)]], len(head)

    def due(self, last: bool) -> Iterator[pa.RecordBatch]:
        if not self.size or not (last or self.size > MOST_SUMS):
            return
        self.merge()
        if last or self.size > MOST_SUMS * 7 // 8:
            signed = [signed_of(v) for v in self.parts[0]]
            for i in range(0, self.size, GIVEN):
                yield pa.RecordBatch.from_arrays([pa.array(v[i:i + GIVEN]) for v in signed], names=list(self.columns))
            self.parts, self.size = [], 0


def counted(rows: DataFrame, n: int, filters: dict[int, np.ndarray], least: int, chunk: int) -> DataFrame:
    """(n, fp, mark, f, part) of the chosen phrases of n words that occur `least` times or more; part: the first that has it.

    With words goes a row of n = 0 for each language, f being the number of all its words. Stored.
    """
    shared = rows.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Sums()
        for batch in batches:
            for texts, part, _ in chunks_of(batch, chunk):
                at = chosen(texts, n, shared.value)
                fp, first, c = texts.tally(at, n, texts.fingerprints(at, n))
                found.add(fp, texts.fingerprints(first, n, BASES[1]), np.full(len(fp), n), c, np.full(len(fp), part))
                if n == 1:
                    langs, c = np.unique(texts.lang, return_counts=True)
                    code = langs.view(np.uint64)
                    found.add(code, code, np.zeros(len(c)), c, np.full(len(c), part))
                yield from found.due(False)
        yield from found.due(True)
    # Tasks have summed already: one exchange, no sums before it.
    schema = ", ".join(f"{c} {'int' if np.dtype(kind).itemsize == 4 else 'long'}" for c, kind in KINDS.items())
    each = rows.mapInArrow(run, schema).repartition("fp").groupBy("fp", "mark", "n")
    sums = each.agg(F.sum("c").alias("f"), F.min("part").alias("part")).filter(F.col("f") >= least)
    return stored(sums.select("n", "fp", "mark", "f", "part"), "frequent-fingerprints")


class Known:
    """Fingerprints and marks of one part that are given out already."""

    def __init__(self):
        self.part, self.fp, self.mark = None, np.zeros(0, np.uint64), np.zeros(0, np.uint32)

    def fresh(self, part: int, fp: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Places of those that are not known yet; of two that differ in their marks alone one may come again."""
        if part != self.part:
            self.__init__()
            self.part = part
        at = np.searchsorted(self.fp, fp)
        near = np.minimum(at, len(self.fp) - 1)
        new = np.ones(len(fp), bool) if not len(self.fp) else (self.fp[near] != fp) | (self.mark[near] != mark)
        new = np.flatnonzero(new)
        both = np.concatenate([self.fp, fp[new]])
        order = np.argsort(both, kind="stable")
        self.fp, self.mark = both[order], np.concatenate([self.mark, mark[new]])[order]
        return new


def ranges_of(frequent: DataFrame, most: int) -> list[tuple[int, int]]:
    """First and last part of ranges of parts that have `most` frequent phrases in all, or are one part."""
    ranges, size = [], 0
    for part, n in sorted((r["part"], r["n"]) for r in frequent.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()):
        if not ranges or size + n > most:
            ranges.append((part, part))
            size = 0
        ranges[-1] = ranges[-1][0], part
        size += n
    return ranges


def written_out(rows: DataFrame, frequent: DataFrame, chunk: int, filter_bits: int) -> DataFrame:
    """(n, fp, mark, lang, phrase) of frequent phrases, by the tasks that their pointers lead to, and of few others.

    Each range of parts has a filter of its own, so that filters keep few others however many phrases are frequent; all
    texts are read once."""
    found = [written_by(rows.filter(F.col("row").between(low << PART_BITS, (high + 1 << PART_BITS) - 1)),
                        frequent.filter(F.col("part").between(low, high)), chunk, filter_bits)
             for low, high in ranges_of(frequent, filter_bits // SPARE)]
    return functools.reduce(DataFrame.unionByName, found) if found else written_by(rows.filter("false"), frequent, chunk, filter_bits)


def written_by(rows: DataFrame, frequent: DataFrame, chunk: int, filter_bits: int) -> DataFrame:
    owned = F.col("fp").bitwiseXOR(F.col("part").cast("long").bitwiseOR(F.shiftleft(F.col("part").cast("long"), 32)))
    shared = rows.sparkSession.sparkContext.broadcast(filter_of(frequent.select(owned.alias("fp")), filter_bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known()
        for batch in batches:
            names = batch.column("lang")
            for texts, part, place in chunks_of(batch, chunk):
                own = np.uint64(part | part << 32)
                _, first = np.unique(texts.lang, return_index=True)
                code = texts.lang[first].view(np.uint64)
                good = passes(shared.value, code ^ own)
                found = [(0, code[good], code[good], first[good])]
                for n in range(1, LONGEST + 1):
                    at = texts.phrases(n)
                    fp = texts.fingerprints(at, n)
                    good = passes(shared.value, fp ^ own)
                    fp, first, _ = texts.tally(at[good], n, fp[good])
                    found.append((n, fp, texts.fingerprints(first, n, BASES[1]), first))
                n = np.repeat(np.arange(len(found), dtype=np.int32), [len(f[1]) for f in found])
                fp, mark, first = (np.concatenate([f[i] for f in found]) for i in (1, 2, 3))
                mark = mark.astype(KINDS["mark"])
                new = known.fresh(part, fp, mark)
                for i in range(0, len(new), GIVEN):
                    take = new[i:i + GIVEN]
                    size, at = n[take], first[take]
                    phrases = [b" ".join(map(texts.bytes_of, range(a, a + k))).decode("utf-8") for a, k in zip(at.tolist(), size.tolist())]
                    langs = names.take(pa.array(place + texts.text[at])).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(size), pa.array(signed_of(fp[take])), pa.array(signed_of(mark[take])),
                                                      langs, pa.array(phrases, pa.string())], names=["n", "fp", "mark", "lang", "phrase"])
    return rows.mapInArrow(run, "n int, fp long, mark int, lang string, phrase string")


def filter_of(frequent: DataFrame, most: int = FILTER_BITS) -> np.ndarray:
    """A Bloom filter of fingerprints, of `most` bits at most, so what the driver gets is bounded by most / 64 rows."""
    size = min(most, max(FILTER_LEAST, 1 << (SPARE * frequent.count() - 1).bit_length()))
    place = F.explode(F.array(F.col("fp").bitwiseAND(F.lit(size - 1)),
                              F.shiftrightunsigned("fp", 32).bitwiseAND(F.lit(size - 1)))).alias("place")
    words = frequent.select(place).groupBy(F.shiftright("place", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(place & 63 AS int))")).alias("bits"))
    bits = np.zeros(size // 64, np.uint64)
    found = words.toPandas()
    bits[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return bits


def phrase_counts(docs: DataFrame, least: int = LEAST, chunk: int = CHUNK, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(lang, n, phrase, f) of all phrases of one to four words that occur `least` times or more in their language.

    n = 0 has the number of all words of the language. Stored.
    """
    text, lang = F.col("text"), F.coalesce("lang", F.lit(UNKNOWN))
    texts = docs.filter("text != ''").select(F.monotonically_increasing_id().alias("row"), lang.alias("lang"), text.alias("text"))
    rows = stored(texts, "phrase-texts").withColumn("code", F.xxhash64("lang"))  # fixes the row numbers
    filters, levels = {}, []
    for n in range(1, LONGEST + 1):
        levels.append(counted(rows, n, filters, least, chunk))
        if n < LONGEST:
            filters = {n: filter_of(levels[-1].filter(F.col("n") == n), filter_bits)}
    frequent = functools.reduce(DataFrame.unionByName, levels)
    named = written_out(rows, frequent, chunk, filter_bits).dropDuplicates(["n", "fp", "mark"])
    return stored(named.join(frequent, ["n", "fp", "mark"]).select("lang", "n", "phrase", "f"), "phrases")


def run_of(words: Column, first, size) -> Column:
    return F.array_join(F.slice(words, first, size), " ")


def mined(docs: DataFrame, least: int = LEAST, covered: int = COVERED, top: int = TOP, chunk: int = CHUNK,
          filter_bits: int = FILTER_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first `top` phrases of each language.

    A null text is empty; a null language is `und`. Rows count as often as they are repeated; doc_id and all other columns
    are not read. Phrases that share score and count are ranked by their bytes. An empty table, or one without a phrase
    that is frequent enough, gives an empty one. Texts are handled whole; a chunk holds one text at least.
    """
    found = phrase_counts(docs, least, chunk, filter_bits)
    counts = found.filter("n > 0").select("lang", "phrase", "f")
    of = F.split("phrase", " ")
    longer = found.filter("n > 1").select("lang", "n", "phrase", F.col("f").alias("a"), of.alias("w"))
    cuts = longer.select("lang", "phrase", "a", F.inline(F.transform(F.sequence(F.lit(1), F.col("n") - 1), lambda k: F.struct(
        k.alias("k"), run_of(F.col("w"), F.lit(1), k).alias("left"), run_of(F.col("w"), k + 1, F.col("n") - k).alias("right")))))
    cuts = cuts.join(counts.toDF("lang", "left", "l"), ["lang", "left"]).join(counts.toDF("lang", "right", "r"), ["lang", "right"])
    both = (F.col("l").cast("decimal(19,0)") + F.col("r").cast("decimal(19,0)")).alias("both")
    cuts = cuts.select("lang", "phrase", "a", "k", "l", "r", both, F.col("a").cast("decimal(19,0)").alias("wide"))
    score = F.expr(f"CAST(wide * {SCALE} AS decimal(38,0)) DIV both")
    worst = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    # Every shorter phrase of two words or more inside a longer one.
    inner = longer.filter("n > 2").select("lang", "a", F.explode(F.flatten(F.transform(
        F.sequence(F.lit(2), F.col("n") - 1), lambda m: F.transform(
            F.sequence(F.lit(1), F.col("n") - m + 1), lambda i: run_of(F.col("w"), i, m))))).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("outer"))
    hidden = F.expr(f"CAST(outer AS decimal(19,0)) * 100 >= CAST(a AS decimal(19,0)) * {covered}")
    kept = worst.join(inner, ["lang", "phrase"], "left").filter(F.col("outer").isNull() | ~hidden)
    ranked = kept.select("lang", "phrase", "a", "cut.l", "cut.r", F.col("cut.score").cast("long").alias("score")).withColumn(
        "rank", F.expr("row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)").cast("long")).filter(
        F.col("rank") <= top)
    total = found.filter("n = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
