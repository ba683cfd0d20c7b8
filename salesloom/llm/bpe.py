"""BPE encoding and decoding by speculation and verification.

A word is first cut greedily into the longest vocabulary entries. That cut is what merging would give exactly if every
two neighbours are compatible, that is if merging the text of both gives just these two. All neighbours of all new words
of a batch are tested at once in arrays, by undoing merges at the seam from the latest to the earliest. Only words with a
failing pair are merged exactly, all of a batch side by side in arrays.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

#: Words whose tokens a task remembers; a full memory starts anew.
REMEMBERED = 800_000
LONG = 100
NEVER = np.int64(1) << 60
#: Separators that Python's split takes for white space and Unicode does not.
_CONTROL = re.compile("[\x1c-\x1f]")


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte: itself if printable, else the next one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def parts(flat: np.ndarray, size: np.ndarray) -> Iterator[list[int]]:
    """A flat array as lists of these sizes."""
    ends, whole = np.cumsum(size).tolist(), flat.tolist()
    return (whole[start:stop] for start, stop in zip([0, *ends], ends))


class WordBpe:
    """A vocabulary with word ends. Reads the file's normaliser as NFC, one space, lower case, and its split pattern."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model, split = data["model"], data["pre_tokenizer"]["pretokenizers"][0]
        self.end, self.vocab = model["end_of_word_suffix"], model["vocab"]
        white = r"\p{White_Space}"
        self.pattern = regex.compile(split["pattern"]["Regex"].replace(r"\s", white))
        ascii_only = split["pattern"]["Regex"].replace(r"\s", r"\t-\r ").replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9")
        self.ascii_pattern = re.compile(ascii_only)  # for ASCII in lower case
        self.gaps = regex.compile(white + "+")
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.marks = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.bytes = {b: c for b, c in byte_alphabet().items()}
        names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        size = self.size = max(names) + 1
        self.names = [names.get(i, "") for i in range(size)]
        self.digits = [*map(str, range(size))]
        inside = {t: i for t, i in self.vocab.items() if not t.endswith(self.end)}
        self.ends = {t[:-len(self.end)]: i for t, i in self.vocab.items() if t.endswith(self.end)}
        self.inside = inside
        codes = max(map(ord, self.bytes.values())) + 1
        self.first, self.last = (np.array([found.get(chr(c), -1) for c in range(codes)], np.int64)
                                 for found in (inside, self.ends))
        self.tree(codes)
        self.left, self.right, self.made = (np.full(size, -1, np.int64) for _ in range(3))
        keys, self.merge_to = [], []
        for rank, (a, b) in enumerate(x.split(" ") if isinstance(x, str) else x for x in model["merges"]):
            i, j, both = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.merge_to.append(both)
            keys.append(i * size + j)
            self.left[both], self.right[both], self.made[both] = i, j, rank
        order = np.argsort(np.array(keys))
        self.rank_of = {k: r for r, k in enumerate(keys)}
        self.keys, self.ranks = np.array(keys)[order], order.astype(np.int64)
        self.merged_to = np.array(self.merge_to, np.int64)
        # A token that merging its own text does not give proves nothing about its neighbours.
        whole = np.flatnonzero(self.made >= 0)
        self.sound = np.ones(size, bool)
        self.sound[whole] = self.apart(self.left[whole], self.right[whole], self.made[whole])
        for t in whole[np.argsort(self.made[whole])]:
            self.sound[t] &= self.sound[self.left[t]] and self.sound[self.right[t]]
        self.known: dict[str | tuple[str], list[int]] = {}

    def apart(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """For each pair of neighbours: no merge across their seam comes first (before: earlier than that rank)."""
        good, at = np.ones(len(a), bool), np.arange(len(a))
        until = np.full(len(a), NEVER) if before is None else before
        while len(at):
            crossed = self.ranks_of(a, b) < until
            good[at[crossed]] = False
            first, second = self.made[a], self.made[b]
            going = ~crossed & ((first >= 0) | (second >= 0))
            at, a, b, first, second = at[going], a[going], b[going], first[going], second[going]
            # Undo the later merge; of equal ranks the right one came later, and a seam to its left was tried before it.
            undo_left = first > second
            until = np.where(undo_left, first, second + 1)
            a, b = np.where(undo_left, self.right[a], a), np.where(undo_left, b, self.left[b])
        return good

    def tree(self, codes: int) -> None:
        """The vocabulary as a tree of characters: sorted edges, and the entry that ends at each node, inside a word and
        at its end."""
        edges: dict[int, int] = {}
        within, final = [-1], [-1]
        for entries, marks in ((self.inside, within), (self.ends, final)):
            for text, token in entries.items():
                node = 0
                for c in text:
                    node = edges.setdefault(node * codes + ord(c), len(within))
                    if node == len(within):
                        within.append(-1)
                        final.append(-1)
                marks[node] = token
        keys = np.array([*edges], np.int64)
        order = np.argsort(keys)
        self.codes, self.edges, self.to = codes, keys[order], np.array([*edges.values()], np.int64)[order]
        self.within, self.final = np.array(within, np.int64), np.array(final, np.int64)

    def speculate(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of word and token of the greedy cuts of all words, a step down the tree for every word at a time. Words
        that no entries fit, and those of more than LONG characters, have none and are left to exact merging."""
        size = np.array([len(w) for w in words], np.int64)
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        stop = np.cumsum(size)
        word = np.flatnonzero((size > 0) & (size <= LONG))
        at, stop = (stop - size)[word], stop[word]
        node, best, back = np.zeros(len(word), np.int64), np.full(len(word), -1, np.int64), at.copy()
        found, fits = [], np.zeros(len(words), bool)
        while len(word):
            key = node * self.codes + code[at]
            near = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            down = self.edges[near] == key
            node, at = np.where(down, self.to[near], 0), at + down
            full = at == stop
            end = np.where(full, self.final[node], -1)  # not down: at is not stop
            whole = end >= 0
            inner = np.where(full, -1, self.within[node])
            longer = inner >= 0
            best, back = np.where(longer, inner, best), np.where(longer, at, back)
            cut = (~down | full) & ~whole
            found += [(word[whole], end[whole]), (word[cut], best[cut])]
            fits[word[whole]] = True
            on = ~whole & ~(cut & (best < 0))
            node, at, best = np.where(cut, 0, node), np.where(cut, back, at), np.where(cut, -1, best)
            word, at, stop, node, best, back = (x[on] for x in (word, at, stop, node, best, back))
        owner, token = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        good = fits[owner]
        owner, token = owner[good], token[good]
        order = np.argsort(owner, kind="stable")
        return owner[order], token[order]

    def merged(self, words: list[str]) -> list[list[int]]:
        """Exact merging of each word: always the pair of lowest rank, leftmost first. One merge of every word at a time,
        in arrays; words of more than LONG characters on their own."""
        out: list[list[int]] = [[]] * len(words)
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        for i in (i for i, w in enumerate(words) if len(w) > LONG):
            tokens = [t for c in words[i][:-1] if (t := self.inside.get(c)) is not None]
            tokens += [t for c in words[i][-1:] if (t := self.ends.get(c)) is not None]
            out[i] = self.merged_long(tokens)
        size = np.array([len(words[i]) for i in short], np.int64)
        code = np.frombuffer("".join(words[i] for i in short).encode("utf-32-le"), np.uint32)
        owner, end = np.repeat(np.arange(len(short)), size), np.zeros(len(code), bool)
        end[np.cumsum(size)[size > 0] - 1] = True
        token = np.where(end, self.last[code], self.first[code])
        owner, token = owner[token >= 0], token[token >= 0]
        rank = self.ranks_of(token[:-1], token[1:])
        rank = np.append(np.where(owner[1:] == owner[:-1], rank, NEVER), NEVER)[:len(token)]
        done = []
        while len(token):
            begins = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            least = np.repeat(np.minimum.reduceat(rank, begins), np.diff(np.append(begins, len(token))))
            open_ = least < NEVER
            done.append((owner[~open_], token[~open_]))
            owner, token, rank, least = owner[open_], token[open_], rank[open_], least[open_]
            at = np.flatnonzero(rank == least)
            at = at[np.append(True, owner[at[1:]] != owner[at[:-1]])[:len(at)]]
            token[at] = self.merged_to[rank[at]]
            stay = np.ones(len(token), bool)
            stay[at + 1] = False
            at -= np.arange(len(at))  # every merge before takes one place
            owner, token, rank = owner[stay], token[stay], rank[stay]
            for left in (at[at > 0] - 1, at):
                right = np.minimum(left + 1, len(token) - 1)
                new = self.ranks_of(token[left], token[right])
                rank[left] = np.where((owner[left] == owner[right]) & (right > left), new, NEVER)
        if done:
            owner, token = (np.concatenate(x) for x in zip(*done))
            order = np.argsort(owner, kind="stable")
            for i, tokens in zip(short, parts(token[order], np.bincount(owner, minlength=len(short)))):
                out[i] = tokens
        return out

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, NEVER if there is none."""
        key = a * self.size + b
        near = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[near] == key, self.ranks[near], NEVER)

    def merged_short(self, tokens: list[int]) -> list[int]:
        """Looks through all pairs for each merge."""
        rank, size, none = self.rank_of.get, self.size, int(NEVER)
        ranks = [rank(a * size + b, none) for a, b in zip(tokens, tokens[1:])]
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            both = tokens[i] = self.merge_to[least]
            del tokens[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(tokens[i - 1] * size + both, none)
            if i < len(ranks):
                ranks[i] = rank(both * size + tokens[i + 1], none)
        return tokens

    def merged_long(self, tokens: list[int]) -> list[int]:
        """The same with a queue of pairs, for words of any length."""
        rank, size, n = self.rank_of.get, self.size, len(tokens)
        after, ahead, queue = [*range(1, n + 1)], [*range(-1, n - 1)], []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n and (r := rank(tokens[i] * size + tokens[j])) is not None:
                heapq.heappush(queue, (r, i, tokens[i], tokens[j]))

        for i in range(n - 1):
            offer(i, i + 1)
        while queue:
            r, i, a, b = heapq.heappop(queue)
            j = after[i]
            if tokens[i] != a or j >= n or tokens[j] != b:
                continue
            tokens[i], tokens[j], after[i] = self.merge_to[r], -1, after[j]
            if after[j] < n:
                ahead[after[j]] = i
            offer(ahead[i], i)
            offer(i, after[i])
        return [t for t in tokens if t >= 0]

    def learn(self, chunks: set[str]) -> None:
        """Tokens of new chunks: proposals, one test of all their pairs, exact merging of the words that fail."""
        findall, ascii_findall = self.pattern.findall, self.ascii_pattern.findall
        split = [ascii_findall(c.lower()) if c.isascii() else findall(self.normal(c)) for c in chunks]
        words = [*({*chain.from_iterable(split)} - self.known.keys())]  # a word known as a chunk of its own is known
        plain = [w if w.isascii() and w.isalpha() else w.encode("utf-8").decode("latin-1").translate(self.bytes)
                 for w in words]
        owner, flat = self.speculate(plain)
        size = np.bincount(owner, minlength=len(words))
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        wrong = size == 0
        wrong[owner[inner[~self.apart(flat[inner], flat[inner + 1])]]] = True
        wrong[owner[~self.sound[flat]]] = True
        known, failed = self.known, np.flatnonzero(wrong).tolist()
        known.update(zip(words, parts(flat, size)))
        known.update(zip((words[i] for i in failed), self.merged([plain[i] for i in failed])))
        known.update((c, known[s[0]] if len(s) == 1 else [*chain.from_iterable(map(known.__getitem__, s))])
                     for c, s in zip(chunks, split))

    @staticmethod
    def normal(text: str) -> str:
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def chunks(self, text: str) -> list[str]:
        """Special tokens as they are, other text cut at white space, which no word spans."""
        if "<|" in text and len(parts := self.marks.split(text)) > 1:
            return [c for p in parts for c in ([(p,)] if p in self.special else self.chunks(p))]
        return text.split() if not _CONTROL.search(text) else self.gaps.split(text)

    def encode_batch(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of each text. Special tokens are kept apart from equal strings by standing in a tuple."""
        split = [self.chunks(t) for t in texts]
        new = set().union(*split) - self.known.keys()
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = set().union(*split)
        special = {c for c in new if isinstance(c, tuple)}
        self.known.update((c, [self.special[c[0]]]) for c in special)
        if new := new - special:
            self.learn(new)
        for found in split:
            yield [*chain.from_iterable(map(self.known.__getitem__, found))]

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder: tokens joined by one space, special ones included."""
        return " ".join(map(self.names.__getitem__, ids))


@functools.lru_cache(2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and decoded text of every whole text.

    A null or empty text has no ids and decodes to the empty text. Null doc_ids and repeated rows are kept as they come;
    columns besides doc_id and text are not read. Every row is handled where it lies: no shuffle, one batch in memory.
    path must exist on the workers.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(path)
        for batch in batches:
            ids = list(bpe.encode_batch(batch["text"].fillna("").tolist()))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": ids, "decoded": [bpe.decode(x) for x in ids]})
    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text; see `encoded` for the cases. Ids stay in the task."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(path)
        sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at:at + 256]
                rows = [(len(x), sha(" ".join(map(bpe.digits.__getitem__, x))), sha(bpe.decode(x)))
                        for x in bpe.encode_batch(part["text"].fillna("").tolist())]
                n, ids, decoded = zip(*rows)
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "n_tokens": n, "ids_sha256": ids,
                                    "decoded_sha256": decoded})
    return docs.select("doc_id", "text").mapInPandas(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
