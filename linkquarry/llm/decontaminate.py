"""Benchmark decontamination by spaced seeds.

A mask picks some positions of a window of words and ignores the others; windows of a benchmark item and of a document
that agree at the picked positions have the same hash, whatever stands between. Around each hit the two texts are
compared along their diagonal, so an overlap is found in full although words in it were substituted.

The mask 11011 loses no overlap of 13 words or more with 80 % the same. Of n words at most k = n / 5 differ, which leaves
at least 4k same ones (11 of 13) in k + 1 runs. Without a hit no run has five words, and no two runs beside one word that
differs have two each; so every other run has one at most, and all together 4 * ceil((k + 1) / 2) + floor((k + 1) / 2),
which is less. So do items of 7 to 9 and of 12 words, as a whole; those of other lengths have more masks.

A benchmark is read by the driver in blocks of a bounded number of words; each block goes to all executors and is held
against all documents, and its rows are written before the next block is read. That is one pass over the documents for
each block, no shuffle, and never more than one block in the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common
from .minhash import word_hashes

# The mask, and those of items of other lengths that need more (found by trying all substitutions).
MASKS = ("11011",)
SHORT_MASKS = {1: ("1",), 2: ("11",), 3: ("111",), 4: ("1111",), 5: ("1111", "1101", "1011", "11011"), 6: ("1111", "11011"), 10: ("1111", "11011"), 11: ("1111", "11011")}
#: Words of a benchmark that are held against the documents at once (their hashes and seeds take about 60 bytes a word).
BLOCK_WORDS = 1_000_000
#: Hits that are looked at together.
HITS = 1 << 18
OVERLAP = "doc_id long, item_id long, doc_start long, doc_end long, item_start long, item_end long, same_words long"


@dataclass(frozen=True)
class Overlap:
    """min_words: of a verified overlap (or the whole item, if it is shorter). percent: of its words that are the same. drop:
    the extension ends where its score (1 for a same word, -2 for another) is so far below its best. Below 80 percent, or
    with other masks, overlaps can be missed."""

    min_words: int = 13
    percent: int = 80
    drop: int = 7
    masks: tuple[str, ...] = MASKS


def seed_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """The hash of each window under a mask; none if the text is shorter than the mask."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, int(mask, 2), np.uint64)
    with np.errstate(over="ignore"):
        for k, bit in enumerate(mask):
            if bit == "1":
                out = (out ^ words[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
                out ^= out >> np.uint64(29)
    return out


@dataclass
class Index:
    """The seeds of a block of items, sorted by hash, behind a table of bits by the hashes' upper bits."""

    how: Overlap
    ids: list[int | None] = field(default_factory=list)
    words: list[np.ndarray] = field(default_factory=list)

    def masks_of(self, length: int) -> tuple[str, ...]:
        return SHORT_MASKS.get(length, self.how.masks)

    def build(self) -> "Index":
        self.masks = sorted({m for w in self.words if len(w) for m in self.masks_of(len(w))})
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.flat = np.concatenate([np.empty(0, np.uint64), *self.words])
        # how many same words an overlap with an item has at least
        self.least = -(-self.how.percent * np.minimum(self.how.min_words, self.size) // 100)
        hashes, items, places = [], [], []
        for i, w in enumerate(self.words):
            for mask in self.masks_of(len(w)) if len(w) else ():
                h = seed_hashes(w, mask)
                hashes.append(h)
                items.append(np.full(len(h), i, np.int64))
                places.append(np.arange(len(h)))
        h = np.concatenate([np.empty(0, np.uint64), *hashes])
        order = np.argsort(h, kind="stable")
        self.hashes, self.items, self.places = h[order], np.concatenate([np.empty(0, np.int64), *items])[order], np.concatenate([np.empty(0, np.int64), *places])[order]
        self.shift = np.uint64(64 - max(22, (16 * len(h)).bit_length()))
        self.table = np.zeros(1 << (64 - int(self.shift)), bool)
        self.table[(self.hashes >> self.shift).astype(np.int64)] = True
        return self

    def _diagonals(self, words: np.ndarray) -> np.ndarray:
        """Item and shift of each diagonal on which a hit has enough same words around it, once each. An overlap with the
        percentage holds one of fewer than twice min_words words that has it too, and a hit within that."""
        found: list[np.ndarray] = []
        reach = 2 * self.how.min_words - 1
        around = np.arange(-reach, reach + max(map(len, self.masks), default=0))
        for mask in self.masks:
            h = seed_hashes(words, mask)
            at = np.flatnonzero(self.table[(h >> self.shift).astype(np.int64)])
            if not len(at):
                continue
            low, high = np.searchsorted(self.hashes, h[at], "left"), np.searchsorted(self.hashes, h[at], "right")
            some = np.flatnonzero(high > low)
            at, low, size = at[some], low[some], (high - low)[some]
            # places with very many hits are looked at in parts of bounded size
            total = np.cumsum(size)
            for begin in range(0, int(total[-1]) if len(total) else 0, HITS):
                hit = np.arange(begin, min(begin + HITS, int(total[-1])))
                row = np.searchsorted(total, hit, "right")
                k = low[row] + hit - (total[row] - size[row])
                found.append(self._worth(words, self.items[k], at[row] - self.places[k], at[row], around))
                if len(found) > 64:
                    found = [np.unique(np.concatenate(found))]
        key = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        return np.stack((key >> 34, (key & (1 << 34) - 1) - (1 << 33)), axis=1)

    def _worth(self, words: np.ndarray, item: np.ndarray, shift: np.ndarray, place: np.ndarray, around: np.ndarray) -> np.ndarray:
        """Those of the hits' diagonals (item and shift as one number) that have enough same words around a hit. Of texts
        that repeat themselves many hits lie on few diagonals, which are then cheaper to search than the hits."""
        key = item << 34 | shift + (1 << 33)
        once = np.unique(key)
        if 8 * len(once) < len(key):
            return once
        keep = np.zeros(len(key), bool)
        for low in range(0, len(place), 4096):
            part = slice(low, low + 4096)
            x = place[part, None] + around
            y = x - shift[part, None]
            inside = (x >= 0) & (x < len(words)) & (y >= 0) & (y < self.size[item[part]][:, None])
            same = inside & (words[np.where(inside, x, 0)] == self.flat[np.where(inside, y + self.first[item[part]][:, None], 0)])
            keep[part] = same.sum(axis=1) >= self.least[item[part]]
        return np.unique(key[keep])

    def overlaps(self, words: np.ndarray) -> list[tuple]:
        """Verified overlaps of a document with the items."""
        found = []
        for item, shift in self._diagonals(words).tolist():
            w = self.words[item]
            low, high = max(0, shift), min(len(words), shift + len(w))
            same = words[low:high] == w[low - shift : high - shift]
            for a, b in self._stretches(same, self._hits(same, self.masks_of(len(w))), min(self.how.min_words, len(w))):
                found.append((self.ids[item], low + a, low + b, low + a - shift, low + b - shift, int(same[a:b].sum())))
        return found

    @staticmethod
    def _hits(same: np.ndarray, masks: tuple[str, ...]) -> list[int]:
        """Where a mask's picked words are all the same."""
        out = np.zeros(len(same), bool)
        for mask in masks:
            n = len(same) - len(mask) + 1
            if n > 0:
                out[:n] |= np.logical_and.reduce([same[k : k + n] for k, c in enumerate(mask) if c == "1"])
        return np.flatnonzero(out).tolist()

    def _stretches(self, same: np.ndarray, hits: list[int], need: int) -> list[tuple[int, int]]:
        """Start and end of a diagonal's overlaps. A hit's best stretch is one if enough of its words are the same, else
        what is within it; then what is left between them (the extension ends at a drop, an overlap needn't)."""
        out, end = [], 0
        for at in hits:
            if at < end:
                continue
            a, b = self._extend(same, at)
            end = max(b, at + 1)
            if b - a >= need:
                out += [(a, b)] if 100 * int(same[a:b].sum()) >= self.how.percent * (b - a) else self._within(same, a, b, need)
        edge = 0
        for a, b in [*sorted(set(out)), (len(same), len(same))]:
            out += self._within(same, edge, a, need)
            edge = max(edge, b)
        return sorted(set(out))

    def _within(self, same: np.ndarray, low: int, high: int, need: int) -> list[tuple[int, int]]:
        """The longest stretch of `need` words or more with the percentage, and so on at both sides of it. Unlike words at its
        ends go, down to `need`."""
        out, todo = [], [(low, high)]
        while todo:
            low, high = todo.pop()
            n = high - low
            if n < need or n <= 0:
                continue
            # a stretch has the percentage where this sum is no smaller at its end than at its start
            part = same[low:high]
            total = np.concatenate(([0], np.cumsum(np.where(part, 100 - self.how.percent, -self.how.percent))))
            begin, end = total[:-1], total[1:]
            # the last end of each start: from there on no end is as high
            last = n - np.searchsorted(np.maximum.accumulate(end[::-1]), begin, "left")
            size = last - np.arange(n)
            a = int(size.argmax())
            b = a + int(size[a])
            if b - a < need:
                continue
            x, y = a, b
            while y - x > need and not part[y - 1]:
                y -= 1
            while y - x > need and not part[x]:
                x += 1
            out.append((low + x, low + y))
            todo += [(low, low + a), (low + b, high)]
        return out

    def _extend(self, same: np.ndarray, k: int) -> tuple[int, int]:
        """Start and end of the best stretch of a diagonal around a hit."""
        step = np.where(same, 1, -2)

        def reach(steps: np.ndarray) -> int:
            score = np.cumsum(steps)
            best = np.maximum.accumulate(np.maximum(score, 0))
            over = np.flatnonzero(best - score > self.how.drop)
            score = score[: over[0]] if len(over) else score
            return int(score.argmax()) + 1 if len(score) and score.max() > 0 else 0

        return k - reach(step[:k][::-1]), k + reach(step[k:])


def _blocks(benchmark: DataFrame, how: Overlap, block_words: int) -> Iterator[Index]:
    index, n = Index(how), 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        w = word_hashes(row.text or "")
        if n and n + len(w) > block_words:
            yield index.build()
            index, n = Index(how), 0
        index.ids.append(row.item_id)
        index.words.append(w)
        n += len(w)
    yield index.build()


def overlaps(docs: DataFrame, benchmark: DataFrame, how: Overlap = Overlap(), block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs (doc_id, text), benchmark (item_id, text) -> a row for each verified overlap: doc_id, item_id, and its first
    word and the word behind its last one in both, with the number of words that are the same.

    Words are what white space separates, A-Z in lower case. Null or empty texts overlap nothing. Rows that share an id are
    compared each; null ids come back null. Other columns are ignored. Without documents or items the result is empty.
    """

    def against(index: Index) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in common.text_slices(batches):
                out = [(d, *x) for d, t in zip(batch.column("doc_id").to_pylist(), common.texts_of(batch), strict=True) for x in index.overlaps(word_hashes(t))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 7)], names=[c.split()[0] for c in OVERLAP.split(", ")])

        return docs.select("doc_id", "text").mapInArrow(run, OVERLAP)

    return reduce(DataFrame.unionAll, _each_written(_blocks(benchmark, how, block_words), against))


def _each_written(blocks: Iterator[Index], make: Callable[[Index], DataFrame]) -> Iterator[DataFrame]:
    """make(block) for each block. All but a single block's tables are written, so that the driver holds one block at a time."""
    index, following = next(blocks), next(blocks, None)
    if following is None:
        yield make(index)
        return
    while index is not None:
        yield common.materialize(make(index), "overlaps")
        index, following = following, next(blocks, None)


def decontaminate(docs: DataFrame, benchmark: DataFrame, how: Overlap = Overlap(), block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs that overlap no item, with all their columns. Repeated rows stay or go alike; null and empty texts
    stay; without items all rows stay."""
    schema = docs.schema
    rows = [docs]

    def without(index: Index) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in common.text_slices(batches):
                yield batch.filter(pa.array([not index.overlaps(word_hashes(t)) for t in common.texts_of(batch)], pa.bool_()))

        return rows[-1].mapInArrow(run, schema)

    for kept in _each_written(_blocks(benchmark, how, block_words), without):
        rows.append(kept)
    return rows[-1]
