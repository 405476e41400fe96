"""The best sets by common tokens for each of many sets, exactly, block against block in Arrow batches.

Pairs that meet in a frequent token are too many to be rows, so a block of asked sets meets a block of held ones in a task,
which keeps each asked set's best. Tokens are numbers by falling frequency. The most frequent ones of a block are bits
beside each held set, the others lists of the sets that have them. What the first sets of a block reach bounds the others:
they come later in every tie, so they need more, and whoever has more must hold one of the tokens that are left when the
most frequent ones (as many as were reached) are taken away. Only lists of those are read, the bits tell the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Tokens that are bits.
BITS = 512
#: Held sets that are counted first, besides an eighth of the block.
FIRST = 4096


class Held:
    """A block of sets: their tokens one after the other, and how many each has. Its order decides ties."""

    def __init__(self, tokens: np.ndarray, sizes: np.ndarray):
        self.n = len(sizes)
        self.tokens, code = np.unique(tokens, return_inverse=True)
        owner = np.repeat(np.arange(self.n, dtype=np.int32), sizes)
        self.lists = owner[np.argsort(code, kind="stable")]
        self.at = np.concatenate(([0], np.cumsum(np.bincount(code, minlength=len(self.tokens)))))
        self.bits = np.zeros((BITS // 64, self.n), np.uint64)
        for t in range(min(BITS, len(self.tokens))):
            self.bits[t >> 6, self.lists[self.at[t] : self.at[t + 1]]] |= np.uint64(1 << (t & 63))

    def codes(self, tokens: np.ndarray) -> np.ndarray:
        """Of rising tokens those that the block has, as their places among its tokens."""
        if not len(self.tokens):
            return np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        return at[self.tokens[at] == tokens]

    def _listed(self, codes: np.ndarray) -> np.ndarray:
        if not len(codes):
            return np.zeros(self.n, np.int64)
        return np.bincount(np.concatenate([self.lists[self.at[t] : self.at[t + 1]] for t in codes.tolist()]), minlength=self.n)

    def _in_bits(self, codes: np.ndarray, where: slice | np.ndarray) -> np.ndarray | int:
        words: dict[int, int] = {}
        for t in codes.tolist():
            words[t >> 6] = words.get(t >> 6, 0) | 1 << (t & 63)
        return sum(np.bitwise_count(self.bits[w][where] & np.uint64(mask)).astype(np.int64) for w, mask in words.items())

    def best(self, tokens: np.ndarray, top: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """The places and scores of the `top` held sets with most of the tokens, at least `least` (from 1), equal ones by
        place; in order of place."""
        codes = self.codes(tokens)
        if len(codes) < least:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        frequent, rare = codes[codes < BITS], codes[codes >= BITS]
        listed = self._listed(rare)
        first = min(self.n, FIRST + self.n // 8)
        score = listed[:first] + self._in_bits(frequent, slice(0, first))
        reached = _cut(score, top)
        at = np.flatnonzero(score >= max(least, reached))
        score = score[at]
        need = max(least, reached + 1)
        if first < self.n and need <= len(codes):
            tail, middle = frequent[: need - 1], frequent[need - 1 :]
            if (self.at[middle + 1] - self.at[middle]).sum() > self.n * len(np.unique(frequent >> 6)) / 2:
                more = listed[first:] + self._in_bits(frequent, slice(first, self.n))
                new = np.flatnonzero(more >= need)
                more, new = more[new], new + first
            else:
                count = listed + self._listed(middle) if len(middle) else listed
                new = np.flatnonzero(count[first:] >= need - len(tail)) + first
                more = count[new] + self._in_bits(tail, new)
                new, more = new[more >= need], more[more >= need]
            at, score = np.concatenate((at, new)), np.concatenate((score, more))
        cut = _cut(score, top)
        above = int((score > cut).sum())
        keep = np.sort(np.concatenate((np.flatnonzero(score > cut), np.flatnonzero(score == cut)[: top - above])))
        return at[keep], score[keep]


def _cut(score: np.ndarray, top: int) -> int:
    """The score of place `top`; 0 if there are fewer."""
    if len(score) < top:
        return 0
    upto = np.cumsum(np.bincount(score)[::-1])
    return len(upto) - 1 - int(np.searchsorted(upto, top))


def matches(asked: Iterator[tuple[int, np.ndarray]], held: Held, numbers: np.ndarray, top: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """number of the asked set, number of the held set, score."""
    who, whom, scores = [], [], []
    for number, tokens in asked:
        at, score = held.best(tokens, top, least)
        who.append(np.full(len(at), number, np.int64))
        whom.append(numbers[at])
        scores.append(score)
    join = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
    return join(who), join(whom), join(scores)
