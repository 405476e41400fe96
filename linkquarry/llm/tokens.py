"""Byte-pair token ids of whole texts.

The pre-tokenizer of byte-level BPE always starts a new piece at a space or a line feed that is followed by a visible
character, and looks at nothing before it. So a text's ids are the ids of the pieces between such places put together.
Pieces are found in the bytes of many texts at once and looked up by all their bytes in a table; only new ones go through the
tokenizers library. That gives the library's ids at several times its speed on whole texts.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable

import numpy as np

#: A line feed or space and a word of Latin letters, which the pre-tokenizer leaves whole, and the ASCII signs after it, which it takes on their own
_WORD = re.compile(r"\n?( ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f]+)([!-/:-@\[-`{-~]*)")
#: by a character's first byte: whether it's surely visible. C2, E1, E2 and E3 have spaces among theirs.
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = _VISIBLE[0xC3:0xE1] = _VISIBLE[0xE4:0xF5] = True
#: Pieces of at most so many bytes are numbers; their length fills the last byte.
_SHORT = 23
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _byte_symbols() -> dict[int, str]:
    """The character by which byte-level BPE writes each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Table:
    """Byte strings of at most _SHORT bytes, as rows of three numbers, to numbers from 0. Open addressing; rows are compared
    whole, so no two share a number."""

    def __init__(self, most: int) -> None:
        # room for all at once: what isn't written takes no memory, and nothing is copied
        self.rows, self.value, self.n = np.empty((3, most), np.uint64), np.empty(most, np.int32), 0
        self._new_slots(1 << 16)

    def _new_slots(self, size: int) -> None:
        self.slots = np.full(size, -1, np.int32)
        self._place(np.arange(self.n))

    def _slot(self, rows: np.ndarray) -> np.ndarray:
        h = rows[0] * np.uint64(0x9E3779B97F4A7C15)
        h ^= rows[1] * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= rows[2] * np.uint64(0x165667B19E3779F9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return (h >> np.uint64(65 - len(self.slots).bit_length())).view(np.int64)

    def _place(self, which: np.ndarray) -> None:
        at = self._slot(self.rows[:, which])
        while len(which):
            free = self.slots[at] < 0
            self.slots[at[free]] = which[free]
            left = self.slots[at] != which
            which, at = which[left], (at[left] + 1) & (len(self.slots) - 1)

    def find(self, rows: np.ndarray) -> np.ndarray:
        """The value of each column of `rows`, -1 where there is none."""
        out = np.full(rows.shape[1], -1, np.int64)
        todo, at = np.arange(rows.shape[1]), self._slot(rows)
        while len(todo):
            k = self.slots.take(at)
            some = np.flatnonzero(k >= 0)
            k, todo, at = k.take(some), todo.take(some), at.take(some)
            hit = self.rows[0].take(k) == rows[0].take(todo)
            for row, asked in zip(self.rows[1:], rows[1:], strict=True):
                hit &= row.take(k) == asked.take(todo)
            out[todo.compress(hit)] = self.value.take(k.compress(hit))
            miss = np.flatnonzero(~hit)
            todo, at = todo.take(miss), (at.take(miss) + 1) & (len(self.slots) - 1)
        return out

    def add(self, rows: np.ndarray, value: np.ndarray) -> None:
        """Takes distinct rows that aren't there."""
        n = self.n + rows.shape[1]
        while n > self.rows.shape[1]:
            self.rows = np.concatenate((self.rows, np.empty_like(self.rows)), axis=1)
            self.value = np.concatenate((self.value, np.empty_like(self.value)))
        self.rows[:, self.n : n], self.value[self.n : n] = rows, value
        which, self.n = np.arange(self.n, n), n
        if 2 * n > len(self.slots):
            self._new_slots(1 << (2 * n).bit_length())
        else:
            self._place(which)


class PieceEncoder:
    """texts -> ids. It knows at most about `most_entries` pieces and `most_ids` ids of theirs, then starts anew. A text with a
    special token's string goes through the library whole, which gives that string the token's id."""

    def __init__(self, path: str, most_entries: int = 1_500_000, most_ids: int = 12_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.most_entries, self.most_ids = most_entries, most_ids
        self.symbols = _byte_symbols()
        #: by id: whether the token's first byte is a space or a line feed
        self.leads = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.leads[i] = token.startswith(("\u0120", "\u010a"))
        self.line_feed = self._whole("\n").tobytes()
        self._forget()

    def _forget(self) -> None:
        room = self.most_entries + (1 << 18)  # a batch more
        self.short, self.long, self.signs = _Table(room), {}, {}
        self.ids, self.start, self.size = np.empty(self.most_ids + (1 << 20), np.uint32), np.empty(room, np.int32), np.empty(room, np.int32)
        self.n_ids = self.n_pieces = 0

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _learn(self, pieces: list[str], words: list[re.Match | None], stems: np.ndarray) -> np.ndarray:
        """Encodes new pieces; the number of each. `stems` has the numbers of what stands before a word's signs."""
        known: list[bytes] = [b""] * len(pieces)
        spaced, stem = [], iter(zip(self.start[stems].tolist(), self.size[stems].tolist(), strict=True))
        for k, (piece, m) in enumerate(zip(pieces, words, strict=True)):
            if m and m[2]:
                at, n = next(stem)
                known[k] = self.ids[at : at + n].tobytes() + self._signs(m[2])
            elif m:  # one piece of the pre-tokenizer, but for a line feed, which is another: the library's model has its ids
                symbols = m[1].encode().decode("latin-1").translate(self.symbols)
                known[k] = self.line_feed * (piece[0] == "\n") + array("I", [t.id for t in self.model.tokenize(symbols)]).tobytes()
            elif piece[0] == " " and " " not in piece[1:] and "\n" not in piece:
                spaced.append(k)
            else:
                known[k] = self._whole(piece).tobytes()
        # pieces with no space but the leading one go through the library as one text, in whose ids each starts at the next
        # token that starts so
        for k in range(0, len(spaced), 512):
            part = spaced[k : k + 512]
            ids = self._whole("".join([pieces[i] for i in part]))
            at = np.flatnonzero(self.leads[ids])
            assert len(at) == len(part)
            for i, x in zip(part, np.split(ids, at[1:]), strict=True):
                known[i] = x.tobytes()
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        return self._keep(np.frombuffer(b"".join(known), np.uint32), sizes)

    def _signs(self, signs: str) -> bytes:
        out = self.signs.get(signs)
        if out is None:
            out = self.signs[signs] = self._whole(signs).tobytes()
        return out

    def _keep(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        while self.n_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.empty_like(self.ids)))
        while self.n_pieces + len(sizes) > len(self.size):
            self.start, self.size = (np.concatenate((x, np.empty_like(x))) for x in (self.start, self.size))
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        at = np.arange(self.n_pieces, self.n_pieces + len(sizes))
        self.size[at] = sizes
        self.start[at] = self.n_ids + np.cumsum(sizes) - sizes
        self.n_ids += len(ids)
        self.n_pieces += len(sizes)
        return at

    def _pieces(self, raw: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each piece starts in the texts' bytes, and its length."""
        data = np.frombuffer(raw, np.uint8)
        starts = (data == 0x20) | (data == 0x0A)
        at = np.flatnonzero(starts[:-1])
        starts[at] = _VISIBLE.take(data.take(at + 1))
        starts[ends[ends > 0] - 1] = False
        first = np.concatenate(([0], ends[:-1]))
        starts[first[first < ends]] = True
        begin = np.flatnonzero(starts)
        return begin, np.diff(begin, append=len(raw))

    def _codes(self, raw: bytes, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The number of each piece."""
        out = np.empty(len(begin), np.int64)
        short = size <= _SHORT
        every = short.all()
        s, n = (begin, size) if every else (begin[short], size[short])
        data = np.frombuffer(raw + bytes(40 - len(raw) % 8), np.uint64)
        word, shift = s >> 3, (s & 7).astype(np.uint64) << np.uint64(3)
        back = np.uint64(64) - shift
        rows, low = np.empty((3, len(s)), np.uint64), data.take(word)
        for k in range(3):
            high = data.take(word + (k + 1))
            rows[k] = (low >> shift | high << back) & _MASK.take(n - 8 * k, mode="clip")  # a shift by 64 gives 0
            low = high
        rows[2] |= n.astype(np.uint64) << np.uint64(56)
        found = self.short.find(rows)
        fresh = np.flatnonzero(found < 0)
        if len(fresh):
            first, number = self._distinct(raw, s[fresh], n[fresh])
            first = fresh[first]
            codes = self._new(raw, s[first], n[first], lambda k, c: self.short.add(rows[:, first[k]], c))
            found[fresh] = codes[number]
        if every:
            return found
        out[short] = found
        which = np.flatnonzero(~short)
        s, n = begin[which], size[which]
        first, number = self._distinct(raw, s, n)
        texts = [raw[x:y] for x, y in zip(s[first].tolist(), (s + n)[first].tolist(), strict=True)]
        codes = np.array([self.long.get(x, -1) for x in texts], np.int64)
        fresh = np.flatnonzero(codes < 0)
        if len(fresh):
            codes[fresh] = self._new(raw, s[first[fresh]], n[first[fresh]], lambda k, c: self.long.update((texts[fresh[i]], x) for i, x in zip(k.tolist(), c.tolist(), strict=True)))
        out[which] = codes[number]
        return out

    def _distinct(self, raw: bytes, s: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pieces the place of each different one's first, and which one each is."""
        seen: dict[bytes, int] = {}
        number = [seen.setdefault(raw[x:y], len(seen)) for x, y in zip(s.tolist(), (s + n).tolist(), strict=True)]
        return np.unique(number, return_index=True)[1], np.array(number, np.int64)

    def _new(self, raw: bytes, s: np.ndarray, n: np.ndarray, add: Callable[[np.ndarray, np.ndarray], None]) -> np.ndarray:
        """The numbers of new pieces, all different, which `add` puts down. Words with signs come last, as they take the ids of
        the piece without them."""
        pieces = [raw[x:y].decode() for x, y in zip(s.tolist(), (s + n).tolist(), strict=True)]
        words = [_WORD.fullmatch(p) for p in pieces]
        signs = np.array([len(m[2]) if m else 0 for m in words], np.int64)
        codes = np.empty(len(pieces), np.int64)
        for k in (np.flatnonzero(signs == 0), np.flatnonzero(signs)):
            if len(k):
                stems = self._codes(raw, s[k], (n - signs)[k]) if signs[k[0]] else np.empty(0, np.int64)
                codes[k] = self._learn([pieces[i] for i in k], [words[i] for i in k], stems)
                add(k, codes[k])
        return codes

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's end."""
        if self.n_pieces > self.most_entries or self.n_ids > self.most_ids:
            self._forget()
        whole = {k: self._whole(t) for k, t in enumerate(texts) if any(x in t for x in self.special)}
        each = [b"" if k in whole else t.encode() for k, t in enumerate(texts)]
        raw = b"".join(each)
        ends = np.cumsum([len(x) for x in each], dtype=np.int64)
        out, reach = np.empty(0, np.uint32), np.zeros(1, np.int64)
        begin = np.empty(0, np.int64)
        if raw:
            begin, size = self._pieces(raw, ends)
            code = self._codes(raw, begin, size)
            size = self.size.take(code).astype(np.int64)
            reach = np.concatenate((reach, np.cumsum(size)))
            at = np.repeat(self.start.take(code) - reach[:-1], size)
            at += np.arange(len(at))
            out = self.ids.take(at)
        ends = reach[np.searchsorted(begin, ends)]
        if whole:
            parts = np.split(out, ends[:-1])
            parts = [whole.get(k, x) for k, x in enumerate(parts)]
            out, ends = np.concatenate(parts), np.cumsum([len(x) for x in parts], dtype=np.int64)
        return out, ends

    def each(self, texts: list[str]) -> list[np.ndarray]:
        ids, ends = self.encode(texts)
        return np.split(ids, ends[:-1]) if texts else []


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder for each tokenizer file in a worker process."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
