"""Token-id output as grammar-compressed binary blocks (Re-Pair).

A block holds whole documents in order. Frequent neighbouring symbols are replaced by new ones (nonterminals), again and
again; no rule crosses the end of a document. Rules are stored with the number of ids that they expand to, so a reader
can go to any document, or to any id within one, without expanding what lies before it.

Block layout, little-endian: magic, version, symbol width in bytes, first nonterminal, and the numbers of documents, rules
and symbols; then for each document its id, whether the id is null, its first symbol and its first token; each rule's
left and right symbol and expansion length; the symbols.

Each replacement round takes many pairs at once. They're chosen in order of frequency such that no symbol is the left
one of a chosen pair and the right one of another, so that chosen occurrences never overlap; a pair of equal symbols is
replaced from the left in each run. Rounds end when no pair pays for a rule, or when symbols of 16 bits run out.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common, tokens

MAGIC = b"LQRP"
HEAD = struct.Struct("<4sHHIIII")
BLOCK_IDS = 1 << 19
END_ID = 2
#: A rule takes eight bytes, an occurrence saves two: so many occurrences of a pair pay for it.
PAYS = 5
BLOCK_SCHEMA = "part int, block int, part_start long, n_docs long, n_ids long, body binary"


#: An occurrence of a pair whose symbols may take more than 16 bits.
_WIDE = np.dtype([("pair", "u8"), ("at", "u4")])


def _occurrences(left: np.ndarray, right: np.ndarray, at: np.ndarray, wide: bool) -> np.ndarray:
    """Pairs and their places as values that sort by pair, then by place: numbers of 64 bits unless symbols are wide."""
    if wide:
        out = np.empty(len(at), _WIDE)
        out["pair"], out["at"] = left.astype(np.uint64) << np.uint64(32) | right, at
        return out
    out = left.astype(np.uint64)
    for bits, low in ((16, right), (32, at.astype(np.uint64))):
        out <<= np.uint64(bits)
        out |= low
    return out


def _places(held: np.ndarray, wide: bool) -> np.ndarray:
    return held["at"].astype(np.int64) if wide else (held & np.uint64(0xFFFFFFFF)).view(np.int64)


def _spans(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    out = np.arange(int(count.sum()))
    out += np.repeat(first - np.cumsum(count) + count, count)
    return out


def _frequent(pair: np.ndarray, min_count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted pairs those that occur min_count times: the pair, its first place in the order, its count."""
    # where a sorted pair equals the one min_count - 1 places on, it's frequent: only those places are looked at
    lag = min_count - 1
    again = np.flatnonzero(pair[lag:] == pair[: max(0, len(pair) - lag)])
    seen = pair.take(again)
    at = np.flatnonzero(np.concatenate((np.ones(min(1, len(seen)), bool), seen[1:] != seen[:-1])))
    return seen.take(at), again.take(at), np.diff(np.append(at, len(seen))) + lag


def _chosen(left: np.ndarray, right: np.ndarray, count: np.ndarray, most: int, top: int) -> np.ndarray:
    """The pairs to replace this round, most frequent first, of pairs in ascending order with symbols below `top`."""
    order = np.argsort(-count if len(count) and count.max() >= 1 << 16 else (-count).astype(np.uint16), kind="stable")
    is_left, is_right, out = bytearray(top), bytearray(top), []
    lefts, rights = np.frombuffer(is_left, bool), np.frombuffer(is_right, bool)
    for k in range(0, len(order), 1024):  # those in conflict with earlier parts go at once
        part = order[k : k + 1024]
        a, b = left[part], right[part]
        part = part[~(rights[a] | lefts[b] | (a == b) & (lefts[a] | rights[b]))]
        for i, a, b in zip(part.tolist(), left[part].tolist(), right[part].tolist(), strict=True):
            if is_right[a] or is_left[b] or (a == b and (is_left[a] or is_right[b])):
                continue
            out.append(i)
            if len(out) == most:
                return np.array(out)
            is_left[a] = is_right[b] = 1
    return np.array(out, np.int64)


def compress(symbols: np.ndarray, first_of_doc: np.ndarray, first_rule: int, min_count: int = PAYS, most_rules: int | None = None, per_round: int = 1024, min_saving: float = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """symbols, and the place where each document starts -> symbols, starts, and the rules' left, right, length.
    Rounds go on until no pair pays for a rule; without most_rules as long as a symbol fits in 16 bits.

    Symbols stay at their places, with links to the next and the last one that's left. All occurrences of a pair come into
    being in one round, that which makes the younger of its symbols, and afterwards only go. So a pair that isn't frequent then
    never is, and a round sorts only the occurrences of pairs that were frequent and those that hold new symbols."""
    most_rules = max(0, (1 << 16) - first_rule) if most_rules is None else most_rules
    n, starts = len(symbols), first_of_doc.astype(np.int64)
    symbols = np.append(symbols, 0).astype(np.uint32)
    # neighbours within the document; n: none
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    inner = starts[(starts > 0) & (starts < n)]
    after[inner - 1] = after[max(0, n - 1) :] = before[inner] = before[0] = n
    top = max(int(symbols.max()) + 1, first_rule) + most_rules
    wide = top > 1 << 16
    half = 32 if wide else 16
    lefts, rights = [np.empty(0, np.uint32)], [np.empty(0, np.uint32)]
    length = np.ones(top, np.int64)
    gone = np.zeros(n + 1, bool)
    at = np.flatnonzero(after[:n] < n)
    held = _occurrences(symbols[at], symbols[at + 1], at, wide)
    first_new, last = first_rule, first_rule + most_rules
    while len(held) and first_new < last:
        held.sort()
        pair, first, count = _frequent(held["pair"] if wide else (held >> np.uint64(32)).astype(np.uint32), min_count)
        a, b = (pair >> half).astype(np.int64), (pair & (1 << half) - 1).astype(np.int64)
        k = _chosen(a, b, count, min(per_round, last - first_new), top)
        if not len(k):
            break
        left, right, times = a[k], b[k], count[k]
        at = _places(held.take(_spans(first[k], times)), wide)
        new = np.repeat(np.arange(first_new, first_new + len(k), dtype=np.uint32), times)
        if (left == right).any():  # of a run of equal symbols every other place starts a pair
            same = np.flatnonzero(np.repeat(left == right, times))
            apart = np.append(True, (after[at[same[:-1]]] != at[same[1:]]) | (new[same[:-1]] != new[same[1:]]))
            nth = np.arange(len(same)) - np.flatnonzero(apart)[np.cumsum(apart) - 1]
            odd = same[nth % 2 == 1]
            at, new = np.delete(at, odd), np.delete(new, odd)
        out = after.take(at)
        follows = after.take(out)
        symbols[at], after[at], before[follows], gone[out] = new, follows, at, True
        # a new symbol's pairs: with what follows it, and with an older symbol before it
        ahead, has_next = before.take(at), np.flatnonzero(follows < n)
        older = np.flatnonzero((ahead < n) & (symbols.take(ahead) < first_new))
        ahead = ahead.take(older)
        made = (_occurrences(new.take(has_next), symbols.take(follows.take(has_next)), at.take(has_next), wide), _occurrences(symbols.take(ahead), new.take(older), ahead, wide))
        # of the other frequent pairs those occurrences stay that lost neither symbol
        others = np.ones(len(count), bool)
        others[k] = False
        held = held.take(_spans(first[others], count[others]))
        gone[ahead] = True
        held = held.compress(~gone.take(_places(held, wide)))
        gone[ahead] = False
        held = np.concatenate((held, *made))
        length[first_new : first_new + len(k)] = length[left] + length[right]
        lefts.append(left.astype(np.uint32))
        rights.append(right.astype(np.uint32))
        first_new += len(k)
        if len(at) < min_saving * (n - np.count_nonzero(gone) + len(at)):
            break
    starts = starts - np.searchsorted(np.flatnonzero(gone), starts)  # less what went before each
    return symbols[:n][~gone[:n]], starts, np.concatenate(lefts), np.concatenate(rights), length[first_rule:first_new]


def encode_block(doc_ids: list[int | None], ids: list[np.ndarray], first_rule: int) -> bytes:
    sizes = np.array([len(x) for x in ids], np.int64)
    first_token = np.cumsum(sizes) - sizes
    symbols = np.concatenate(ids).astype(np.uint32) if ids else np.empty(0, np.uint32)
    symbols, starts, left, right, length = compress(symbols, first_token, first_rule)
    width = 2 if first_rule + len(left) <= 1 << 16 else 4
    kind = f"<u{width}"
    return b"".join((
        HEAD.pack(MAGIC, 1, width, first_rule, len(ids), len(left), len(symbols)),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], "u1").tobytes(),
        starts.astype("<u4").tobytes(), first_token.astype("<u8").tobytes(),
        left.astype(kind).tobytes(), right.astype(kind).tobytes(), length.astype("<u4").tobytes(), symbols.astype(kind).tobytes(),
    ))


class Block:
    """A reader of one block with random access."""

    def __init__(self, body: bytes):
        magic, version, width, self.first_rule, n, rules, size = HEAD.unpack_from(body)
        if magic != MAGIC or version != 1:
            raise ValueError("not a block of token ids")
        self.at, kind = HEAD.size, f"<u{width}"

        def take(dtype: str, count: int) -> np.ndarray:
            out = np.frombuffer(body, dtype, count, self.at)
            self.at += out.nbytes
            return out

        ids, null = take("<i8", n), take("u1", n)
        self.doc_ids = [None if x else int(d) for d, x in zip(ids, null, strict=True)]
        self.starts, self.first_token = take("<u4", n).astype(np.int64), take("<u8", n).astype(np.int64)
        self.left, self.right = take(kind, rules).astype(np.int64), take(kind, rules).astype(np.int64)
        self.length, self.symbols = take("<u4", rules).astype(np.int64), take(kind, size).astype(np.int64)
        #: by symbol: the number of its ids
        self.size = np.concatenate((np.ones(self.first_rule, np.int64), self.length))
        self.n_ids = int(self.lengths(self.symbols).sum())
        self._whole: tuple[np.ndarray, np.ndarray] | None = None

    def lengths(self, symbols: np.ndarray) -> np.ndarray:
        return self.size.take(symbols)

    def expansions(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all symbols, one after the other, and where each starts."""
        if self._whole is None:
            start = np.cumsum(self.size) - self.size
            out = np.empty(int(self.size.sum()), np.uint32)
            out[: self.first_rule] = np.arange(self.first_rule)
            # rules are filled as far as they refer to nothing later
            refers, k = np.maximum(self.left, self.right) - self.first_rule, 0
            while k < len(refers):
                later = refers[k:] >= k
                end = k + int(later.argmax()) if later.any() else len(refers)
                if end == k:
                    raise ValueError("a rule refers to itself or a later one")
                pairs = np.stack((self.left[k:end], self.right[k:end]), axis=1).ravel()
                at = int(start[self.first_rule + k])
                ids = out.take(_spans(start.take(pairs), self.size.take(pairs)))
                out[at : at + len(ids)] = ids
                k = end
            self._whole = out, start
        return self._whole

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        whole, start = self.expansions()
        return whole.take(_spans(start.take(symbols), self.size.take(symbols)))

    def document(self, k: int) -> np.ndarray:
        end = self.starts[k + 1] if k + 1 < len(self.starts) else len(self.symbols)
        return self.expand(self.symbols[self.starts[k] : end])

    def ids(self, k: int, first: int, count: int) -> np.ndarray:
        """count ids of document k from place `first`: only the symbols that hold them are expanded, by the rules that they need."""
        end = self.starts[k + 1] if k + 1 < len(self.starts) else len(self.symbols)
        symbols = self.symbols[self.starts[k] : end]
        reach = np.cumsum(self.lengths(symbols))
        a, b = np.searchsorted(reach, first, "right"), np.searchsorted(reach, first + count, "left") + 1
        begin = int(reach[a - 1]) if a else 0
        out, todo = [], symbols[a:b].tolist()[::-1]
        while todo and len(out) < first - begin + count:
            x = todo.pop() - self.first_rule
            if x < 0:
                out.append(x + self.first_rule)
            else:
                todo += (int(self.right[x]), int(self.left[x]))
        return np.array(out[first - begin : first - begin + count], np.uint32)


def write_blocks(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Encodes `docs` (doc_id, text) in ascending doc_id order and writes blocks as rows of a Parquet table: Spark's
    commit protocol makes each shard appear whole or not at all.

    Null text: an empty one, so the end id alone. Null doc_ids come first. Rows that share a doc_id are ordered by text
    and all kept. Other columns are ignored. A block holds whole documents; one longer than block_ids has its own.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc = TaskContext.get().partitionId(), tokens.encoder(tokenizer)
        first_rule = enc.tokenizer.get_vocab_size()
        doc_ids: list[int | None] = []
        held: list[np.ndarray] = []
        n = start = block = 0

        def out() -> pa.RecordBatch:
            body = encode_block(doc_ids, held, first_rule)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([start], pa.int64()), pa.array([len(held)], pa.int64()), pa.array([n], pa.int64()), pa.array([body], pa.binary())], names=["part", "block", "part_start", "n_docs", "n_ids", "body"])

        for batch in common.text_slices(batches, most=1 << 20):
            for d, ids in zip(batch.column("doc_id").to_pylist(), enc.each(common.texts_of(batch)), strict=True):
                ids = np.append(ids, np.uint32(end_id))
                if held and n + len(ids) > block_ids:
                    yield out()
                    start, block, n = start + n, block + 1, 0
                    doc_ids, held = [], []
                doc_ids.append(d)
                held.append(ids)
                n += len(ids)
        if held:
            yield out()

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(encode, BLOCK_SCHEMA).write.option("compression", "zstd").parquet(path)


def read_blocks(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """The documents of a table of blocks: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and the
    ids if asked for. Blocks are decoded independently; starts come from a sum over parts, a row for each."""
    schema = "part int, part_at long, doc_id long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start, body in zip(*(batch.column(c).to_pylist() for c in ("part", "part_start", "body")), strict=True):
                block = Block(body)
                whole = block.expand(block.symbols)
                ends = np.append(block.first_token[1:], len(whole))
                view = memoryview(whole.astype("<u4").tobytes())
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(block.first_token.tolist(), ends.tolist(), strict=True)]
                cols = [pa.array(np.full(len(ends), part, np.int32)), pa.array(start + block.first_token), pa.array(block.doc_ids, pa.int64()), pa.array(ends - block.first_token), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(block.first_token, len(whole)).astype(np.int32)), pa.array(whole.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names=["part", "part_at", "doc_id", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_first"))
    docs = blocks.select("part", "part_start", "body").mapInArrow(decode, schema)
    return docs.join(parts, "part").select("doc_id", (F.col("part_first") + F.col("part_at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def token_output(docs: DataFrame, tokenizer: str | None = None, path: str | None = None) -> DataFrame:
    """Writes the blocks to `path` (a new table in the shared folder if none is given) and reads them back."""
    spark = docs.sparkSession
    path = path or common.new_path(spark, "tokens")
    write_blocks(docs, path, tokenizer or tokens.default_tokenizer())
    return read_blocks(spark, path)
