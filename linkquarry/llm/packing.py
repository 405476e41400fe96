"""Packing of token ids into fixed-length sequences by cutting-stock column generation.

Each document's ids are cut every `capacity` ids; what remains at its end is an item of 1 to capacity ids. How many items
there are of each length (a histogram of at most `capacity` numbers, all that the driver sees) is the demand of a cutting-
stock problem: a linear program over patterns of lengths, whose columns are priced by a knapsack dynamic program. The
patterns are rounded to whole numbers and given to the items of each length by rank: first those that fill a sequence
exactly, then the fullest of the others. Of what is left a stream is laid end to end: it fills the gaps of those others,
cut where a gap is full, then sequences of its own, so at most one sequence isn't full; its ids go to sequences whose
lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common, tokens

CAPACITY = 1024
END_ID = 0
CHUNKS = "pid int, seq long, doc_id long, start long, length int, doc_tokens long, nth long, crc long, ids binary"


def knapsack(value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack over lengths 1..capacity with these values: the best sum for each size, and the last length."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for size in range(1, capacity + 1):
        got = best[size - 1 :: -1] + value[1 : size + 1] if size > 1 else value[1:2]
        k = int(got.argmax())
        best[size], last[size] = got[k], k + 1
        if best[size] <= best[size - 1]:
            best[size], last[size] = best[size - 1], 0
    return best, last


def column_generation(demand: np.ndarray, capacity: int, most_rounds: int = 120, a_round: int = 48, gap: float = 2e-3) -> list[tuple[dict[int, int], float]]:
    """Patterns with their (fractional) use for a demand by length (index: length; below capacity).

    The restricted master is solved by the revised simplex method, from a basis that pairs each length with its
    complement. One knapsack table prices columns for a round: for each length the best pattern that holds it; those
    that still price out enter, up to a_round. It ends when none does, when the bound that the knapsack gives is within
    `gap`, or after most_rounds; each end leaves a feasible solution."""
    lengths = np.flatnonzero(demand[:capacity])
    if not len(lengths):
        return []
    need = demand[lengths].astype(float)
    place = {int(r): i for i, r in enumerate(lengths)}
    patterns = [{int(r): int(capacity // r)} for r in lengths]
    for r in place:
        s = capacity - r
        if s in place and s != r and (demand[r], r) < (demand[s], s):
            patterns[place[r]] = {r: 1, s: 1}  # of each pair of complements the scarcer one's column
    # a pair's column stands in the place of its scarcer length, whose complement has a column of its own: the inverse is
    # known. Products are sums of few columns, without the threads of a linear algebra library in the driver
    inverse = np.diag([1 / p[int(r)] for r, p in zip(lengths, patterns, strict=True)])
    for r, p in zip(lengths.tolist(), patterns, strict=True):
        if len(p) == 2:
            s = capacity - r
            inverse[place[s], place[r]] = -1 / patterns[place[s]][s]
    use = np.maximum((inverse * need).sum(axis=1), 0)
    for _ in range(most_rounds):
        dual = inverse.sum(axis=0)
        value = np.full(capacity + 1, -1.0)
        value[lengths] = dual
        best, last = knapsack(value, capacity)
        if best[capacity] <= 1 + 1e-9 or use.sum() <= float(dual.clip(0) @ need) / best[capacity] * (1 + gap):
            break
        priced = dual + best[capacity - lengths]
        seen: set[tuple] = set()
        entered = 0
        for i in np.argsort(-priced):
            if priced[i] <= 1 + 1e-9 or entered == a_round:
                break
            pattern, size = {int(lengths[i]): 1}, capacity - int(lengths[i])
            while size:
                r = int(last[size])
                if r:
                    pattern[r] = pattern.get(r, 0) + 1
                size -= max(r, 1)
            if (name := tuple(sorted(pattern.items()))) in seen:
                continue
            seen.add(name)
            at, times = np.array([place[r] for r in pattern]), np.array(list(pattern.values()), float)
            worth = float(dual[at] @ times)
            if worth <= 1 + 1e-9:
                continue
            step = (inverse[:, at] * times).sum(axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                ratio = np.where(step > 1e-9, use / step, np.inf)
            out = int(ratio.argmin())
            theta = ratio[out]
            if not np.isfinite(theta):
                continue
            row = inverse[out] / step[out]
            inverse -= step[:, None] * row
            inverse[out] = row
            dual = dual + (1 - worth) * row
            use = np.maximum(use - theta * step, 0)
            use[out] = theta
            patterns[out] = pattern
            entered += 1
        if not entered:
            break
    return [(p, float(x)) for p, x in zip(patterns, use, strict=True) if x > 0]


def rounded(solution: list[tuple[dict[int, int], float]], demand: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns in whole numbers. Exactly filled ones are rounded down, then up in order of their fractions while items
    last; then the others, the fullest first, as long as the items that are left can fill their gaps."""
    left = demand.astype(np.int64).copy()
    fill = [sum(r * k for r, k in p.items()) for p, _ in solution]
    order = sorted(range(len(solution)), key=lambda i: (-fill[i], i))
    counts = [0] * len(solution)

    def take(i: int, n: int) -> None:
        counts[i] += n
        for r, k in solution[i][0].items():
            left[r] -= k * n

    exact = [i for i in order if fill[i] == capacity]
    for i in exact:
        take(i, int(solution[i][1]))
    for i in sorted(exact, key=lambda i: counts[i] - solution[i][1]):
        if all(left[r] >= k for r, k in solution[i][0].items()):
            take(i, 1)
    rest = int(left[:capacity] @ np.arange(capacity))  # ids that patterns with gaps and the stream share
    for i in order[len(exact) :]:
        n = min(int(np.ceil(solution[i][1])), rest // capacity, *(int(left[r]) // k for r, k in solution[i][0].items()))
        take(i, n)
        rest -= n * capacity
    assert (left >= 0).all()
    return [(p, n) for (p, _), n in zip(solution, counts, strict=True) if n]


@dataclass
class Layout:
    """Where the item of a length with a rank goes. Intervals of ranks by length: the rows length, first rank, items of
    that length a sequence, first sequence, place in the sequence. What lies beyond the last interval is the stream; the
    rows of gaps: first id of the stream, size of a gap, first sequence, place in the sequence."""

    capacity: int
    length: np.ndarray
    first: np.ndarray
    times: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    gap_at: np.ndarray
    gap_size: np.ndarray
    gap_sequence: np.ndarray
    gap_offset: np.ndarray
    given: np.ndarray  # by length: the ranks that patterns take
    left_base: np.ndarray  # by length: ids of left-over items of smaller lengths
    left_sequence: int
    left_ids: int  # of the stream beyond the gaps
    gap_ids: int

    @property
    def sequences(self) -> int:
        """How many sequences there are."""
        return self.left_sequence + self.left_ids // self.capacity + (self.left_ids % self.capacity).bit_count()


def layout(demand: np.ndarray, capacity: int) -> Layout:
    """demand: by length 0..capacity the number of items; those of full length are sequences of their own."""
    plan = [({capacity: 1}, int(demand[capacity]))] if demand[capacity] else []
    plan += rounded(column_generation(demand, capacity), demand, capacity)
    given = np.zeros(capacity + 1, np.int64)
    rows, gaps, sequence, gap_ids = [], [], 0, 0
    for pattern, n in plan:
        at = 0
        for r, k in sorted(pattern.items(), reverse=True):
            rows.append((r, given[r], k, sequence, at))
            given[r] += k * n
            at += r * k
        if at < capacity:
            gaps.append((gap_ids, capacity - at, sequence, at))
            gap_ids += n * (capacity - at)
        sequence += n
    rows.sort()
    table, holes = np.array(rows, np.int64).reshape(-1, 5), np.array(gaps, np.int64).reshape(-1, 4)
    left = (demand - given) * np.arange(capacity + 1)
    assert left.sum() >= gap_ids
    return Layout(capacity, *table.T.copy(), *holes.T.copy(), given, np.cumsum(left) - left, sequence, int(left.sum()) - gap_ids, gap_ids)


def _left_over(plan: Layout, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pieces of left-over items that start at these ids of the stream: item, start in it, length, sequence, offset."""
    c, rest = plan.capacity, plan.left_ids % plan.capacity
    tail = plan.left_ids - rest
    powers = [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]
    edges = tail + np.cumsum([0, *powers])  # the tail's sequences
    item, begin, end = np.arange(len(at)), at.copy(), at + length
    out = []
    while len(item):
        # in a gap
        in_gap = begin < plan.gap_ids
        low, high, sequence, base = (np.zeros(len(item), np.int64) for _ in range(4))
        g = np.searchsorted(plan.gap_at, begin[in_gap], "right") - 1
        nth = (begin[in_gap] - plan.gap_at[g]) // plan.gap_size[g] if len(g) else g
        low[in_gap] = plan.gap_at[g] + nth * plan.gap_size[g]
        high[in_gap] = low[in_gap] + plan.gap_size[g]
        sequence[in_gap], base[in_gap] = plan.gap_sequence[g] + nth, plan.gap_offset[g]
        # beyond the gaps: whole sequences, then the tail's
        x = begin[~in_gap] - plan.gap_ids
        in_tail = x >= tail
        k = np.searchsorted(edges, x, "right") - 1
        from_ = np.where(in_tail, edges[np.clip(k, 0, len(edges) - 1)], x // c * c)
        low[~in_gap] = from_ + plan.gap_ids
        high[~in_gap] = np.where(in_tail, edges[np.clip(k + 1, 0, len(edges) - 1)], from_ + c) + plan.gap_ids
        sequence[~in_gap] = plan.left_sequence + np.where(in_tail, tail // c + k, x // c)
        stop = np.minimum(end, high)
        out.append((item, begin - at[item], stop - begin, sequence, base + begin - low))
        more = stop < end
        item, begin, end = item[more], stop[more], end[more]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else tuple(np.empty(0, np.int64) for _ in range(5))


def chunk_documents(docs: DataFrame, tokenizer: str, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """One row for each cut of `capacity` ids and for what remains of each document: the part that made it and the rank
    `nth` among that part's chunks of equal length, the crc32 of its ids and the ids. No shuffle."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, enc = TaskContext.get().partitionId(), tokens.encoder(tokenizer)
        end, made, seq = np.uint32(end_id).tobytes(), np.zeros(capacity + 1, np.int64), 0
        for batch in common.text_slices(batches, most=1 << 20):
            rows: list[tuple] = []
            for d, whole in zip(batch.column("doc_id").to_pylist(), enc.each(common.texts_of(batch)), strict=True):
                raw = whole.astype("<u4").tobytes() + end
                total = len(raw) // 4
                for at in range(0, total, capacity):
                    ids = raw[4 * at : 4 * (at + capacity)]
                    n = len(ids) // 4
                    rows.append((pid, seq, d, at, n, total, int(made[n]), zlib.crc32(ids), ids))
                    made[n] += 1
                seq += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=[x.split()[0] for x in CHUNKS.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(cut, CHUNKS)


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Packs `docs` (doc_id, text) into sequences of at most `capacity` ids; a row for each piece: doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id, offset, and with_ids the ids (little-endian unsigned 32-bit).

    Null text: an empty one, so the end id alone. Rows that share a doc_id, or have none, are packed as rows of their own.
    Other columns are ignored. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    chunks = common.materialize(chunk_documents(docs, tokenizer or tokens.default_tokenizer(), end_id, capacity), "chunks")
    parts = common.materialize(chunks.groupBy("pid", "length").agg(F.count("*").alias("n")), "chunk-counts")
    demand = np.zeros(capacity + 1, np.int64)
    for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        demand[r.length] = r.n
    plan = layout(demand, capacity)

    base = parts.select("pid", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("pid")) - F.col("n")).alias("base"))
    items = chunks.select("pid", "seq", "doc_id", "start", "length", "doc_tokens", "crc", "nth").join(base, ["pid", "length"])
    items = items.select("pid", "seq", "doc_id", "start", "length", "doc_tokens", "crc", (F.col("base") + F.col("nth")).alias("rank"))
    schema = "pid int, seq long, doc_id long, chunk long, start long, length long, doc_tokens long, sequence_id long, offset long, crc long, whole boolean"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy().astype(np.int64), batch.column("rank").to_numpy()
            # the last interval of that length that starts at or before the rank
            key, find = plan.length * (1 << 48) + plan.first, length * (1 << 48) + rank
            by_pattern = rank < plan.given[length]
            a = np.flatnonzero(by_pattern)
            k = np.searchsorted(key, find[a], "right") - 1
            turn = rank[a] - plan.first[k] if len(a) else rank[a]
            seq_a = plan.sequence[k] + turn // plan.times[k] if len(a) else turn
            off_a = plan.offset[k] + turn % plan.times[k] * length[a] if len(a) else turn
            b = np.flatnonzero(~by_pattern)
            at = plan.left_base[length[b]] + (rank[b] - plan.given[length[b]]) * length[b]
            item, begin, size, seq_b, off_b = _left_over(plan, at, length[b])
            row = np.concatenate((a, b[item]))
            starts, sizes = np.concatenate((np.zeros(len(a), np.int64), begin)), np.concatenate((length[a], size))
            rows = batch.take(pa.array(row))
            chunk = rows.column("start").to_numpy()
            cols = [rows.column("pid"), rows.column("seq"), rows.column("doc_id"), rows.column("start"), pa.array(chunk + starts), pa.array(sizes), rows.column("doc_tokens"), pa.array(np.concatenate((seq_a, seq_b))), pa.array(np.concatenate((off_a, off_b))), rows.column("crc"), pa.array(sizes == length[row])]
            yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in schema.split(", ")])

    pieces = common.materialize(items.mapInArrow(place, schema), "pieces")
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
    key = ["pid", "seq", "chunk"]
    ids = chunks.select("pid", "seq", F.col("start").alias("chunk"), F.col("ids").alias("all_ids"))
    if with_ids:
        whole, cut = None, pieces
    else:
        whole, cut = pieces.filter("whole").withColumn("ids_crc32", F.col("crc")), pieces.filter("NOT whole")
    # a table of their own has a size that Spark knows before it plans the join: small ones are broadcast, so ids stay where they are
    cut = ids.join(cut if with_ids else common.materialize(cut, "cut-pieces"), key)
    cut = cut.withColumn("ids", F.expr("substring(all_ids, CAST(4 * (start - chunk) + 1 AS INT), CAST(4 * length AS INT))")).withColumn("ids_crc32", F.crc32("ids"))
    return (cut.select(*out) if whole is None else whole.select(*out).unionByName(cut.select(*out)))


def sequences(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (little-endian unsigned 32-bit), n_ids. A sequence has at most
    `capacity` pieces, so a group is bounded."""
    pieces = pack(docs, tokenizer, end_id, capacity, with_ids=True)
    rows = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_ids"), F.aggregate(rows, F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
