"""Document fingerprints by winnowing.

Rolling hashes of all k-grams of code points; of each window of w hashes the smallest is chosen, the rightmost of equal
ones; its position is kept. Any passage of w + k - 1 code points or more that two texts share gives both a common hash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Hashes of a window, where none is asked for.
WINDOW = 16
_BASE = np.uint64(0x2545F4914F6CDD1D)
_INVERSE = np.uint64(pow(0x2545F4914F6CDD1D, -1, 1 << 64))
_powers: list[np.ndarray] = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def _table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse (modulo 2^64)."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            for k, base in enumerate((_BASE, _INVERSE)):
                factors = np.full(size, base, np.uint64)
                factors[0] = 1
                _powers[k] = np.multiply.accumulate(factors)
    return _powers[0][:n], _powers[1][:n]


@dataclass(frozen=True)
class Winnowing:
    """gram: code points of a hashed gram. window: hashes of a window; none: WINDOW, and fewer for a text of which half
    would be below the guarantee (the minimum of a window is that of the narrower ones in it, so both match as before)."""

    gram: int = 24
    window: int | None = None

    @property
    def guarantee(self) -> int:
        """A shared passage of so many code points gives a shared hash."""
        return self.gram + (self.window or WINDOW) - 1

    def window_of(self, n: int) -> int:
        """The window for a text of n code points."""
        return self.window or max(1, min(WINDOW, (n + 1) // 2 - self.gram + 1))

    def choose(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code points -> the chosen 32-bit hashes and their positions, ascending. A text shorter than a gram is one gram;
        fewer hashes than a window are one window."""
        n = len(points)
        if not n:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        k = min(self.gram, n)
        power, inverse = _table(n + 1)
        with np.errstate(over="ignore"):
            # sums of c[i] / base^i: a gram's share, moved to its own start, depends on nothing before it
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((points.astype(np.uint64) + np.uint64(1)) * inverse[:n])))
            h = (sums[k:] - sums[:-k]) * power[: n - k + 1]
            h ^= h >> np.uint64(31)
            h *= np.uint64(0x9E3779B97F4A7C15)
        if k < self.gram:
            h += np.uint64(k)
        m = len(h)
        # the hash above, what counts down with the position below: the smallest is the rightmost of the smallest hashes
        key = h & np.uint64(0xFFFFFFFF00000000) | (np.uint64(0xFFFFFFFF) - np.arange(m, dtype=np.uint64))
        span, window = 1, min(self.window_of(n), m)
        while span < window:
            step = min(span, window - span)
            key = np.minimum(key[: len(key) - step], key[step:])
            span += step
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
        return (key >> np.uint64(32)).astype(np.uint32), np.int64(0xFFFFFFFF) - (key & np.uint64(0xFFFFFFFF)).astype(np.int64)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def printed(hashes: np.ndarray, positions: np.ndarray) -> str:
    """The fingerprint as text: hash@position, in hexadecimal, in order."""
    return ",".join([f"{h:08x}@{p:x}" for h, p in zip(hashes.tolist(), positions.tolist(), strict=True)])


def parsed(fingerprint: str) -> list[tuple[int, int]]:
    return [(int(h, 16), int(p, 16)) for h, p in (x.split("@") for x in fingerprint.split(",") if x)]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of the distinct hashes; 1 for two empty fingerprints."""
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def matches(a: str, b: str) -> list[tuple[int, int]]:
    """Where two fingerprints hold the same hash: pairs of positions."""
    where: dict[int, list[int]] = {}
    for h, p in parsed(b):
        where.setdefault(h, []).append(p)
    return [(p, q) for h, p in parsed(a) for q in where.get(h, [])]


def fingerprints(docs: DataFrame, how: Winnowing = Winnowing()) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_chars, fingerprint. No shuffle. Null text: an empty one, its fingerprint too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.text_slices(batches):
            texts = common.texts_of(batch)
            prints = [printed(*how.choose(code_points(t))) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(prints, pa.string())], names=["doc_id", "n_chars", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def edited_fingerprints(docs: DataFrame, how: Winnowing = Winnowing()) -> DataFrame:
    """Each text's fingerprint beside those of its edited text and of the next document.

    The next document has the next smaller doc_id (after the smallest: the largest). The edited text has the last
    floor(n / 2) code points replaced by as many of the next one's first (or all of them). Null text: an empty one. Rows
    that share a doc_id follow one another in order of their texts; null doc_ids come last. One row is its own next.

    Texts are dealt by ranges of doc_id, in one shuffle; the row that a range's last row needs from the next range is
    dealt to both. The driver sees a row for each range.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = rows.select("doc_id")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = sorted(set(ids.approxQuantile("doc_id", [k / n for k in range(1, n)], 1 / (8 * n)))) if n > 1 else []
    cuts = [int(c) for c in cuts]
    # range 0 holds the largest ids; a null is below all. Cuts are counted in two steps, by groups of about the square
    # root of their number, so a row isn't held against all of them.
    group = max(1, math.isqrt(len(cuts)))
    groups = [cuts[k : k + group] for k in range(0, len(cuts), group)]
    below = lambda values: F.size(F.filter(values, lambda c: c < F.col("doc_id")))
    longs = lambda values: F.array(*[F.lit(v).cast("long") for v in values])
    if cuts:
        whole = below(longs([g[-1] for g in groups]))
        inside = F.greatest(F.lit(0), F.coalesce(below(F.get(F.array(*map(longs, groups)), whole)), F.lit(0)))
        rank = F.greatest(F.lit(0), F.lit(len(cuts)) - (whole * group + inside))
    else:
        rank = F.lit(0)
    part = F.when(F.col("doc_id").isNull(), F.lit(len(cuts))).otherwise(rank).cast("int").alias("part")
    # the first id of each range that has rows goes to the one before it too, that of the first to the last
    firsts = ids.select("doc_id", part).groupBy("part").agg(F.max("doc_id").alias("first")).orderBy("part").collect()
    first, before = [None] * (len(cuts) + 1), [0] * (len(cuts) + 1)
    for k, r in enumerate(firsts):
        first[r.part], before[r.part] = r.first, firsts[k - 1].part
    other = F.when(F.col("doc_id").eqNullSafe(F.get(longs(first), part)), F.get(F.array(*[F.lit(v) for v in before]), part))
    own = rows.select("doc_id", "text", part, other.alias("other"))
    dealt = own.select("doc_id", "text", F.explode(F.when(F.col("other").isNull(), F.array(F.struct("part", F.lit(False).alias("tail")))).otherwise(F.array(F.struct("part", F.lit(False).alias("tail")), F.struct(F.col("other").alias("part"), F.lit(True).alias("tail"))))).alias("at"))
    dealt = dealt.select("doc_id", "text", "at.part", "at.tail").repartitionById(len(cuts) + 1, F.col("part"))
    dealt = dealt.sortWithinPartitions("part", "tail", F.desc_nulls_last("doc_id"), "text")

    def edit(text: str, follower: str) -> str:
        half = len(text) // 2
        return text[: len(text) - half] + follower[:half]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # the row that waits for its follower
        where = None
        for batch in common.text_slices(batches):
            out = []
            for d, text, part, tail in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "part", "tail")), strict=True):
                if part != where:
                    last, where = None, part
                elif last is None and tail:
                    continue  # only the first of several equal ids follows
                mine = how.choose(code_points(text))
                if last is not None:
                    ld, lt, lh = last
                    changed = edit(lt, text)
                    theirs = how.choose(code_points(changed))
                    out.append((ld, len(lt), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), printed(*lh), printed(*theirs), likeness(lh[0], theirs[0]), likeness(lh[0], mine[0])))
                last = None if tail else (d, text, mine)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 7, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
