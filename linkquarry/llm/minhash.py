"""Near duplicates by min-max hashing, confirmed on full shingle sets.

Under each permutation both the smallest and the largest hash of a document's shingles are kept, so a signature of k
values takes k / 2 hash evaluations a shingle. Signatures are banded; documents that agree in a band are candidates.
Equal sets are one node, however many documents have them. Candidates are compared in rounds: each member of a bucket
with the bucket's smallest and largest node, a row for each such pair. Buckets that then still span several components are
compared in blocks within tasks, from which only confirmed links come. No bucket is cut short.

With 160 permutations and 64 bands of 5 values a pair at the threshold of 0.8 is missed with a probability of 1e-11 (1e-5
if minimum and maximum were fully dependent).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common, families
from .components import components


@dataclass(frozen=True)
class NearDuplicates:
    """words: of a shingle. percent: documents link if 100 * intersection >= percent * union of their shingle sets."""

    words: int = 5
    percent: int = 80
    permutations: int = 160
    band_rows: int = 5
    seed: int = 20240229
    #: Documents and shingles of a block of a family.
    block_nodes: int = 512
    block_shingles: int = 1_000_000


class Words(dict):
    """word -> 64-bit hash, learned as words come; emptied when it has 200,000."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_words = Words()
_LOWER = str.maketrans(common.A_TO_Z, common.A_TO_Z.lower())
_GAPS = {ord(c): " " for c in "\t\n\x0b\x0c\r"}
_TABLE = _LOWER | _GAPS


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words (what white space of ASCII separates), A-Z in lower case."""
    words = [w for w in text.translate(_TABLE).split(" ") if w]
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; the whole sequence is one if there are fewer words; none if empty."""
    h = word_hashes(text)
    if not len(h):
        return h
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = (out ^ h[k : len(h) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def permutation_keys(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1 << 32, size=n, dtype=np.uint32), rng.integers(1 << 31, size=n, dtype=np.uint32) << np.uint32(1) | np.uint32(1)


def min_max(sh: np.ndarray, keys: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The minimum, then the maximum under each permutation."""
    x = (sh >> np.uint64(32)).astype(np.uint32)[:, None]
    low = np.full(len(keys[0]), 0xFFFFFFFF, np.uint32)
    high = np.zeros(len(keys[0]), np.uint32)
    for k in range(0, len(x), 256):
        y = (x[k : k + 256] ^ keys[0]) * keys[1]
        y ^= y >> np.uint32(15)
        np.minimum(low, y.min(axis=0), out=low)
        np.maximum(high, y.max(axis=0), out=high)
    return np.concatenate((low, high))


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    table = signature[: len(signature) // rows * rows].reshape(-1, rows).astype(np.uint64)
    out = np.arange(len(table), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(rows):
            out = (out ^ table[:, k]) * np.uint64(0xD6E8FEB86659FD93)
            out ^= out >> np.uint64(32)
    return out


def signatures(docs: DataFrame, how: NearDuplicates) -> DataFrame:
    """doc_id, n_shingles, set_a and set_b (128 bits that stand for the set), bands (an array of longs; empty if there is
    no shingle). No shuffle."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = permutation_keys(how.permutations, how.seed)
        for batch in common.text_slices(batches):
            rows = []
            for text in common.texts_of(batch):
                sh = shingles(text, how.words)
                rows.append((len(sh), *set_digest(sh), band_keys(min_max(sh, keys), how.band_rows).view(np.int64) if len(sh) else np.empty(0, np.int64)))
            n, a, b, bands = zip(*rows, strict=True)
            ends = np.concatenate(([0], np.cumsum([len(x) for x in bands]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(bands)))], names=["doc_id", "n_shingles", "set_a", "set_b", "bands"])

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>")


def set_digest(sh: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set of shingles."""
    import xxhash

    a, b = divmod(xxhash.xxh3_128_intdigest(sh.tobytes()), 1 << 64)
    return a - (1 << 63), b - (1 << 63)


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, set_a, set_b and the set itself."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.text_slices(batches):
            out = [shingles(t, words) for t in common.texts_of(batch)]
            ends = np.concatenate(([0], np.cumsum([len(x) for x in out]))).astype(np.int32)
            a, b = zip(*map(set_digest, out), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(out).view(np.int64)))], names=["doc_id", "set_a", "set_b", "set"])

    return docs.select("doc_id", "text").mapInArrow(sets, "doc_id long, set_a long, set_b long, set array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) of nodes those whose sets are alike enough."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_x"), batch.column("set_y"), strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True)) if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) else 0
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    first = sets.select(F.col("node").alias("a"), F.col("set").alias("set_x"))
    second = sets.select(F.col("node").alias("b"), F.col("set").alias("set_y"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "set_x", "set_y").mapInArrow(compare, "a long, b long")


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of 0-1 matrices of some thousand shingles each."""
    sizes = np.array([len(x) for x in sets])
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = np.bincount(code, minlength=len(values)) > 1
    place = np.cumsum(shared) - 1
    keep = shared[code]
    row, code = row[keep], place[code[keep]]
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    for low in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(code, (low, low + width))
        part = np.zeros((len(sets), width), np.float32)
        part[row[a:b], code[a:b] - low] = 1
        out += part @ part.T
    return out


def near_duplicates(docs: DataFrame, how: NearDuplicates = NearDuplicates()) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id (the smallest doc_id that links reach), kept (the row is
    its component's smallest).

    Null or empty text: no shingle, a component of its own. Rows that share a doc_id come back as often as they are there;
    each of their texts is compared, and those with shingles share a component, whatever they hold. A null doc_id: a null
    component, and kept, as there is nothing to link it by. Other columns are ignored. An empty table gives an empty one.
    """
    signed = common.materialize(signatures(docs, how), "signatures")
    full = signed.filter("doc_id IS NOT NULL AND n_shingles > 0")
    # a node stands for a set, however many documents have it; first: the smallest of them
    groups = common.materialize(full.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("first")).withColumn("node", F.monotonically_increasing_id()), "sets")
    # a doc_id with several texts links their sets
    digest = F.struct("set_a", "set_b")
    several = full.groupBy("doc_id").agg(F.min(digest).alias("low"), F.max(digest).alias("high")).filter("low <> high").select("doc_id")
    member = full.select("doc_id", "set_a", "set_b").join(several, "doc_id").join(groups, ["set_a", "set_b"]).select("doc_id", "node")
    equal = member.join(member.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").filter("node <> a").select("a", F.col("node").alias("b"))

    chosen = groups.select("set_a", "set_b", F.col("first").alias("doc_id"), "node")
    rows = full.join(chosen, ["doc_id", "set_a", "set_b"])
    bands = rows.select("node", F.col("n_shingles").alias("n"), F.explode("bands").alias("band"))
    mark = F.struct("node", "n")
    buckets = bands.groupBy("band").agg(F.min(mark).alias("low"), F.max(mark).alias("high")).filter("low.node <> high.node")
    crowded = common.materialize(bands.join(buckets, "band"), "candidates")  # the members of buckets with several nodes

    def fits(x: str, y: str):
        # sets whose sizes alone rule a link out are never paired
        return F.lit(100) * F.least(x, y) >= F.lit(how.percent) * F.greatest(x, y)

    stars = [crowded.select(F.col(f"{end}.node").alias("a"), F.col("node").alias("b"), F.col(f"{end}.n").alias("x"), F.col("n").alias("y")) for end in ("low", "high")]
    pairs = stars[0].unionAll(stars[1]).filter("a <> b").filter(fits("x", "y")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = common.materialize(pairs, "pairs")

    wanted = chosen.join(crowded.select("node").distinct(), "node", "left_semi")
    texts = docs.select("doc_id", "text").join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    sets = common.materialize(shingle_sets(texts, how.words).join(wanted, ["doc_id", "set_a", "set_b"]).select("node", "set").dropDuplicates(["node"]), "shingles")
    links = common.materialize(_confirmed(pairs, sets, how.percent), "confirmed")
    linked = components(links)

    # buckets whose members still lie in several components, and whose pairs weren't all compared
    inside = crowded.select("band", "node", "n").join(linked, "node", "left").select("band", "node", "n", F.coalesce("root", "node").alias("root"))
    mixed = inside.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("k")).filter("x <> y AND k > 2").select("band")
    rest = common.materialize(inside.join(mixed, "band", "left_semi"), "mixed")

    def alike(held: list[np.ndarray], matter: np.ndarray) -> np.ndarray:
        size, both = np.array([len(x) for x in held]), _intersections(held)
        return matter & (100 * both >= how.percent * (size[:, None] + size[None, :] - both))

    late = families.links_within(rest, sets.withColumnRenamed("set", "value"), alike, how.block_nodes, how.block_shingles)
    # components so far are links of a node with its root
    every = linked.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(common.materialize(late, "confirmed")).unionAll(equal)
    rooted = groups.join(components(every), "node", "left").select("set_a", "set_b", "first", F.coalesce("root", "node").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = common.materialize(rooted.join(named, "root").select("set_a", "set_b", "component_id"), "components")
    out = signed.select("doc_id", "n_shingles", "set_a", "set_b").join(named, ["set_a", "set_b"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, how: NearDuplicates = NearDuplicates()) -> DataFrame:
    """The rows of `docs` that stay: those with one doc_id of each component, and of several rows with that doc_id the
    first by text (of equal rows one). Rows without a doc_id stay."""
    found = common.materialize(near_duplicates(docs, how), "near-duplicates")
    # a doc_id goes with its component: its empty rows, components of their own, go with it
    gone = found.filter("NOT kept").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    repeated = found.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    if repeated.isEmpty():
        return left
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last(), *[F.col(c) for c in docs.columns if c not in ("doc_id", "text")]))
    once = left.join(repeated, "doc_id", "left_semi").withColumn("_lq_nth", first).filter("_lq_nth = 1").select(docs.columns)
    return left.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(once)
