"""Line deduplication by a segment-partition edit join.

Lines within a number of edits of each other are one class; each class keeps its first line (by doc_id, then place) and
the others are taken out of their documents. Equal lines meet by their hash. For the others each line is split into
threshold + 1 segments of near equal length: a line within the threshold must hold one of them unchanged, at a place
that its length bounds. Segments are indexed, substrings of those places probed, and what meets is compared by a banded
bit-parallel edit distance.

Keys are made where the texts are read and dealt by hash in binary blocks, each line once a batch, so a line that is in
every document is a row a batch. A key that many different lines share is dealt anew by parts of a parity sketch: an
edit changes at most two of its 64 bits, so lines within the threshold agree in at least one part. What is crowded even
then is linked in rounds: each line with the first of its group, then lines of different components block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, families, winnow
from .components import components

NULL_ID = -(1 << 63)
#: Lines of the corpus for each part that keys are dealt to: what one task holds of them doesn't grow with the corpus.
PART_LINES = 250_000
#: Bits of the filter in front of the join that fetches candidate lines' texts (2 MB, whatever the corpus).
FILTER_BITS = 24
BLOCKS = "p int, keys binary, lines binary, sketches binary"
PAIRS = "crowd long, a long, b long"


@dataclass(frozen=True)
class Lines:
    """edits: the threshold. shortest: from so many code points (of the longer line) it holds in full, below in proportion:
    with the defaults a line of 12 to 23 has one edit, a shorter one is the same only if equal. Blank lines stay. group: up
    to so many different lines of a key are paired directly."""

    edits: int = 2
    shortest: int = 24
    group: int = 48
    #: Lines and characters of a block in which crowded groups are compared.
    block_lines: int = 512
    block_chars: int = 2_000_000

    def allowed(self, length: int) -> int:
        """The edits that two lines may differ by, the longer of which has this length."""
        return min(self.edits, self.edits * length // max(self.shortest, 1))

    @property
    def least(self) -> int:
        """The smallest length of the longer line that allows an edit."""
        return -(-self.shortest // max(self.edits, 1))


def split_lines(text: str) -> list[str]:
    return text.split("\n")


def segments(length: int, edits: int) -> list[tuple[int, int]]:
    """Start and length of the edits + 1 segments of a line: the last ones are longer by one where it doesn't divide."""
    n = edits + 1
    short, more = divmod(length, n)
    out, at = [], 0
    for i in range(n):
        size = short + (i >= n - more)
        out.append((at, size))
        at += size
    return out


def probes(length: int, edits: int) -> list[tuple[int, int, int, int]]:
    """What a line asks an index for: indexed length, segment, start in the line, length. Starts are those that an
    alignment within the threshold can have, from the left and from the right end."""
    out = []
    for other in range(max(1, length - edits), length + 1):
        delta = length - other
        for i, (at, size) in enumerate(segments(other, edits)):
            low = max(at - i, at + delta - (edits - i), 0)
            high = min(at + i, at + delta + (edits - i), length - size)
            out += [(other, i, start, size) for start in range(low, high + 1)]
    return out


def within(a: str, b: str, most: int) -> bool:
    """Whether two strings are within `most` edits: equal ends go, what is left is compared in a band of 2 * most + 1
    diagonals held as bits of one integer, until the distance is out of reach."""
    if abs(len(a) - len(b)) > most:
        return False
    n = min(len(a), len(b))
    k = 0
    step = 1 << max(0, n.bit_length() - 1)
    while step:  # longest common prefix by halves
        if k + step <= n and a[k : k + step] == b[k : k + step]:
            k += step
        else:
            step >>= 1
    a, b = a[k:], b[k:]
    n = min(len(a), len(b))
    k, step = 0, 1 << max(0, n.bit_length() - 1)
    while step:
        if k + step <= n and a[len(a) - k - step : len(a) - k] == b[len(b) - k - step : len(b) - k]:
            k += step
        else:
            step >>= 1
    a, b = a[: len(a) - k], b[: len(b) - k]
    if not a or not b:
        return len(a) + len(b) <= most
    if len(a) > len(b):
        a, b = b, a
    # bit i of a column is row j - most + i; vp and vn hold where a row is one above or below the row before it
    m, width = len(a), 2 * most + 1
    full = (1 << width) - 1
    vp, vn, score = full & ~((1 << most + 1) - 1), 0, most  # score: the distance at the band's lowest row
    spare = 2 * most + len(b) - m
    for j, c in enumerate(b, 1):
        vp, vn, low = vp >> 1 | 1 << (width - 1), vn >> 1, j - most
        pm = 0
        for i in range(max(0, 1 - low), min(width, m - low + 1)):
            if a[low + i - 1] == c:
                pm |= 1 << i
        d0 = (((pm & vp) + vp) ^ vp | pm | vn) & full
        hp, hn = (vn | ~(d0 | vp)) & full, d0 & vp
        score += not d0 >> (width - 1) & 1  # it never falls along a diagonal
        if score > spare:
            return False
        hp, hn = (hp << 1 | 1) & full, hn << 1 & full
        vp, vn = (hn | ~(d0 | hp)) & full, hp & d0
    for i in range(width - 1, m - len(b) + most, -1):  # in the last column from the band's lowest row up to row m
        score -= (vp >> i & 1) - (vn >> i & 1)
    return score <= most


def line_hash(line: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63)


def text_hash(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), 1) - (1 << 63)


def line_table(docs: DataFrame) -> DataFrame:
    """doc_id (null: the smallest long), doc_hash (of the text), line_no and line (its hash), for lines that aren't blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.text_slices(batches):
            ids, hashes, numbers, lines = [], [], [], []
            for d, text in zip(batch.column("doc_id").to_pylist(), common.texts_of(batch), strict=True):
                here = [(i, line_hash(x)) for i, x in enumerate(split_lines(text)) if x and not x.isspace()]
                ids += [NULL_ID if d is None else d] * len(here)
                hashes += [text_hash(text)] * len(here) if here else []
                numbers += [i for i, _ in here]
                lines += [h for _, h in here]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(numbers, pa.int32()), pa.array(lines, pa.int64())], names=["doc_id", "doc_hash", "line_no", "line"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, doc_hash long, line_no int, line long")


def _keys(lines: list[str], hashes: np.ndarray, how: Lines) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, lines and sketches of all that a batch's lines index and probe. A key's lowest bit: the line's own segment."""
    length = np.array([len(x) for x in lines], np.int64)
    first = np.cumsum(length) - length
    points = winnow.code_points("".join(lines)).astype(np.uint64) + np.uint64(1)
    power, inverse = winnow._table(len(points) + 1)
    k = how.edits
    out = []
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(points * inverse[: len(points)])))
        bit = np.left_shift(np.uint64(1), points * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(58))
        sketch = np.bitwise_xor.reduceat(bit, first)
        for delta in range(k + 1):
            other = length - delta
            short, more = other // (k + 1), other % (k + 1)
            for i in range(k + 1):
                size = short + (i >= k + 1 - more)
                at = i * short + np.maximum(0, i - (k + 1 - more))
                low = np.maximum(np.maximum(at - i, at + delta - (k - i)), 0)
                high = np.minimum(np.minimum(at + i, at + delta + (k - i)), length - size)
                for shift in range(int((high - low).max()) + 1 if len(low) else 0):
                    start = low + shift
                    ok = np.flatnonzero((start <= high) & (other > 0))
                    a, n = first[ok] + start[ok], size[ok]
                    h = (sums[a + n] - sums[a]) * power[a]
                    h ^= h >> np.uint64(29)
                    h = (h + (other[ok] * (k + 1) + i).astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
                    h ^= h >> np.uint64(32)
                    own = (delta == 0) & (start[ok] == at[ok])
                    out.append((h & ~np.uint64(1) | own.astype(np.uint64), ok))
    keys, rows = np.concatenate([h for h, _ in out]), np.concatenate([r for _, r in out])
    return keys, hashes[rows], sketch[rows]


def key_blocks(docs: DataFrame, how: Lines, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in common.text_slices(batches, most=1 << 20):
            fresh: dict[int, str] = {}
            for text in common.texts_of(batch):
                for x in split_lines(text):
                    if len(x) >= how.least - how.edits and x and not x.isspace() and (h := line_hash(x)) not in seen:
                        fresh[h] = x
            if len(seen) > 200_000:
                seen.clear()
            seen.update(fresh)
            if not fresh:
                continue
            keys, lines, sketches = _keys(list(fresh.values()), np.array(list(fresh), np.int64), how)
            p = ((keys >> np.uint64(33)) % np.uint64(parts)).astype(np.uint32)
            order = np.argsort(p, kind="stable")
            cut = np.searchsorted(p[order], np.arange(parts + 1))
            kept = [q for q in range(parts) if cut[q + 1] > cut[q]]
            cols = [[c[order[cut[q] : cut[q + 1]]].tobytes() for q in kept] for c in (keys, lines, sketches)]
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int32()), *(pa.array(c, pa.binary()) for c in cols)], names=[c.split()[0] for c in BLOCKS.split(", ")])

    return docs.select("text").mapInArrow(run, BLOCKS)


def _pairs(key: np.ndarray, own: np.ndarray, line: np.ndarray, sketch: np.ndarray, how: Lines) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of different lines within groups of equal keys of which one indexes it and whose sketches are near; and the
    entries of groups that are too large."""
    order = np.lexsort((~own, line, key))
    key, own, line, sketch = key[order], own[order], line[order], sketch[order]
    once = np.concatenate((np.ones(min(1, len(key)), bool), (key[1:] != key[:-1]) | (line[1:] != line[:-1])))
    index = order[once]
    key, own, line, sketch = key[once], own[once], line[once], sketch[once]
    start = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
    size = np.diff(np.append(start, len(key)))
    has = np.add.reduceat(own.astype(np.int64), start) if len(start) else size
    use = (size > 1) & (has > 0)
    small, large = np.repeat(use & (size <= how.group), size), np.repeat(use & (size > how.group), size)
    at = np.flatnonzero(small)
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for d in range(1, how.group):
        at = at[at + d < len(key)]
        at = at[key[at] == key[np.minimum(at + d, len(key) - 1)]]
        if not len(at):
            break
        good = (own[at] | own[at + d]) & (np.bitwise_count(sketch[at] ^ sketch[at + d]) <= 2 * how.edits)
        a.append(line[at[good]])
        b.append(line[at[good] + d])
    return np.concatenate(a), np.concatenate(b), index[large]


def candidate_pairs(blocks: DataFrame, how: Lines) -> DataFrame:
    """crowd null: a pair to compare. Else a member (a) of a crowded group, with its first line (b)."""

    def run(table: pa.Table) -> pa.Table:
        key, line, sketch = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("keys", np.uint64), ("lines", np.int64), ("sketches", np.uint64)))
        own, key = key & np.uint64(1) == 1, key >> np.uint64(1)
        a, b, large = _pairs(key, own, line, sketch, how)
        found = [(a, b)]
        crowd, member, leader = (np.empty(0, np.int64),) * 3
        if len(large):
            # 2 * edits + 1 parts of the sketch, of which one at least is equal
            n = 2 * how.edits + 1
            edge = np.linspace(0, 64, n + 1).astype(int)
            with np.errstate(over="ignore"):
                keys = np.concatenate([(key[large] * np.uint64(n) + np.uint64(c)) * np.uint64(0x9E3779B97F4A7C15) ^ (sketch[large] >> np.uint64(edge[c]) & np.uint64((1 << int(edge[c + 1] - edge[c])) - 1)) * np.uint64(0xD6E8FEB86659FD93) for c in range(n)])
            rows = np.tile(large, n)
            a, b, still = _pairs(keys, own[rows], line[rows], sketch[rows], how)
            found.append((a, b))
            if len(still):
                order = np.lexsort((line[rows[still]], keys[still]))
                crowd, member = keys[still][order].astype(np.int64), line[rows[still]][order]
                start = np.flatnonzero(np.concatenate(([True], crowd[1:] != crowd[:-1])))
                leader = np.repeat(member[start], np.diff(np.append(start, len(crowd))))
        a, b = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1), axis=0)
        return pa.table([pa.array([None] * len(pairs) + crowd.tolist(), pa.int64()), pa.array(np.concatenate((pairs[:, 0], member))), pa.array(np.concatenate((pairs[:, 1], leader)))], names=["crowd", "a", "b"])

    return blocks.groupBy("p").applyInArrow(run, PAIRS)


def line_filter(lines: DataFrame) -> np.ndarray:
    """A table of bits in which those of the lines are set, made by one aggregation; its size is fixed."""
    bit = F.col("line").bitwiseAND((1 << FILTER_BITS) - 1)
    words = lines.select(F.shiftright(bit, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(63).cast("int")).alias("bits"))
    table = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for r in words.groupBy("word").agg(F.bit_or("bits").alias("bits")).collect():  # 2^18 rows at most
        table[r.word] = r.bits
    return np.unpackbits(table.view(np.uint8), bitorder="little").astype(bool)


def line_texts(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """line, text of the lines asked for (line: their hashes), once each. A filter of fixed size in the scan leaves out most
    other lines, a join the rest."""
    wanted = np.packbits(line_filter(lines))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        maybe = np.unpackbits(wanted).astype(bool)
        for batch in common.text_slices(batches):
            found: dict[int, str] = {}
            for text in common.texts_of(batch):
                for x in split_lines(text):
                    if x and not x.isspace():
                        found[line_hash(x)] = x
            h = np.fromiter(found, np.int64, len(found))
            h = h[maybe[h & ((1 << FILTER_BITS) - 1)]]
            new = [x for x in h.tolist() if x not in seen]
            seen = seen | set(new) if len(seen) < 200_000 else set(new)
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.int64()), pa.array([found[x] for x in new], pa.string())], names=["line", "text"])

    return docs.select("text").mapInArrow(run, "line long, text string").join(lines, "line", "left_semi").dropDuplicates(["line"])


def _confirmed(pairs: DataFrame, texts: DataFrame, how: Lines) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [within(x, y, how.allowed(max(len(x), len(y)))) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(texts.select(F.col("line").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("line").alias("b"), F.col("text").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def alike(lines: list[str], matter: np.ndarray, how: Lines) -> np.ndarray:
    """Of the pairs that matter those within the edits that their length allows. An edit changes the numbers of characters
    (by their hash) by two at most, which leaves few pairs to compare."""
    size = np.array([len(x) for x in lines])
    row = np.repeat(np.arange(len(lines)), size)
    kind = (winnow.code_points("".join(lines)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(58)).astype(np.int64)
    counts = np.bincount(row * 64 + kind, minlength=len(lines) * 64).reshape(-1, 64).astype(np.int32)
    out = np.zeros_like(matter)
    for i in np.flatnonzero(matter.any(axis=1)):
        near = np.flatnonzero(matter[i])
        near = near[np.abs(counts[near] - counts[i]).sum(axis=1) <= 2 * how.edits]
        out[i, near] = [within(lines[i], lines[j], how.allowed(max(len(lines[i]), len(lines[j])))) for j in near]
    return out


def near_lines(docs: DataFrame, how: Lines = Lines(), n_lines: int | None = None) -> DataFrame:
    """line, root: the class of each line that is within the threshold of another (hashes of both). n_lines: how many lines
    there are, if that is known."""
    n_lines = line_table(docs).count() if n_lines is None else n_lines
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_lines // PART_LINES))
    found = common.materialize(candidate_pairs(common.dealt(key_blocks(docs, how, parts), parts), how), "line-candidates")
    crowds = found.filter("crowd IS NOT NULL")
    pairs = common.materialize(found.select("a", "b").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "line-pairs")
    texts = common.materialize(line_texts(docs, pairs.select(F.col("a").alias("line")).unionAll(pairs.select("b")).distinct()), "line-texts")
    links = common.materialize(_confirmed(pairs, texts, how), "line-links")
    linked = components(links)
    if not crowds.isEmpty():
        inside = crowds.select(F.col("crowd").alias("band"), F.col("a").alias("node")).join(linked, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root"))
        mixed = inside.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("band")
        rest = inside.join(mixed, "band", "left_semi").join(texts.select(F.col("line").alias("node"), F.length("text").alias("n")), "node")
        late = families.links_within(common.materialize(rest, "line-rest"), texts.select(F.col("line").alias("node"), F.col("text").alias("value")), lambda lines, matter: alike(lines, matter, how), how.block_lines, how.block_chars)
        linked = components(links.unionAll(common.materialize(late, "line-links")))
    return linked.select(F.col("node").alias("line"), "root")


def removals(docs: DataFrame, how: Lines = Lines()) -> DataFrame:
    """doc_id (null: the smallest long), doc_hash, the numbers of the lines that go, and the doc_ids where the first lines of
    their classes stand."""
    lines = common.materialize(line_table(docs), "lines")
    classes = near_lines(docs, how, lines.count())
    place = F.struct("doc_id", "line_no", "doc_hash")
    firsts = lines.groupBy("line").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    firsts = common.materialize(firsts.join(classes, "line", "left").filter("n > 1 OR root IS NOT NULL").select("line", "first", F.coalesce("root", "line").alias("root")), "line-firsts")
    heads = firsts.groupBy("root").agg(F.min("first").alias("first"))
    known = firsts.select("line", "root").join(heads, "root").select("line", "first", (F.col("line") != F.col("root")).alias("near"))
    gone = lines.join(known, "line").filter(place != F.col("first"))
    return gone.groupBy("doc_id", "doc_hash").agg(F.collect_set("line_no").alias("gone"), F.array_sort(F.collect_set("first.doc_id")).alias("first_docs"))


def _cleaned(docs: DataFrame, how: Lines, schema: str, make) -> DataFrame:
    """Joins each row with its removals and maps it; make: (batch, cleaned texts, numbers of lines) -> arrays."""
    names = [c for c in docs.columns]
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    # removals without a doc_hash match would be of another row with the same doc_id: the map looks by the text's own hash
    by_doc = removals(docs, how).groupBy(F.col("doc_id").alias("_lq_key")).agg(F.collect_list(F.struct("doc_hash", "gone", "first_docs")).alias("_lq_gone"))
    rows = docs.withColumn("_lq_key", key).join(by_doc, "_lq_key", "left").select(*names, "_lq_gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.text_slices(batches):
            out = []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("_lq_gone").to_pylist(), strict=True):
                mine = next((x for x in found or () if x["doc_hash"] == text_hash(text or "")), None)
                if mine is None:
                    out.append((text, len(split_lines(text or "")), 0, []))
                else:
                    lines, gone = split_lines(text), set(mine["gone"])
                    out.append(("\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone), mine["first_docs"]))
            yield make(batch, out)

    return rows.mapInArrow(run, schema)


def deduplicated_lines(docs: DataFrame, how: Lines = Lines()) -> DataFrame:
    """docs (doc_id, text) -> for each row doc_id, text (without the lines that go), n_lines, n_removed, first_docs (the
    doc_ids that keep the first line of a removed line's class).

    Null text: null, one blank line. Blank lines stay. Rows with the same doc_id and text are one document. Null doc_ids
    come first in the order of documents. Other columns are ignored. An empty table gives an empty one.
    """
    schema = "doc_id long, text string, n_lines long, n_removed long, first_docs array<long>"

    def make(batch: pa.RecordBatch, out: list[tuple]) -> pa.RecordBatch:
        text, n, gone, firsts = zip(*out, strict=True)
        firsts = [[None if d == NULL_ID else d for d in f] for f in firsts]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(text, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(firsts, pa.list_(pa.int64()))], names=[c.split()[0] for c in schema.split(", ")])

    return _cleaned(docs.select("doc_id", "text"), how, schema, make)


def clean(docs: DataFrame, how: Lines = Lines()) -> DataFrame:
    """docs with all their rows and columns, text without the lines that go and n_chars (if it is there) to match. Rows with
    the same doc_id and text are one document and come back alike; null and empty texts come back as they are."""
    schema = docs.schema

    def make(batch: pa.RecordBatch, out: list[tuple]) -> pa.RecordBatch:
        cols = []
        for field in schema:
            if field.name == "text":
                cols.append(pa.array([x[0] for x in out], batch.column("text").type))
            elif field.name == "n_chars":
                old = batch.column("n_chars").to_pylist()
                cols.append(pa.array([len(x[0]) if x[2] else o for x, o in zip(out, old, strict=True)], batch.column("n_chars").type))
            else:
                cols.append(batch.column(field.name))
        return pa.RecordBatch.from_arrays(cols, names=schema.names)

    return _cleaned(docs, how, schema, make)
