"""Language-model scores by deleted interpolation of word n-grams.

A token's probability mixes the maximum-likelihood estimates of its bigram and its word and a uniform share. The weights
depend on how often the context was seen (a bucket for each power of two) and are learned by expectation-maximisation
on documents that are taken out of the counts for it.

Counts are exact and never on one machine. Texts become batches of a few MB with a vocabulary of their own. Each batch
asks for the n-grams that it has, once each, with its own counts, dealt by the n-gram's hash: the sums over all batches
are the corpus counts, and they go back to the batch in the order of its questions. So a word that is in every document
is one row a batch, and no table of words is broadcast.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .minhash import _TABLE, _words

#: The hash that stands for the end of a document; as a context, for its start.
END = np.uint64(0x5851F42D4C957F2D)
BATCH_BYTES = 8 << 20
BUCKETS = 48
#: Tokens of the corpus for each part that n-grams are dealt to: what one task holds of them doesn't grow with the corpus.
PART_TOKENS = 4_000_000
#: Of the training documents every so many is held out of the counts that weights are learned on.
DELETED_ONE_IN = 8
#: Mixture weights (bigram, word, uniform) of a corpus without held-out tokens.
DEFAULT_WEIGHTS = (0.5, 0.45, 0.05)

BATCH = "b long, dev boolean, doc_ids array<long>, sizes array<int>, train array<boolean>, vocab binary, codes binary"
ASK = "p int, b long, dev boolean, u_hash binary, u_n binary, u_dev binary, g_hash binary, g_n binary, g_dev binary"
TOLD = "p int, b long, dev boolean, u_n binary, u_dev binary, g_n binary, g_dev binary, tokens long, words long, dev_tokens long"


def fold(doc_id: int | None) -> tuple[bool, bool]:
    """Whether a document is held out of training, and whether it is a training document that weights are learned on."""
    crc = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 0
    held = doc_id is not None and crc % 5 == 1
    return held, not held and crc // 5 % DELETED_ONE_IN == 0


def squeezed(codes: np.ndarray) -> bytes:
    """Unsigned numbers byte by byte of all of them (the upper ones are few), compressed: they are shuffled so."""
    import zstandard

    width = codes.dtype.itemsize
    return bytes([width]) + zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(codes).view(np.uint8).reshape(-1, width).T.tobytes())


def unsqueezed(raw: bytes) -> np.ndarray:
    import zstandard

    width = raw[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").reshape(-1)


def batches_of(docs: DataFrame, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in common.text_slices(batches, most=batch_bytes):
            rows = list(zip(batch.column("doc_id").to_pylist(), common.texts_of(batch), strict=True))
            for dev in (False, True):
                part = [(d, t) for d, t in rows if fold(d)[1] == dev]
                if part:
                    # codes are given in order of first use
                    code = {"": 0}
                    held, sizes = [], []
                    for _, text in part:
                        words = [w for w in text.translate(_TABLE).split(" ") if w]
                        for w in words:
                            if w not in code:
                                code[w] = len(code)
                        words.append("")
                        held.append(np.fromiter(map(code.__getitem__, words), np.uint32, len(words)))
                        sizes.append(len(words))
                    names = iter(code)
                    next(names)
                    vocab = np.concatenate(([END], np.fromiter(map(_words.__getitem__, names), np.uint64, len(code) - 1)))
                    yield pa.RecordBatch.from_arrays([pa.array([number + dev], pa.int64()), pa.array([dev]), pa.array([[d for d, _ in part]], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())), pa.array([[not fold(d)[0] for d, _ in part]], pa.list_(pa.bool_())), pa.array([vocab.tobytes()], pa.binary()), pa.array([squeezed(np.concatenate(held))], pa.binary())], names=[x.split()[0] for x in BATCH.split(", ")])
            number += 2

    return docs.select("doc_id", "text").mapInArrow(run, BATCH)


class Batch:
    """A batch and its n-grams: words in the vocabulary's order, bigrams in that of their codes."""

    def __init__(self, row: dict, parts: int):
        self.doc_ids, self.sizes, self.train = row["doc_ids"], np.array(row["sizes"], np.int64), np.array(row["train"], bool)
        self.vocab, self.codes = np.frombuffer(row["vocab"], np.uint64), unsqueezed(row["codes"])
        before = np.concatenate((np.zeros(1, np.uint32), self.codes[:-1]))
        pair = before.astype(np.uint64) * np.uint64(len(self.vocab)) + self.codes
        grams, self.gram_of = np.unique(pair, return_inverse=True)
        self.context = (grams // np.uint64(len(self.vocab))).astype(np.int64)
        self.word = (grams % np.uint64(len(self.vocab))).astype(np.int64)
        with np.errstate(over="ignore"):
            h = (self.vocab[self.context] * np.uint64(0x9E3779B97F4A7C15)) ^ self.vocab[self.word]
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            self.grams = h ^ h >> np.uint64(32)
        self.u_order, self.u_cut = self._dealt(self.vocab, parts)
        self.g_order, self.g_cut = self._dealt(self.grams, parts)

    @staticmethod
    def _dealt(hashes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
        p = ((hashes >> np.uint64(33)) % np.uint64(parts)).astype(np.uint32)
        order = np.argsort(p, kind="stable")
        return order, np.searchsorted(p[order], np.arange(parts + 1))


def ask(batches: DataFrame, parts: int) -> DataFrame:
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in rows:
            for k in range(got.num_rows):
                row = got.slice(k, 1).to_pylist()[0]
                x = Batch(row, parts)
                token_train = np.repeat(x.train, x.sizes)
                u = np.bincount(x.codes[token_train], minlength=len(x.vocab)).astype(np.uint32)
                g = np.bincount(x.gram_of[token_train], minlength=len(x.grams)).astype(np.uint32)
                none = np.uint32(row["dev"])
                cols = [x.vocab[x.u_order], u[x.u_order], u[x.u_order] * none, x.grams[x.g_order], g[x.g_order], g[x.g_order] * none]
                out = [[] for _ in range(6)]
                kept = [p for p in range(parts) if x.u_cut[p + 1] > x.u_cut[p] or x.g_cut[p + 1] > x.g_cut[p]]
                for p in kept:
                    for i, c in enumerate(cols):
                        cut = x.u_cut if i < 3 else x.g_cut
                        part = c[cut[p] : cut[p + 1]]
                        out[i].append(part.tobytes() if i % 3 == 0 else squeezed(part))
                yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int32()), pa.array([row["b"]] * len(kept), pa.int64()), pa.array([row["dev"]] * len(kept)), *(pa.array(c, pa.binary()) for c in out)], names=[c.split()[0] for c in ASK.split(", ")])

    return batches.mapInArrow(run, ASK)


def _totals(ranked: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of 64 bits of counts in order of their n-grams, which begin at `first`; stored in 32 bits where all fit."""
    out = np.add.reduceat(ranked, first, dtype=np.uint64) if len(first) else np.empty(0, np.uint64)
    return out if len(out) and int(out.max()) >> 32 else out.astype(np.uint32)


def _summed(table: pa.Table, kind: str) -> tuple[list[bytes], list[bytes], int, int, int]:
    """Sums of the counts over all batches, in each batch's order; the sum, the distinct n-grams with a count, the deleted
    part's sum."""
    parts = table.column(f"{kind}_hash").to_pylist()
    hashes = np.frombuffer(b"".join(parts), np.uint64)
    n, dev = (np.concatenate([unsqueezed(x) for x in table.column(f"{kind}_{c}").to_pylist()]) for c in ("n", "dev"))
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    new = np.concatenate((np.ones(min(1, len(ranked)), bool), ranked[1:] != ranked[:-1]))
    at = np.empty(len(hashes), np.int64)
    at[order] = np.cumsum(new) - 1
    total, gone = (_totals(c[order], np.flatnonzero(new)) for c in (n, dev))
    ends = np.cumsum([len(x) // 8 for x in parts])[:-1]
    return [squeezed(x) for x in np.split(total[at], ends)], [squeezed(x) for x in np.split(gone[at], ends)], int(total.sum(dtype=np.uint64)), int((total > 0).sum()), int(gone.sum(dtype=np.uint64))


def tell(asked: DataFrame) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        u_n, u_dev, tokens, words, dev_tokens = _summed(table, "u")
        g_n, g_dev, *_ = _summed(table, "g")
        first = [1] + [0] * (table.num_rows - 1)
        return pa.table([table.column("p"), table.column("b"), table.column("dev"), pa.array(u_n, pa.binary()), pa.array(u_dev, pa.binary()), pa.array(g_n, pa.binary()), pa.array(g_dev, pa.binary()), *(pa.array([f * v for f in first], pa.int64()) for v in (tokens, words, dev_tokens))], names=[c.split()[0] for c in TOLD.split(", ")])

    return asked.groupBy("p").applyInArrow(run, TOLD)


def _counts(x: Batch, told: pa.Table) -> tuple[np.ndarray, ...]:
    """The corpus counts of a batch's words and bigrams, then their deleted part."""
    out = []
    for kind, order, cut in (("u", x.u_order, x.u_cut), ("g", x.g_order, x.g_cut)):
        for c in ("n", "dev"):
            full = np.zeros(len(order), np.int64)
            for p, raw in zip(told.column("p").to_pylist(), told.column(f"{kind}_{c}").to_pylist(), strict=True):
                full[order[cut[p] : cut[p + 1]]] = unsqueezed(raw)
            out.append(full)
    return tuple(out)


def _shares(context: np.ndarray, gram: np.ndarray, word: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket, bigram estimate and word estimate."""
    bucket = np.minimum(np.ceil(np.log2(context + 1)), BUCKETS - 1).astype(np.int64)
    return bucket, gram / np.maximum(context, 1), word / max(total, 1)


def learn_weights(cells: np.ndarray, uniform: float, rounds: int = 100) -> np.ndarray:
    """cells: rows of bucket, number of tokens, mean bigram and mean word estimate -> weights by bucket (3 columns).
    Buckets without tokens have the weights of all buckets together; in that of unseen contexts, which have no bigrams, the
    other two share what would be the bigram's."""

    def em(part: np.ndarray) -> np.ndarray:
        w = np.array(DEFAULT_WEIGHTS)
        if not len(part):
            return w
        p = np.stack((part[:, 2], part[:, 3], np.full(len(part), uniform)), axis=1)
        for _ in range(rounds):
            share = p * w
            share /= share.sum(axis=1, keepdims=True)
            w = (share * part[:, 1:2]).sum(axis=0) / part[:, 1].sum()
            w = np.maximum(w, 1e-6) / np.maximum(w, 1e-6).sum()
        return w

    every = em(cells)
    out = np.array([em(cells[cells[:, 0] == b]) if (cells[:, 0] == b).any() else every for b in range(BUCKETS)])
    out[0, 0] = 0
    out[0] /= out[0].sum()
    return out


def language_model_scores(docs: DataFrame, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """docs (doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row.

    Tokens are words, A-Z in lower case, and one end. base_score is the smoothed word model's log10 probability, score
    that of the interpolated model. Null text: an empty one, its end alone. Rows that share a doc_id are scored each. A
    null doc_id is a training document. Other columns are ignored. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    batches = common.materialize(batches_of(docs, batch_bytes), "batches")
    size = batches.agg(F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_TOKENS))
    told = common.materialize(tell(common.dealt(ask(batches, parts), parts)), "counts")
    n = told.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"), F.coalesce(F.sum("dev_tokens"), F.lit(0)).alias("dev")).first()
    total, words, kept = n.tokens, n.words, n.tokens - n.dev
    uniform = 1 / (words + 1)

    def held_out_cells(rows: pa.Table, told: pa.Table) -> pa.Table:
        out = np.empty((0, 6))
        for row in rows.to_pylist():
            x = Batch(row, parts)
            u, u_dev, g, g_dev = _counts(x, told)
            u, g = u - u_dev, g - g_dev
            times = np.bincount(x.gram_of, minlength=len(x.grams))
            bucket, p2, p1 = _shares(u[x.context], g, u[x.word], kept)
            # tokens alike to a tenth of a decade in both estimates are one cell, with their means
            q = [np.where(p > 0, np.floor(np.log10(np.maximum(p, 1e-30)) * 10), -400).astype(np.int64) for p in (p2, p1)]
            key = (bucket * 512 + q[0] + 400) * 512 + q[1] + 400
            cells, at = np.unique(key, return_inverse=True)
            sums = [np.bincount(at, v * times, len(cells)) for v in (np.ones(len(key)), p2, p1)]
            out = np.concatenate((out, np.stack((cells // 512 // 512, cells // 512 % 512, cells % 512, *sums), axis=1)))
        return pa.table([*(pa.array(out[:, k].astype(np.int64)) for k in range(3)), *(pa.array(out[:, k]) for k in range(3, 6))], names=["bucket", "q2", "q1", "n", "p2", "p1"])

    dev = batches.filter("dev").groupBy("b").cogroup(told.filter("dev").groupBy("b")).applyInArrow(held_out_cells, "bucket long, q2 long, q1 long, n double, p2 double, p1 double")
    # at most buckets times decades squared rows reach the driver, whatever the corpus
    cells = dev.groupBy("bucket", "q2", "q1").agg(F.sum("n").alias("n"), F.sum("p2").alias("p2"), F.sum("p1").alias("p1")).collect()
    table = np.array([(c.bucket, c.n, c.p2 / c.n, c.p1 / c.n) for c in sorted(cells)]).reshape(-1, 4)
    weights = learn_weights(table, uniform)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def scores(rows: pa.Table, told: pa.Table) -> pa.Table:
        out = []
        for row in rows.to_pylist():
            x = Batch(row, parts)
            u, _, g, _ = _counts(x, told)
            bucket, p2, p1 = _shares(u[x.context], g, u[x.word], total)
            w = weights[bucket]
            by_gram = np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] * uniform)
            by_word = np.log10((u + 0.5) / (total + 0.5 * (words + 1)))
            first = np.cumsum(x.sizes) - x.sizes
            known = np.add.reduceat((u > 0)[x.codes].astype(np.int64), first)
            out.append(pa.table([pa.array(x.doc_ids, pa.int64()), pa.array(~x.train), pa.array(x.sizes), pa.array(known), pa.array(np.full(len(first), total, np.int64)), pa.array(np.add.reduceat(by_word[x.codes], first)), pa.array(np.add.reduceat(by_gram[x.gram_of], first))], names=[c.split()[0] for c in schema.split(", ")]))
        return pa.concat_tables(out)

    return batches.groupBy("b").cogroup(told.groupBy("b")).applyInArrow(scores, schema)
