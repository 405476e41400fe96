"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

Features are densities of lexicon words (a fixed list, and words and word beginnings learned from labels), how often such
words stand near a second person, and rates of capitals, punctuation and obfuscated spelling. The model is fitted on the
driver from a bounded sample of labelled rows; scoring is a map over all texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: At most so many labelled rows are fitted on, those with the smallest hash of their doc_id.
SAMPLE_ROWS = 8_000
#: At most so many words and word beginnings are learned, those with the highest odds.
LEXICON_TERMS = 4_000
PREDICT_AT = 0.7

# Insults of four languages, and second-person pronouns.
INSULTS = frozenset("""
idiot idiots moron morons stupid loser losers scum trash pathetic worthless disgusting clown dumb fool fools imbecile
garbage filth vermin coward liar pig pigs hate ugly freak jerk bastard bitch crap damn shit fuck fucking asshole retard
cretin dimwit halfwit nitwit scumbag degenerate parasite lowlife
dumm dummkopf blöd blödmann arschloch scheisse scheiße trottel abschaum versager widerlich erbärmlich wertlos schwein
idioten drecksack miststück
imbécile connard connasse salaud ordure stupide débile crétin minable dégoûtant nul merde abruti pourriture déchet
idiota imbécil estúpido estúpida basura escoria inútil asqueroso asquerosa patético patética perdedor payaso mierda cabrón
gilipollas tonto tonta cerdo
""".split())
SECOND_PERSON = frozenset("you your yours yourself u ur youre you're du dich dir dein deine euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
_LEET = str.maketrans("0134578@$!|", "oleastbasil")
_EDGE = re.compile(r"^[^\w]+|[^\w]+$")
_INNER = re.compile(r"[^\W\d_][^\w\s'’.,\-/:]+[^\W\d_]|[^\W\d_]\d+[^\W\d_]")
_SPACED = re.compile(r"(?<!\w)(?:\w[ .*_-]){3,}\w(?!\w)")
SEED, WORD, START, SECOND, CAPS, ODD, HIDDEN, LOUD, MARKS, TITLE = (1 << k for k in range(10))


def bare(word: str) -> str:
    return _EDGE.sub("", word).lower()


def starts(word: str) -> list[str]:
    return [word[:k] for k in (4, 5, 6) if len(word) > k]


class Flags(dict):
    """raw word -> bits of what it is; emptied when it has 200,000 words."""

    def __init__(self, words: frozenset, prefixes: frozenset):
        super().__init__()
        self.words, self.prefixes = words, prefixes

    def __missing__(self, raw: str) -> int:
        if len(self) > 200_000:
            self.clear()
        w, f = bare(raw), 0
        if w:
            f |= SEED * (w in INSULTS) | WORD * (w in self.words) | SECOND * (w in SECOND_PERSON)
            f |= START * any(p in self.prefixes for p in starts(w))
            f |= CAPS * (len(w) > 1 and raw.isupper()) | TITLE * raw[:1].isupper()
        if _INNER.search(raw):
            f |= ODD
            plain = re.sub(r"[^\w]", "", raw.lower().translate(_LEET))
            f |= HIDDEN * (plain in INSULTS or plain in self.words)
        f |= LOUD * ("!" in raw) | MARKS * (len(raw) > 1 and not raw[-1].isalnum() and raw[-1] not in ".,")
        self[raw] = f
        return f


def features(text: str, flags: Flags) -> tuple[float, ...]:
    words = text.split()
    n = len(words)
    if not n:
        return (0.0,) * 16
    f = np.fromiter(map(flags.__getitem__, words), np.uint16, n)
    bad = f & (SEED | WORD | START | HIDDEN) != 0
    hits = np.flatnonzero(bad)
    near = 0
    if len(hits):
        reach = np.concatenate(([0], np.cumsum(f & SECOND != 0)))
        near = int((reach[np.minimum(hits + 5, n)] - reach[np.maximum(hits - 4, 0)] > 0).sum())
    rate = [float((f & bit != 0).sum()) for bit in (SEED, WORD, START, HIDDEN, SECOND, CAPS, ODD, LOUD, MARKS, TITLE)]
    per = 100.0 / n
    return (*(r * per for r in rate), len(hits) * per, float(min(len(hits), 20)), near * per, float(min(near, 20)), float(len(_SPACED.findall(text)) if "." in text or "*" in text or "_" in text or "-" in text else 0), float(np.log1p(n)))


def learn_lexicon(texts: list[str], labels: np.ndarray, least: int = 4, odds: float = 20.0) -> tuple[frozenset, frozenset]:
    """Words and word beginnings that are in at least `least` toxic texts and `odds` times as often as in the others."""
    n = np.bincount(labels, minlength=2)
    df = (Counter(), Counter())
    for text, y in zip(texts, labels.tolist(), strict=True):
        words = {bare(w) for w in set(text.split())}
        df[y].update(words | {f"^{p}" for w in words for p in starts(w)})
    found = []
    for term, k in df[1].items():
        ratio = (k + 0.5) / (n[1] + 1) / ((df[0][term] + 0.5) / (n[0] + 1))
        if k >= max(least, 0.004 * n[1]) and ratio >= odds and term not in ("", "^"):
            found.append((ratio, term))
    best = [t for _, t in sorted(found, key=lambda x: (-x[0], x[1]))[:LEXICON_TERMS]]
    return frozenset(t for t in best if t[0] != "^"), frozenset(t[1:] for t in best if t[0] == "^")


@dataclass
class Trees:
    """Boosted trees of a fixed depth on binned features, for log loss."""

    depth: int = 3
    rounds: int = 80
    rate: float = 0.15
    bins: int = 32
    leaf_weight: float = 1.0
    edges: list[np.ndarray] = field(default_factory=list)
    nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    base: float = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Trees":
        # edges at quantiles of the distinct values, so that rare values are told from the common zero
        self.edges = [np.unique(np.quantile(np.unique(x[:, j]), np.linspace(0, 1, self.bins)[1:-1])) for j in range(x.shape[1])]
        b = self._binned(x)
        width, features_ = self.bins, x.shape[1]
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            prob = 1 / (1 + np.exp(-score))
            g, h = y - prob, prob * (1 - prob)
            at = np.zeros(len(y), np.int64)
            feature, cut = np.zeros((1 << self.depth) - 1, np.int64), np.full((1 << self.depth) - 1, self.bins)
            for level in range(self.depth):
                n = 1 << level
                gains = np.full((n, features_, width), -np.inf)
                for j in range(features_):
                    cell = at * width + b[:, j]
                    gs = np.bincount(cell, g, n * width).reshape(n, width).cumsum(axis=1)
                    hs = np.bincount(cell, h, n * width).reshape(n, width).cumsum(axis=1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.leaf_weight) + (gt - gs) ** 2 / (ht - hs + self.leaf_weight) - gt**2 / (ht + self.leaf_weight)
                    gains[:, j] = np.where((hs > 0.5) & (ht - hs > 0.5), gain, -np.inf)
                flat = gains.reshape(n, -1)
                best = flat.argmax(axis=1)
                ok = flat[np.arange(n), best] > 1e-6
                first = n - 1
                feature[first : first + n] = best // width
                cut[first : first + n] = np.where(ok, best % width, self.bins)
                at = at * 2 + (b[np.arange(len(y)), feature[first + at]] > cut[first + at])
            leaves = 1 << self.depth
            value = self.rate * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + self.leaf_weight)
            self.nodes.append((feature, cut, value))
            score += value[at]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        rows, score = np.arange(len(x)), np.full(len(x), self.base)
        for feature, cut, value in self.nodes:
            at = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                first = (1 << level) - 1
                at = at * 2 + (b[rows, feature[first + at]] > cut[first + at])
            score += value[at]
        return score


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: scores and the non-decreasing share of ones at them."""
    xs, inv = np.unique(score, return_inverse=True)
    weight, total = np.bincount(inv).astype(float), np.bincount(inv, y)
    blocks: list[list[float]] = []  # sum, weight, members
    for t, w in zip(total.tolist(), weight.tolist(), strict=True):
        blocks.append([t, w, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            t2, w2, m2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + t2, blocks[-1][1] + w2, blocks[-1][2] + m2]
    return xs, np.repeat([b[0] / b[1] for b in blocks], [int(b[2]) for b in blocks])


@dataclass
class Model:
    words: frozenset
    prefixes: frozenset
    trees: Trees | None
    at: np.ndarray
    share: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:  # no labels of both kinds: a word of the fixed list decides
            return (x[:, 0] > 0).astype(float)
        return np.clip(np.interp(self.trees.raw(x), self.at, self.share), 0, 1)


def fit(texts: list[str], labels: list[int], seed: int = 7) -> Model:
    """Lexicon features are cross-fitted (each half's words are learned from the other half), the trees' scores too, and the
    calibration is fitted on the latter. Equal texts count once."""
    once = dict(zip(texts, labels, strict=True))
    texts, y = list(once), np.array(list(once.values()), np.int64)
    if len(np.unique(y)) < 2:
        return Model(frozenset(), frozenset(), None, np.empty(0), np.empty(0))
    rng = np.random.default_rng(seed)
    fold = rng.permutation(len(y)) % 2
    x = np.zeros((len(y), 16))
    for k in (0, 1):
        learn, use = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        flags = Flags(*learn_lexicon([texts[i] for i in learn], y[learn]))
        x[use] = np.array([features(texts[i], flags) for i in use]).reshape(-1, 16)
    parts = rng.permutation(len(y)) % 3
    out = np.zeros(len(y))
    for k in range(3):
        if len(np.unique(y[parts != k])) == 2:
            out[parts == k] = Trees().fit(x[parts != k], y[parts != k]).raw(x[parts == k])
    return Model(*learn_lexicon(texts, y), Trees().fit(x, y), *isotonic(out, y))


def held_out(doc_id: Column | str = "doc_id") -> Column:
    return F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string").cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits on labelled rows that aren't held out, at most sample_rows of them. A doc_id with several labels has the
    largest; null labels and null doc_ids don't count. The chosen ids, sample_rows at most, are broadcast."""
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic").toPandas()
    rows = rows.sort_values(["doc_id"], kind="stable")
    return fit([t or "" for t in rows["text"]], [int(t > 0) for t in rows["toxic"]])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score for each row of docs (doc_id, text). Null text: an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = Flags(model.words, model.prefixes)
        for batch in common.text_slices(batches):
            x = np.array([features(t, flags) for t in common.texts_of(batch)]).reshape(-1, 16)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(model.score(x), pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs.

    Null or empty text: scored from zero features. Rows that share a doc_id are scored each. A null doc_id isn't held
    out (its remainder is null) and is scored. Other columns are ignored. Without labels of both kinds the fixed list of
    insults decides.
    """
    out = score(docs, train(docs, labels, sample_rows))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs that the model doesn't call toxic, with all their columns."""
    model = train(docs, labels, sample_rows)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = Flags(model.words, model.prefixes)
        for batch in common.text_slices(batches):
            x = np.array([features(t, flags) for t in common.texts_of(batch)]).reshape(-1, 16)
            yield batch.filter(pa.array(model.score(x) < PREDICT_AT))

    return docs.mapInArrow(run, schema)
