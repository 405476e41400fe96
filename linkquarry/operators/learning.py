"""Training and applying the pair classifier: Spark's gradient-boosted trees, grown on distinct binned rows with counts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import stage
from .features import FEATURES, IDENTITY, model_features

#: Bins of a feature, as Spark's maxBins; five bits each, so twelve features are a long.
BINS = 32
PER_KEY = 12
KEYS = [f"k{i}" for i in range(-(-len(FEATURES) // PER_KEY))]
#: So many distinct binned rows a task boosts on (some 200 bytes each); more are left to Spark's own loop over all rows.
MOST_DISTINCT = 2_000_000


@dataclass(frozen=True)
class Boosting:
    trees: int = 100
    rate: float = 0.05
    depth: int = 5
    rows: float = 0.8
    columns: str = "0.8"
    tolerance: float = 0.001
    seed: int = 42


def check_training(rows: DataFrame) -> None:
    """Raises on wrong columns, labels other than 0 and 1, or features that are no numbers: one pass."""
    model_features(rows)
    bad = F.lit(False)
    for f in FEATURES:
        bad = bad | F.col(f).isNull() | F.isnan(f) | (F.abs(f) == float("inf"))
    found = rows.agg(F.count("*").alias("rows"), F.count_if(F.col("label").isNull() | ~F.col("label").isin(0, 1)).alias("labels"), F.count_if(bad).alias("features")).first()
    if not found.rows or found.labels or found.features:
        raise ValueError(f"{found.rows} rows, {found.labels} with a bad label, {found.features} with a bad feature")


def train(training: DataFrame, validation: DataFrame | None = None, how: Boosting = Boosting(), path: str | None = None) -> PipelineModel:
    """Fits on feature rows with labels; with validation rows boosting stops when they don't improve. Saved to path.

    Trees see bins, so rows with the same bins are one with counts by label: every tree's sample then is a binomial draw
    from each count, which is what drawing the rows one by one gives."""
    check_training(training)
    rows = training.select(*FEATURES, F.col("label").cast("double").alias("label"), F.lit(False).alias("held"))
    gbt = GBTClassifier(labelCol="label", featuresCol="features", maxIter=how.trees, stepSize=how.rate, maxDepth=how.depth, subsamplingRate=how.rows, featureSubsetStrategy=how.columns, seed=how.seed, validationTol=how.tolerance)
    if validation is not None:
        rows = rows.unionByName(validation.select(*FEATURES, F.col("label").cast("double").alias("label"), F.lit(True).alias("held")))
        gbt = gbt.setValidationIndicatorCol("held")
    cuts = split_points(rows.filter(~F.col("held")))
    distinct = stage.materialize(binned(rows, cuts), "binned")
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    if distinct.count() > MOST_DISTINCT:
        model = Pipeline(stages=[assembler, gbt]).fit(stage.materialize(rows, "boosting"))
    else:
        model = PipelineModel([assembler, spark_model(gbt, boost(distinct, cuts, how, validation is not None), cuts, how.rate)])
    if path:
        model.write().overwrite().save(path)
    return model


def split_points(rows: DataFrame) -> list[np.ndarray]:
    """Of each feature at most BINS - 1 rising thresholds, as Spark chooses them: between all values where they are few, else
    after equal shares of the rows. Values that agree in eleven binary digits are counted as one, so cells are bounded."""
    import pyarrow as pa

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for j, x in enumerate(b.columns):
                x = np.sort(x.to_numpy(zero_copy_only=False)) + 0.0
                key = x.view(np.int64) >> 42
                first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))[: len(key)])
                end = np.append(first[1:], len(x))
                yield pa.record_batch({"feature": np.full(len(first), j, np.int32), "cell": key[first], "n": end - first, "low": x[first], "high": x[end - 1]})

    found = rows.select(*FEATURES).mapInArrow(cells, "feature int, cell long, n long, low double, high double")
    found = found.groupBy("feature", "cell").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).drop("cell").toPandas()
    out = []
    for j in range(len(FEATURES)):
        one = found[found.feature == j].sort_values("low")
        n, between = one.n.to_numpy(), (one.high.to_numpy()[:-1] + one.low.to_numpy()[1:]) / 2
        if len(between) >= BINS:
            # a cut lies where the rows before it come nearest to a multiple of the share
            upto = np.cumsum(n)[:-1]
            want = np.arange(1, BINS) * (n.sum() / BINS)
            at = np.clip(np.searchsorted(upto, want), 1, len(upto) - 1)
            between = between[np.unique(np.where(want - upto[at - 1] < upto[at] - want, at - 1, at))]
        out.append(between)
    return out


def binned(rows: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """The bins of rows as longs, and how many rows with them are for training (t0, t1 by label) and held out (h0, h1)."""
    import pyarrow as pa

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [np.zeros(b.num_rows, np.int64) for _ in KEYS]
            for j, c in enumerate(cuts):
                keys[j // PER_KEY] |= np.searchsorted(c, b.column(j).to_numpy(zero_copy_only=False), "left") << (5 * (j % PER_KEY))
            kind = b.column("label").to_numpy(zero_copy_only=False).astype(np.int64) + 2 * b.column("held").to_numpy(zero_copy_only=False)
            order = np.lexsort(keys)
            new = np.zeros(b.num_rows, bool)
            new[:1] = True
            for k in keys:
                new[1:] |= k[order[1:]] != k[order[:-1]]
            which, first = np.cumsum(new) - 1, order[new]
            n = np.bincount(which * 4 + kind[order], minlength=4 * len(first)).reshape(-1, 4)
            yield pa.record_batch(dict(zip(KEYS, (k[first] for k in keys), strict=True)) | {c: n[:, i] for i, c in enumerate(("t0", "t1", "h0", "h1"))})

    out = rows.select(*FEATURES, "label", "held").mapInArrow(distinct, ", ".join(f"{c} long" for c in (*KEYS, "t0", "t1", "h0", "h1")))
    return out.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in ("t0", "t1", "h0", "h1")])


@dataclass
class Tree:
    """Nodes in heap order from 1: the feature and bin of a split (a bin up to it goes left; feature -1 is a leaf), and the
    weight, sum and sum of squares of what came there."""

    feature: np.ndarray
    cut: np.ndarray
    gain: np.ndarray
    stats: np.ndarray

    def values(self) -> np.ndarray:
        return np.divide(self.stats[:, 1], self.stats[:, 0], out=np.zeros(len(self.stats)), where=self.stats[:, 0] > 0)


def boost(distinct: DataFrame, cuts: list[np.ndarray], how: Boosting, validate: bool) -> list[Tree]:
    """The trees of Spark's boosting for log loss, grown in a task; the driver sees their nodes alone."""
    import pyarrow as pa

    names = [f.name for f in fields(Tree)]

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        column = lambda c: table.column(c).to_numpy()
        order = np.lexsort([column(k) for k in KEYS])
        keys = [column(k)[order] for k in KEYS]
        bins = np.stack([(keys[j // PER_KEY] >> (5 * (j % PER_KEY)) & (BINS - 1)).astype(np.uint8) for j in range(len(FEATURES))])
        t, h = (np.stack([column(f"{c}{y}")[order] for y in (0, 1)]) for c in "th")
        for m, tree in enumerate(boosted(bins, [len(c) for c in cuts], t, h, how, validate)):
            yield pa.record_batch({"tree": np.full(len(tree.gain), m, np.int32)} | {c: getattr(tree, c) for c in names[:3]} | {c: tree.stats[:, i] for i, c in enumerate("nst")})

    nodes = distinct.coalesce(1).mapInArrow(grown, "tree int, feature long, cut long, gain double, n double, s double, t double").toArrow()
    number = nodes.column("tree").to_numpy()
    of = {c: nodes.column(c).to_numpy() for c in nodes.column_names}
    stats = np.stack([of[c] for c in "nst"], axis=1)
    return [Tree(*(of[c][number == m] for c in names[:3]), stats[number == m]) for m in range(number.max() + 1)]


def boosted(bins: np.ndarray, sizes: list[int], t: np.ndarray, h: np.ndarray, how: Boosting, validate: bool) -> list[Tree]:
    """Trees from the bins of distinct rows and their counts by label (labels are -1 and 1, the first tree has weight 1)."""
    random = np.random.default_rng(how.seed)
    score = np.zeros(bins.shape[1])
    trees: list[Tree] = []
    best, size = np.inf, 1
    for m in range(how.trees):
        drawn = random.binomial(t, how.rows) if how.rows < 1 else t
        y = np.array([[-1.0], [1.0]])
        target = np.broadcast_to(y, t.shape) if not m else 4 * y / (1 + np.exp(2 * y * score))
        tree, leaf = grow(bins, sizes, drawn, target, how, random)
        trees.append(tree)
        score += tree.values()[leaf] * (how.rate if m else 1.0)
        if validate:
            error = float((h * 2 * np.logaddexp(0, -2 * y * score)).sum() / h.sum()) if h.sum() else np.nan
            if m and best - error < how.tolerance * max(error, 0.01):
                break
            if error < best:
                best, size = error, m + 1
    return trees[:size] if validate else trees


def grow(bins: np.ndarray, sizes: list[int], drawn: np.ndarray, target: np.ndarray, how: Boosting, random: np.random.Generator) -> tuple[Tree, np.ndarray]:
    """A regression tree level by level, and the node of every row. Of two siblings the one with fewer rows is counted, the
    other is what is left of their parent."""
    total = 1 << (how.depth + 1)
    w, s = drawn.sum(0).astype(float), (drawn * target).sum(0)
    tree = Tree(np.full(total, -1), np.zeros(total, np.int64), np.zeros(total), np.zeros((total, 3)))
    node = np.ones(len(w), np.int64)
    tree.stats[1] = w.sum(), s.sum(), (drawn * target**2).sum()
    each = columns_per_node(how.columns)
    same = [next(i for i in range(j + 1) if np.array_equal(bins[i], bins[j])) for j in range(len(bins))]

    def histogram(at: np.ndarray) -> np.ndarray:
        out = np.zeros((2, len(bins), BINS))
        ww, ss = w[at], s[at]
        for j, n in enumerate(sizes):
            if same[j] < j:
                out[:, j] = out[:, same[j]]
            elif n:
                b = bins[j][at]
                out[0, j], out[1, j] = np.bincount(b, ww, BINS), np.bincount(b, ss, BINS)
        return out

    members = {1: np.arange(len(w))}
    counted = {1: histogram(members[1])}
    for _ in range(how.depth):
        below, below_counted = {}, {}
        for k, at in members.items():
            all_w, all_s = tree.stats[k, :2]
            chosen = np.sort(random.choice(len(bins), each, replace=False))
            left_w, left_s = np.cumsum(counted[k][:, chosen], axis=2)[:, :, :-1]
            right_w, right_s = all_w - left_w, all_s - left_s
            ok = (left_w >= 0.5) & (right_w >= 0.5)
            gain = np.where(ok, left_s**2 / np.where(ok, left_w, 1) + right_s**2 / np.where(ok, right_w, 1) - all_s**2 / max(all_w, 1), -1.0)
            j, c = np.unravel_index(int(gain.argmax()), gain.shape)
            if gain[j, c] <= 1e-12 * max(1.0, tree.stats[k, 2]):
                continue
            tree.feature[k], tree.cut[k], tree.gain[k] = chosen[j], c, gain[j, c] / all_w
            right = bins[chosen[j]][at] > c
            parts = at[~right], at[right]
            for side, part in enumerate(parts):
                node[part] = 2 * k + side
                below[2 * k + side] = part
                d, v = drawn[:, part], target[:, part]
                tree.stats[2 * k + side] = d.sum(), (d * v).sum(), (d * v * v).sum()
            small = int(len(parts[1]) < len(parts[0]))
            below_counted[2 * k + small] = histogram(parts[small])
            below_counted[2 * k + 1 - small] = counted[k] - below_counted[2 * k + small]
        members, counted = below, below_counted
    return tree, node


def columns_per_node(columns: str) -> int:
    """Spark's reading of a feature subset strategy that is a number or names all."""
    if columns in ("all", "auto"):
        return len(FEATURES)
    if columns in ("sqrt", "log2", "onethird"):
        return {"sqrt": int(np.ceil(np.sqrt(len(FEATURES)))), "log2": max(1, int(np.ceil(np.log2(len(FEATURES))))), "onethird": int(np.ceil(len(FEATURES) / 3))}[columns]
    return min(int(columns), len(FEATURES)) if columns.isdigit() else int(np.ceil(float(columns) * len(FEATURES)))


def spark_model(gbt: GBTClassifier, trees: list[Tree], cuts: list[np.ndarray], rate: float) -> GBTClassificationModel:
    """The same trees as a model of Spark's, which can be saved and applied as one that Spark fitted."""
    gateway = SparkSession.active().sparkContext._gateway
    jvm = gateway.jvm
    kinds = jvm.org.apache.spark.ml.tree

    def array(kind: object, values: list) -> object:
        out = gateway.new_array(kind, len(values))
        for i, v in enumerate(values):
            out[i] = v
        return out

    def build(tree: Tree, value: np.ndarray, k: int) -> object:
        n, s, ss = tree.stats[k].tolist()
        spread = max(0.0, ss / n - (s / n) ** 2) if n else 0.0
        stats = jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator(array(jvm.double, [n, s, ss]), int(n))
        if tree.feature[k] < 0:
            return kinds.LeafNode(float(value[k]), spread, stats)
        j = int(tree.feature[k])
        split = kinds.ContinuousSplit(j, float(cuts[j][tree.cut[k]]))
        return kinds.InternalNode(float(value[k]), spread, float(tree.gain[k]), build(tree, value, 2 * k), build(tree, value, 2 * k + 1), split, stats)

    regression = jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel
    made = [regression(f"{gbt.uid}_tree{i}", build(t, t.values(), 1), len(FEATURES)) for i, t in enumerate(trees)]
    java = jvm.org.apache.spark.ml.classification.GBTClassificationModel(gbt.uid, array(regression, made), array(jvm.double, [rate if i else 1.0 for i in range(len(made))]), len(FEATURES), 2)
    model = GBTClassificationModel(java)
    model._resetUid(gbt.uid)
    return gbt._copyValues(model)


def load_model(spark: SparkSession, model: PipelineModel | str) -> PipelineModel:
    if isinstance(model, PipelineModel):
        return model
    if not isinstance(model, str):
        raise TypeError(f"a model or its path, not {type(model).__name__}")
    return PipelineModel.load(model)


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """s1_entity_id, candidate_entity_id, match_probability within 0 and 1, a row for each row."""
    if missing := [c for c in IDENTITY[:2] if c not in rows.columns]:
        raise ValueError(f"missing columns: {missing}")
    model_features(rows)
    p = vector_to_array("probability")[1]
    return model.transform(rows).select(*IDENTITY[:2], F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)).alias("match_probability"))
