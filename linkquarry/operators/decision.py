"""From scored pairs to match lists, thresholds, metrics and error classes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..sources import tables


def listed(pairs: DataFrame, spine: DataFrame, out: str, order: Column | None = None) -> DataFrame:
    """source1_entity_id and a comma list of each spine row's candidates in order (by id without one), first occurrences
    alone; empty for those without any. A row's list is bounded by its candidates."""
    once = pairs.groupBy("s1_entity_id", "candidate_entity_id").agg(F.min(order if order is not None else F.lit(0)).alias("at"))
    lists = once.groupBy("s1_entity_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "candidate_entity_id"))), lambda x: x["candidate_entity_id"]), ",").alias(out))
    return spine.select("s1_entity_id").join(lists, "s1_entity_id", "left").select(F.col("s1_entity_id").alias("source1_entity_id"), F.coalesce(out, F.lit("")).alias(out))


def candidate_lists(pairs: DataFrame, spine: DataFrame) -> DataFrame:
    return listed(pairs, spine, "candidate_entity_ids", F.col("rank") if "rank" in pairs.columns else None)


def match_pairs(predictions: DataFrame) -> DataFrame:
    """s1_entity_id, candidate_entity_id, at from pairs or from lists (an array or comma string), repeated rows put together."""
    if "candidate_entity_id" in predictions.columns:
        at = F.col("rank") if "rank" in predictions.columns else F.lit(0)
        return predictions.select("s1_entity_id", "candidate_entity_id", at.alias("at"))
    key = "source1_entity_id" if "source1_entity_id" in predictions.columns else "s1_entity_id"
    column = next(c for c in predictions.columns if c != key)
    ids = F.col(column) if dict(predictions.dtypes)[column].startswith("array") else F.split(text.filled(column), ",")
    return predictions.select(F.col(key).alias("s1_entity_id"), F.posexplode(ids).alias("at", "id")).select("s1_entity_id", text.strip("id").alias("candidate_entity_id"), "at").filter("candidate_entity_id <> ''")


def match_lists(predictions: DataFrame, spine: DataFrame) -> DataFrame:
    return listed(match_pairs(predictions), spine, "matched_entity_ids", F.col("at"))


def check_threshold(threshold: float) -> None:
    if not 0 <= threshold <= 1:
        raise ValueError(f"a threshold lies between 0 and 1, not {threshold}")


def apply_threshold(scored: DataFrame, threshold: float, spine: DataFrame) -> DataFrame:
    """Lists of all candidates with a probability of `threshold` or more, best first, equal ones by id."""
    check_threshold(threshold)
    if missing := {"s1_entity_id", "candidate_entity_id", "match_probability"} - set(scored.columns):
        raise ValueError(f"missing columns: {sorted(missing)}")
    return listed(scored.filter(F.col("match_probability") >= threshold), spine, "matched_entity_ids", -F.col("match_probability"))


def inconsistent(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Matches that are no candidates (both as lists or pairs)."""
    pair = ["s1_entity_id", "candidate_entity_id"]
    return match_pairs(matches).select(*pair).distinct().join(match_pairs(candidates).select(*pair), pair, "left_anti")


def require_consistent(matches: DataFrame, candidates: DataFrame) -> None:
    if found := inconsistent(matches, candidates).limit(5).collect():
        raise ValueError(f"matches that are no candidates, such as {[tuple(r) for r in found]}")


# Metrics


def f_half(predicted: Column, true: Column, both: Column) -> Column:
    """F0.5 of an entity by its numbers of predicted, true and common links: 1 if it rightly has none, 0 if one side has none."""
    p, r = both / predicted, both / true
    return F.when((predicted == 0) & (true == 0), 1.0).when((predicted == 0) | (true == 0) | (both == 0), 0.0).otherwise(1.25 * p * r / (0.25 * p + r))


def per_entity(predicted: DataFrame, truth: DataFrame, spine: DataFrame) -> DataFrame:
    """s1_entity_id, n_predicted, n_true, n_both, precision, recall, f05 for every spine row. Both are pairs."""
    pair = ["s1_entity_id", "candidate_entity_id"]
    p = predicted.select(*pair).distinct().withColumn("p", F.lit(1))
    t = truth.select(*pair).distinct().withColumn("t", F.lit(1))
    n = p.join(t, pair, "full").groupBy("s1_entity_id").agg(F.count("p").alias("p"), F.count("t").alias("t"), F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("b"))
    rows = spine.select("s1_entity_id").join(n, "s1_entity_id", "left").select("s1_entity_id", *(F.coalesce(c, F.lit(0)).alias(a) for c, a in (("p", "n_predicted"), ("t", "n_true"), ("b", "n_both"))))
    share = lambda of: F.when((F.col("n_predicted") == 0) & (F.col("n_true") == 0), 1.0).when(F.col(of) == 0, 0.0).otherwise(F.col("n_both") / F.col(of))
    return rows.select("*", share("n_predicted").alias("precision"), share("n_true").alias("recall"), f_half(F.col("n_predicted"), F.col("n_true"), F.col("n_both")).alias("f05"))


def macro(entities: DataFrame) -> DataFrame:
    """One row: means over all entities, the share of entities without a match that got none, and the mean over those with
    several."""
    return entities.agg(
        F.count("*").alias("entities"), F.avg("f05").alias("macro_f05"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"),
        F.avg(F.when(F.col("n_true") == 0, F.col("f05"))).alias("singleton_accuracy"), F.avg(F.when(F.col("n_true") > 1, F.col("f05"))).alias("multi_match_f05"),
    )


def grid(low: float = 0.2, high: float = 0.9, step: float = 0.02) -> list[float]:
    if not (0 <= low <= high <= 1 and step > 0):
        raise ValueError(f"no grid: {low}, {high}, {step}")
    return [round(low + k * step, 10) for k in range(int((high - low) / step + 0.5 + 1e-9) + 1)]


def threshold_sweep(scored: DataFrame, truth: DataFrame, spine: DataFrame, thresholds: list[float]) -> DataFrame:
    """threshold, macro_f05 for each threshold over all spine rows.

    A pair counts at every threshold up to its score, so an entity's counts at all thresholds are conditional counts of
    one aggregation: pairs are shuffled once, whatever the grid, and never multiplied by it.
    """
    for t in thresholds:
        check_threshold(t)
    best = scored.groupBy("s1_entity_id", "candidate_entity_id").agg(F.max("match_probability").alias("p"))
    pairs = best.join(truth.select("s1_entity_id", "candidate_entity_id").distinct().withColumn("t", F.lit(1)), ["s1_entity_id", "candidate_entity_id"], "left")
    aggs = [F.struct(F.count_if(F.col("p") >= t).alias("p"), F.count_if((F.col("p") >= t) & F.col("t").isNotNull()).alias("b")).alias(f"_{k}") for k, t in enumerate(thresholds)]
    counts = pairs.groupBy("s1_entity_id").agg(*aggs)
    true = truth.select("s1_entity_id", "candidate_entity_id").distinct().groupBy("s1_entity_id").agg(F.count("*").alias("n_true"))
    rows = spine.select("s1_entity_id").join(counts, "s1_entity_id", "left").join(true, "s1_entity_id", "left").withColumn("n_true", F.coalesce("n_true", F.lit(0)))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    means = rows.agg(*[F.avg(f_half(zero(f"_{k}.p"), F.col("n_true"), zero(f"_{k}.b"))).alias(f"_{k}") for k in range(len(thresholds))])
    return means.select(F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"_{k}").alias("macro_f05")) for k, t in enumerate(thresholds)])).alias("x")).select("x.threshold", "x.macro_f05")


def best_threshold(scored: DataFrame, truth: DataFrame, spine: DataFrame, low: float = 0.2, high: float = 0.9, step: float = 0.02) -> tuple[float, float]:
    """The threshold with the highest macro F0.5, the lowest of equal ones, and that score."""
    row = threshold_sweep(scored, truth, spine, grid(low, high, step)).orderBy(F.desc(F.round("macro_f05", 12)), "threshold").first()
    return row.threshold, row.macro_f05


def recall(pairs: DataFrame, truth: DataFrame, spine: DataFrame) -> DataFrame:
    """One row: how many true links are candidates, candidates an entity, entities with all their links."""
    each = per_entity(pairs, truth, spine)
    return each.agg(
        F.sum("n_true").alias("links"), F.sum("n_both").alias("recalled"), (F.sum("n_both") / F.sum("n_true")).alias("recall"), F.avg("n_predicted").alias("avg_candidates"),
        F.count_if((F.col("n_true") > 0) & (F.col("n_both") == F.col("n_true"))).alias("full_recall"),
    )


def error_classes(predicted: DataFrame, truth: DataFrame, spine: DataFrame) -> DataFrame:
    """s1_entity_id, country, candidate_entity_id, kind: true_positive, false_positive, false_negative, or singleton_merge (a
    false link of an entity without match). spine has a country."""
    pair = ["s1_entity_id", "candidate_entity_id"]
    rows = predicted.select(*pair).distinct().withColumn("p", F.lit(1)).join(truth.select(*pair).distinct().withColumn("t", F.lit(1)), pair, "full")
    matched = truth.select("s1_entity_id").distinct().withColumn("m", F.lit(1))
    rows = rows.join(matched, "s1_entity_id", "left").join(spine.select("s1_entity_id", "country"), "s1_entity_id")
    kind = F.when(F.col("p").isNotNull() & F.col("t").isNotNull(), "true_positive").when(F.col("p").isNull(), "false_negative").when(F.col("m").isNull(), "singleton_merge").otherwise("false_positive")
    return rows.select("s1_entity_id", "country", "candidate_entity_id", kind.alias("kind"))


def error_summary(classes: DataFrame) -> DataFrame:
    return classes.groupBy("country", "kind").agg(F.count("*").alias("n"))


def error_examples(classes: DataFrame, top: int = 50) -> DataFrame:
    """The first `top` errors of each kind by ids."""
    kinds = ("false_positive", "false_negative", "singleton_merge")
    return reduce(DataFrame.unionAll, [classes.filter(F.col("kind") == k).orderBy("s1_entity_id", "candidate_entity_id").limit(top) for k in kinds])


def evaluate(candidates: DataFrame, scored: DataFrame, truth: DataFrame, spine: DataFrame, threshold: float) -> DataFrame:
    """One row: candidate recall and macro metrics at a threshold."""
    chosen = scored.filter(F.col("match_probability") >= threshold)
    return recall(candidates, tables.truth_pairs(truth), spine).crossJoin(macro(per_entity(chosen, tables.truth_pairs(truth), spine)))
