"""Rules of result files, as one long table of violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

EXAMPLES = 5
RULE = "rule string, n long, examples array<string>"
HEADERS = {"matched_entity_ids": ("source1_entity_id", "matched_entity_ids"), "candidate_entity_ids": ("source1_entity_id", "candidate_entity_ids")}


def id_rows(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a TSV but its header: line, s1 (trimmed), rest and whether there was a tab. The header is the first line
    of each file."""
    lines = spark.read.option("wholetext", False).text(path)
    parts = F.split("value", "\t", 2)
    return lines.select("value", text.strip(F.get(parts, F.lit(0))).alias("s1"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("rest"), (F.size(parts) == 2).alias("tab"))


def header_of(spark: SparkSession, path: str) -> str | None:
    row = spark.read.text(path).first()
    return None if row is None else row.value


def header_errors(header: str | None, column: str) -> list[str]:
    if not header:
        return ["empty file"]
    if "\t" not in header and "," in header:
        return ["comma-separated instead of tab-separated"]
    if tuple(c.strip().lower() for c in header.split("\t")) != HEADERS[column]:
        return ["wrong header"]
    return []


def rule_counts(rows: DataFrame, required: DataFrame, valid: DataFrame | None = None) -> DataFrame:
    """rule, n (distinct offenders), examples (the first by name) from rows (s1, rest, tab).

    Rules: malformed_row, duplicate_row, duplicate_in_list, self_match, wrong_prefix, unknown_id (if valid ids are given),
    missing_required, extra_entity. Every rule is an aggregation; examples are the smallest few, found by bounded minima.
    """
    body = rows.filter("tab")
    ids = F.when(text.strip("rest") == "", F.array().cast("array<string>")).otherwise(F.transform(F.split("rest", ","), lambda x: text.strip(x)))
    lists = body.select("s1", ids.alias("ids"))
    links = lists.select("s1", F.explode("ids").alias("id"))
    need = required.select(F.col(required.columns[0]).alias("s1")).distinct()
    offenders = {
        "malformed_row": rows.filter("NOT tab AND s1 <> ''").select(F.col("value").alias("x") if "value" in rows.columns else F.col("s1").alias("x")),
        "duplicate_row": body.groupBy("s1").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("s1").alias("x")),
        "duplicate_in_list": lists.filter(F.size("ids") != F.size(F.array_distinct("ids"))).select(F.col("s1").alias("x")),
        "self_match": links.filter(F.col("id").startswith("S1-")).select(F.col("id").alias("x")),
        "wrong_prefix": links.filter(~F.col("id").rlike("^S[123]-")).select(F.col("id").alias("x")),
        "missing_required": need.join(body, "s1", "left_anti").select(F.col("s1").alias("x")),
        "extra_entity": body.select("s1").distinct().join(need, "s1", "left_anti").select(F.col("s1").alias("x")),
    }
    if valid is not None:
        known = valid.select(F.col(valid.columns[0]).alias("id")).distinct()
        offenders["unknown_id"] = links.filter(F.col("id").rlike("^S[23]-")).join(known, "id", "left_anti").select(F.col("id").alias("x"))
    long = reduce(DataFrame.unionAll, [d.select(F.lit(r).alias("rule"), "x") for r, d in offenders.items()]).distinct()
    from pyspark.sql.window import Window

    # row_number <= 5 becomes a group limit before the shuffle, so a rule with many offenders isn't gathered
    first = long.withColumn("place", F.row_number().over(Window.partitionBy("rule").orderBy("x"))).filter(F.col("place") <= EXAMPLES)
    shown = first.groupBy("rule").agg(F.array_sort(F.collect_list("x")).alias("examples"))
    return long.groupBy("rule").agg(F.count("*").alias("n")).join(shown, "rule").select("rule", "n", "examples")


def validate(spark: SparkSession, matching: str, candidate: str | None, source1: DataFrame, targets: DataFrame | None = None) -> tuple[list[str], list[str]]:
    """Errors and warnings of a matching file and, if there is one, a candidate file."""
    errors: list[str] = []
    warnings: list[str] = []
    held = {}
    for path, column in ((matching, "matched_entity_ids"), (candidate, "candidate_entity_ids")):
        if path is None:
            warnings.append("no candidate file")
            continue
        header = header_of(spark, path)
        if found := header_errors(header, column):
            errors += [f"{path}: {x}" for x in found]
            continue
        rows = id_rows(spark, path).filter(F.col("value") != header)
        errors += [f"{path}: {r.rule}: {r.n}, such as {', '.join(r.examples)}" for r in rule_counts(rows, source1, targets).orderBy("rule").collect()]
        held[column] = rows.filter("tab").select(F.col("s1").alias("s1_entity_id"), F.explode(F.split("rest", ",")).alias("id")).filter("id <> ''")
    if len(held) == 2:
        n = held["matched_entity_ids"].join(held["candidate_entity_ids"], ["s1_entity_id", "id"], "left_anti").select("s1_entity_id").distinct().count()
        if n:
            warnings.append(f"{n} entities have matches that are no candidates")
    return errors, warnings
