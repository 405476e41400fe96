"""Command line: candidates and matches, training, training shards and validation."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from ..operators import blocking, learning, validate
from ..sources import tables
from . import pipeline


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="linkquarry")
    sub = out.add_subparsers(dest="command", required=True)
    for name in ("run", "train", "shard"):
        p = sub.add_parser(name)
        p.add_argument("data")
        p.add_argument("--output")
        p.add_argument("--prefix", default="train" if name != "run" else "test")
        p.add_argument("--budget", type=int, default=100 if name == "shard" else 50)
        p.add_argument("--bucket", type=int, default=100)
        p.add_argument("--token-df", type=int, default=2000)
        p.add_argument("--tfidf-top", type=int, default=40)
        p.add_argument("--no-tfidf", action="store_true")
        p.add_argument("--normalized-keys", action="store_true")
    sub.choices["run"].add_argument("--model")
    sub.choices["run"].add_argument("--threshold", type=float, default=0.5)
    p = sub.choices["train"]
    p.add_argument("--trees", type=int, default=100)
    p.add_argument("--rate", type=float, default=0.05)
    p.add_argument("--depth", type=int, default=5)
    p.add_argument("--ratio", type=float, default=0.2)
    p = sub.choices["shard"]
    p.add_argument("--shard", type=int, required=True)
    p.add_argument("--limit", type=int)
    p.add_argument("--format", choices=("parquet", "tsv"), default="parquet")
    p.add_argument("--no-resume", action="store_true")
    p = sub.add_parser("validate")
    p.add_argument("matching")
    p.add_argument("source1")
    p.add_argument("--candidates")
    p.add_argument("--targets", nargs="*", default=[])
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("linkquarry").getOrCreate()
    if a.command == "validate":
        targets = None
        for k, path in enumerate(a.targets):
            t = tables.read_pool(spark, path, f"S{k + 2}").select("entity_id")
            targets = t if targets is None else targets.unionByName(t)
        errors, warnings = validate.validate(spark, a.matching, a.candidates, tables.read_pool(spark, a.source1, "S1").select("entity_id"), targets)
        print("\n".join([*(f"warning: {w}" for w in warnings), *(f"error: {e}" for e in errors), "FAIL" if errors else "PASS"]))
        return int(bool(errors))
    how = blocking.Blocking(budget=a.budget, bucket=a.bucket, token_df=a.token_df, tfidf=not a.no_tfidf, tfidf_top=a.tfidf_top, key_mode="normalized" if a.normalized_keys else "raw")
    paths = pipeline.Paths(a.data, a.prefix)
    if a.command == "run":
        out = pipeline.run(spark, paths, a.output, a.model, a.threshold, how)
        print("\n".join([*out.warnings, *out.errors]) or "done")
        return int(bool(out.errors))
    if a.command == "train":
        _, threshold, score = pipeline.train(spark, paths, a.output, how, learning.Boosting(trees=a.trees, rate=a.rate, depth=a.depth), a.ratio)
        print(f"threshold {threshold}, macro F0.5 {score:.6f}")
        return 0
    print(pipeline.training_shard(spark, paths, a.shard, a.output, how, a.limit, a.format, not a.no_resume))
    return 0


if __name__ == "__main__":
    sys.exit(main())
