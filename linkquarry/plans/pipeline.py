"""The whole flow: candidates, features, training, scoring, results and their validation, and the build of training shards."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from ..operators import blocking, decision, features, learning, validate
from ..sources import stage, tables


@dataclass(frozen=True)
class Paths:
    """The tables of a data folder; every one can be named otherwise."""

    folder: str
    prefix: str = "train"
    source1: str | None = None
    source2: str | None = None
    source3: str | None = None
    truth: str | None = None

    def of(self, name: str) -> str:
        given = {"source1": self.source1, "source2": self.source2, "source3": self.source3, "ground_truth": self.truth}[name]
        return given or f"{self.folder.rstrip('/')}/{self.prefix}_{name}.tsv"

    def missing(self, spark: SparkSession, names: tuple[str, ...] = ("source1", "source2", "source3")) -> list[str]:
        """Which of the tables aren't there, on whatever file system."""
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        paths = [(n, jvm.org.apache.hadoop.fs.Path(self.of(n))) for n in names]
        return [n for n, p in paths if not p.getFileSystem(conf).exists(p)]


@dataclass
class Result:
    candidates: DataFrame
    candidate_lists: DataFrame
    scored: DataFrame | None = None
    matches: DataFrame | None = None
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


def read_sources(spark: SparkSession, paths: Paths) -> tuple[DataFrame, DataFrame]:
    if missing := paths.missing(spark):
        raise FileNotFoundError(f"not found: {', '.join(paths.of(n) for n in missing)}")
    pool = tables.read_pool(spark, paths.of("source2"), "S2").unionByName(tables.read_pool(spark, paths.of("source3"), "S3"))
    return tables.read_pool(spark, paths.of("source1"), "S1"), pool


def run(spark: SparkSession, paths: Paths, output: str | None = None, model: PipelineModel | str | None = None, threshold: float = 0.5, how: blocking.Blocking = blocking.Blocking(budget=50), check: bool = True) -> Result:
    """Candidates for all reference records and, with a model, scored pairs and match lists; written to `output` (one file
    each, as results must be) and validated there. Prepared records, candidate pairs
    and scores are written on the way, as several results read each."""
    s1, pool = read_sources(spark, paths)
    spine = tables.spine(s1)
    mine, ready = blocking.prepared(s1, how), blocking.prepared(pool, how)
    pairs = stage.materialize(blocking.candidates(mine, ready, how), "candidates")
    out = Result(pairs, decision.candidate_lists(pairs, spine))
    if model is not None:
        rows = features.pair_features(pairs, mine, ready, how.compose)
        out.scored = stage.materialize(learning.predict(learning.load_model(spark, model), rows), "scored")
        out.matches = decision.apply_threshold(out.scored, threshold, spine)
    if output:
        tables.write_tsv(out.candidate_lists, f"{output}/candidate_pairs.tsv", files=1)
        if out.matches is not None:
            tables.write_tsv(out.matches, f"{output}/matching_results.tsv", files=1)
            if check:
                out.errors, out.warnings = validate.validate(spark, f"{output}/matching_results.tsv", f"{output}/candidate_pairs.tsv", s1.select("entity_id"), pool.select("entity_id"))
    return out


def training_shard(spark: SparkSession, paths: Paths, shard: int, output: str | None = None, how: blocking.Blocking = blocking.Blocking(), limit: int | None = None, form: str = "parquet", resume: bool = True) -> dict:
    """Labelled feature rows of a shard of the reference table, checked, written under shard=<n> and read back; returns
    their statistics. A shard that is there already is read instead (`resume`), with the columns and types that a re-run
    would give."""
    s1 = tables.read_shard(spark, paths.of("source1"), shard, limit)
    _, pool = read_sources(spark, paths)
    truth = tables.read_truth(spark, paths.of("ground_truth"), only=s1.select("entity_id"))
    target = f"{output.rstrip('/')}/shard={shard}" if output else None
    done = False
    if target and resume:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(f"{target}/_SUCCESS")
        done = p.getFileSystem(conf).exists(p)
    if not done:
        mine, ready = blocking.prepared(s1, how), blocking.prepared(pool, how)
        rows = features.training_rows(blocking.candidates(mine, ready, how), mine, ready, truth)
        if target:
            writer = rows.write.mode("overwrite")
            writer.parquet(target) if form == "parquet" else writer.option("sep", "\t").option("header", True).csv(target)
    if target:
        reader = spark.read.schema(features.TRAINING_ROW)
        rows = reader.parquet(target) if form == "parquet" else reader.option("sep", "\t").option("header", True).csv(target)
    return features.require_valid(features.shard_checks(rows, s1, truth, shard))


def train(spark: SparkSession, paths: Paths, model_path: str | None = None, how: blocking.Blocking = blocking.Blocking(budget=50), boosting: learning.Boosting = learning.Boosting(), ratio: float = 0.2) -> tuple[PipelineModel, float, float]:
    """A model fitted on all shards, its threshold chosen on held-out entities, and the macro F0.5 there. Entities without
    match count in it."""
    s1, pool = read_sources(spark, paths)
    truth = tables.read_truth(spark, paths.of("ground_truth"))
    mine, ready = blocking.prepared(s1, how), blocking.prepared(pool, how)
    rows = stage.materialize(features.training_rows(blocking.candidates(mine, ready, how), mine, ready, truth), "training-rows")
    ids = features.split_ids(tables.spine(s1), ratio, boosting.seed)
    held = ids.filter("validation").select("s1_entity_id")
    training, validation = rows.join(held, "s1_entity_id", "left_anti"), rows.join(held, "s1_entity_id", "left_semi")
    model = learning.train(training, validation, boosting, model_path)
    scored = learning.predict(model, validation.drop("label"))
    threshold, score = decision.best_threshold(scored, tables.truth_pairs(truth).join(held, "s1_entity_id", "left_semi"), held)
    return model, threshold, score
