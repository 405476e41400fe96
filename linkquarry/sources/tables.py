"""Readers and writers of record tables, ground truth and results, on any file system that Spark reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from . import stage

RECORD = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])
TRUTH = T.StructType([T.StructField(c, T.StringType()) for c in ("source1_entity_id", "matched_entity_ids")])
# Other names that columns of records come under.
ALIASES = {
    "id": "entity_id", "s1_entity_id": "entity_id", "candidate_entity_id": "entity_id", "source1_entity_id": "entity_id",
    "name": "business_name", "company_name": "business_name", "address": "business_address", "addr": "business_address",
    "country_code": "country", "cntry": "country", "candidate_source": "source",
}


def read_tsv(spark: SparkSession, path: str, schema: T.StructType = RECORD) -> DataFrame:
    """A tab-separated table with a header, all strings; an empty cell is null. The schema is stated, so no file is read
    before the query needs it, and columns that it doesn't need aren't parsed."""
    return spark.read.schema(schema).option("sep", "\t").option("header", True).option("quote", "").csv(path)


def load(spark: SparkSession, data: DataFrame | str, schema: T.StructType = RECORD) -> DataFrame:
    """A DataFrame as it is, a path as TSV or (by its ending) Parquet. A missing path raises when it is resolved."""
    if isinstance(data, DataFrame):
        return data
    return spark.read.parquet(data) if data.rstrip("/").endswith(".parquet") else read_tsv(spark, data, schema)


def standardize(df: DataFrame, source: str | None = None) -> DataFrame:
    """entity_id, business_name, business_address, country, source from columns under any of their names (whatever the
    case): trimmed, null as empty, country in upper case; a missing column is empty, a missing source the given one."""
    found: dict[str, str] = {}
    for c in df.columns:
        found.setdefault(ALIASES.get(c.lower(), c.lower()), c)

    def column(name: str) -> Column:
        return text.strip(text.filled(df[found[name]].cast("string"))) if name in found else F.lit("")

    given = F.lit(source or "") if "source" not in found or source else column("source")
    return df.select(column("entity_id").alias("entity_id"), column("business_name").alias("business_name"), column("business_address").alias("business_address"), F.upper(column("country")).alias("country"), given.alias("source"))


def read_pool(spark: SparkSession, path: str, source: str) -> DataFrame:
    return standardize(load(spark, path), source)


def shard_of(entity_id: Column | str, shards: int = 2) -> Column:
    """The remainder of the id's MD5 by 2, by its last hexadecimal digit."""
    digit = F.conv(F.substring(F.md5((F.col(entity_id) if isinstance(entity_id, str) else entity_id).cast("binary")), 32, 1), 16, 10).cast("int")
    return F.pmod(digit, F.lit(shards))


def read_shard(spark: SparkSession, path: str, shard: int, limit: int | None = None) -> DataFrame:
    """The reference records of a shard; with a limit, those with the smallest ids."""
    out = read_pool(spark, path, "S1").filter(shard_of("entity_id") == shard)
    return out.orderBy("entity_id").limit(limit) if limit is not None else out


def id_lists(df: DataFrame, key: str, column: str) -> DataFrame:
    """Comma lists as arrays of trimmed, non-empty ids."""
    ids = F.filter(F.transform(F.split(text.filled(df[column]), ","), lambda x: text.strip(x)), lambda x: x != "")
    return df.select(text.strip(text.filled(df[key])).alias("s1_entity_id"), ids.alias("ids")).filter("s1_entity_id <> ''")


def read_truth(spark: SparkSession, data: DataFrame | str, only: DataFrame | None = None, singletons: bool = True) -> DataFrame:
    """s1_entity_id, ids (an array, empty for an entity without match). `only`: keeps the ids of that table."""
    out = id_lists(load(spark, data, TRUTH), "source1_entity_id", "matched_entity_ids")
    out = out if singletons else out.filter(F.size("ids") > 0)
    return out if only is None else out.join(only.select(F.col(only.columns[0]).alias("s1_entity_id")).distinct(), "s1_entity_id", "left_semi")


def truth_pairs(truth: DataFrame) -> DataFrame:
    """s1_entity_id, candidate_entity_id: a row for each distinct true link."""
    return truth.select("s1_entity_id", F.explode("ids").alias("candidate_entity_id")).distinct()


def spine(records: DataFrame) -> DataFrame:
    """The distinct non-empty ids of the reference table: every one of them has a row in results."""
    return records.select(text.strip(text.filled("entity_id")).alias("s1_entity_id")).filter("s1_entity_id <> ''").distinct()


def sampled(records: DataFrame, truth: DataFrame, pool: DataFrame, k: int, distractors: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """k reference rows with a true link, and from the pool their matches and so many other rows. The draw is by hash of the
    ids, so it is the same on any number of machines."""
    pairs = truth_pairs(truth)
    chosen = records.join(pairs.select(F.col("s1_entity_id").alias("entity_id")).distinct(), "entity_id", "left_semi").orderBy(F.xxhash64("entity_id", F.lit(seed)), "entity_id").limit(k)
    needed = pairs.join(chosen.select(F.col("entity_id").alias("s1_entity_id")), "s1_entity_id", "left_semi").select(F.col("candidate_entity_id").alias("entity_id")).distinct()
    others = pool.join(needed, "entity_id", "left_anti").orderBy(F.xxhash64("entity_id", F.lit(seed)), "entity_id").limit(distractors)
    return chosen, pool.join(needed, "entity_id", "left_semi").unionByName(others)


def write_tsv(df: DataFrame, path: str, files: int | None = None) -> None:
    """With a header; `files` bounds the number of files (1 for a submission that must be one). The table is made in full
    parallel first, so that only the copying runs in that many tasks."""
    if files is not None:
        df = stage.materialize(df, "result").coalesce(files)
    df.write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").csv(path)


def write_shards(df: DataFrame, path: str, form: str = "parquet") -> int:
    """Partitioned by shard, read back and counted; raises if the number of rows differs."""
    spark, rows = df.sparkSession, df.count()
    out = df.write.mode("overwrite").partitionBy("shard")
    out.parquet(path) if form == "parquet" else out.option("sep", "\t").option("header", True).csv(path)
    back = (spark.read.parquet(path) if form == "parquet" else spark.read.option("sep", "\t").option("header", True).csv(path)).count()
    if back != rows:
        raise RuntimeError(f"{path}: {back} rows instead of {rows}")
    return rows


def inspect(spark: SparkSession, path: str) -> DataFrame:
    """For each file its bytes, first line, delimiter (tab, else comma, else unknown), lines and rows without the header."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"), F.col("_metadata.file_block_start").alias("block"), "value", F.monotonically_increasing_id().alias("n"))
    out = lines.groupBy("file").agg(F.max("bytes").alias("bytes"), F.min_by("value", F.struct("block", "n")).alias("header"), F.count("*").alias("lines"))
    sniffed = F.when(F.col("header").contains("\t"), "tab").when(F.col("header").contains(","), "comma").otherwise("unknown")
    return out.select("file", "bytes", "header", sniffed.alias("delimiter"), "lines", (F.col("lines") - 1).alias("rows"))
