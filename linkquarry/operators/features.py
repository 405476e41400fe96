"""The 18 features of a candidate pair, labels, shards and their checks.

Normal forms, tokens and grams are made once a record, before the pair join, so a pair costs set operations alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed, text
from ..sources import stage, tables

FEATURES = fixed.MODEL_FEATURES
IDENTITY = ("s1_entity_id", "candidate_entity_id", "candidate_source")
#: Columns and types of a training shard's file.
TRAINING_ROW = ", ".join([*(f"{c} string" for c in IDENTITY), *(f"{f} double" for f in FEATURES), "label int"])


#: Features that two names, or two addresses and house numbers, have whatever their records are.
OF_NAMES = ("name_token_jaccard", "name_token_overlap_count", "name_char_ngram_cosine", "name_edit_similarity", "name_length_ratio", "name_exact_match", "name_first_token_match")
OF_ADDRESSES = ("address_token_jaccard", "address_token_overlap_count", "address_house_number_match", "address_edit_similarity", "address_length_ratio", "address_missing")
#: Tables of at most so many pairs of names are sent to all tasks.
SENT_PAIRS = 50_000


def describe(records: DataFrame, compose: bool = True) -> DataFrame:
    """entity_id, source, country, name, address, house of a record. Prepared records keep the forms that they have."""
    if "norm_name" in records.columns:
        return records.select("entity_id", "source", "country", F.col("norm_name").alias("name"), F.col("norm_address").alias("address"), "house")
    name, address = text.normalize_name("business_name", compose=compose), text.normalize_address("business_address", compose=compose)
    return records.select("entity_id", "source", "country", name.alias("name"), address.alias("address"), text.house_number("business_address", compose=compose).alias("house"))


def _forms(records: DataFrame, columns: list[str], number: str) -> DataFrame:
    """The distinct values of columns with numbers."""
    return stage.materialize(records.select(*columns).distinct().withColumn(number, F.monotonically_increasing_id()), number)


def _both(met: DataFrame, forms: DataFrame, number: str) -> DataFrame:
    """Each pair of numbers that occurs once, with the forms of both sides as a_ and b_ columns."""
    side = lambda p: forms.select(*[F.col(c).alias(f"{p}_{c}") for c in forms.columns])
    a, b = f"a_{number}", f"b_{number}"
    return met.select(a, b).distinct().join(side("a"), a).join(side("b"), b)


def pair_features(pairs: DataFrame, s1: DataFrame, pool: DataFrame, compose: bool = True, links: DataFrame | None = None) -> DataFrame:
    """pairs (the identity columns) with records of both sides -> identity and features, a row for each pair. A pair whose
    record is missing, or whose source is neither S2 nor S3, raises.

    Pairs are of numbers of names and of addresses; what two of them give is found once and comes back by their numbers.
    With links (entity_id, links: what true links have in common, as an array) there is a label: 1 where two records have
    one in common."""
    records = stage.materialize(describe(s1, compose).withColumn("side", F.lit("a")).unionByName(describe(pool, compose).withColumn("side", F.lit("b"))), "described")
    names, addresses = _forms(records, ["name"], "n"), _forms(records, ["address", "house"], "d")
    country = lambda x: F.lower(text.strip(text.filled(x)))
    rows = records.join(names.withColumnRenamed("name", "_name"), F.col("name").eqNullSafe(F.col("_name")))
    rows = rows.join(addresses.select("d", F.col("address").alias("_address"), F.col("house").alias("_house")), F.col("address").eqNullSafe(F.col("_address")) & F.col("house").eqNullSafe(F.col("_house")))
    rows = rows.select("side", "entity_id", "source", country("country").alias("country"), "n", "d")
    if links is not None:
        rows = rows.join(links, "entity_id", "left")
    rows = stage.materialize(rows, "numbered")
    side = lambda p: rows.filter(F.col("side") == p).select(*[F.col(c).alias(f"{p}_{c}") for c in rows.columns if c != "side"])
    known = F.col("candidate_source").isin("S2", "S3")
    met = pairs.select(*IDENTITY).join(side("a"), F.col("s1_entity_id") == F.col("a_entity_id"), "left")
    met = met.join(side("b"), (F.col("candidate_entity_id") == F.col("b_entity_id")) & (F.col("candidate_source") == F.col("b_source")), "left")
    met = met.filter(F.assert_true(known, F.concat(F.lit("unknown source: "), F.coalesce("candidate_source", F.lit("null")))).isNull())
    met = met.filter(F.assert_true(F.col("a_entity_id").isNotNull() & F.col("b_entity_id").isNotNull(), F.concat(F.lit("no record: "), F.concat_ws(" ", "s1_entity_id", "candidate_entity_id"))).isNull())
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    label = {} if links is None else {"label": flag(F.arrays_overlap("a_links", "b_links")).cast("int")}
    same = {"country_match": flag((F.col("a_country") == F.col("b_country")) & (F.col("a_country") != ""))}
    same |= {f"source_is_{s.lower()}": flag(F.upper(text.strip(F.col("candidate_source"))) == s) for s in ("S2", "S3")}
    met = stage.materialize(met.select(*IDENTITY, "a_n", "b_n", "a_d", "b_d", *[c.alias(k) for k, c in (same | label).items()]), "pair-forms")
    by_name = stage.materialize(_name_features(_both(met, _name_parts(names), "n")), "name-features")
    by_address = stage.materialize(_address_features(_both(met, addresses.withColumn("set", text.address_tokens(F.col("address"))), "d")), "address-features")
    out = met.join(F.broadcast(by_name) if by_name.count() <= SENT_PAIRS else by_name, ["a_n", "b_n"]).join(by_address, ["a_d", "b_d"])
    twice = {f"{p}_length_ratio_context": F.col(f"{p}_length_ratio") for p in ("name", "address")}
    return out.select(*IDENTITY, *(twice.get(f, F.col(f)).alias(f) for f in FEATURES), *label)


def _name_parts(names: DataFrame) -> DataFrame:
    tokens = text.name_tokens(F.col("name"))
    return names.select("n", "name", F.array_distinct(tokens).alias("set"), F.get(tokens, F.lit(0)).alias("first"), *[text.grams(F.col("name"), n).alias(f"grams{n}") for n in (2, 3)])


def _name_features(rows: DataFrame) -> DataFrame:
    c = {n: F.col(n) for n in rows.columns}
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    value = {
        "name_token_jaccard": text.jaccard(c["a_set"], c["b_set"]),
        "name_token_overlap_count": text.overlap(c["a_set"], c["b_set"]),
        "name_char_ngram_cosine": (text.gram_cosine(c["a_name"], c["b_name"], c["a_grams2"], c["b_grams2"]) + text.gram_cosine(c["a_name"], c["b_name"], c["a_grams3"], c["b_grams3"])) / 2,
        "name_edit_similarity": text.edit_similarity(c["a_name"], c["b_name"]),
        "name_length_ratio": text.length_ratio(c["a_name"], c["b_name"]),
        "name_exact_match": flag((c["a_name"] == c["b_name"]) & (c["a_name"] != "")),
        "name_first_token_match": flag(c["a_first"] == c["b_first"]),
    }
    return rows.select("a_n", "b_n", *(value[f].cast("double").alias(f) for f in OF_NAMES))


def _address_features(rows: DataFrame) -> DataFrame:
    c = {n: F.col(n) for n in rows.columns}
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    value = {
        "address_token_jaccard": text.jaccard(c["a_set"], c["b_set"]),
        "address_token_overlap_count": text.overlap(c["a_set"], c["b_set"]),
        "address_house_number_match": flag(c["a_house"] == c["b_house"]),
        "address_edit_similarity": text.edit_similarity(c["a_address"], c["b_address"]),
        "address_length_ratio": text.length_ratio(c["a_address"], c["b_address"]),
        "address_missing": flag((c["a_address"] == "") | (c["b_address"] == "")),
    }
    return rows.select("a_d", "b_d", *(value[f].cast("double").alias(f) for f in OF_ADDRESSES))


def model_features(df: DataFrame) -> DataFrame:
    """Exactly the feature columns in their order; raises on missing or unexpected ones (identity and label aside)."""
    missing = [f for f in FEATURES if f not in df.columns]
    extra = [c for c in df.columns if c not in (*FEATURES, *IDENTITY, "label", "shard")]
    if missing or extra:
        raise ValueError(f"missing features: {missing}; unexpected columns: {extra}")
    return df.select(*FEATURES)


def labelled(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """pairs with label 1 where the truth (s1_entity_id, ids) has the link, else 0; no pair is added."""
    links = tables.truth_pairs(truth).withColumn("label", F.lit(1))
    return pairs.join(links, ["s1_entity_id", "candidate_entity_id"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def training_rows(pairs: DataFrame, s1: DataFrame, pool: DataFrame, truth: DataFrame) -> DataFrame:
    return labelled(pair_features(pairs, s1, pool), truth).select(*IDENTITY, *FEATURES, "label")


def shard_checks(rows: DataFrame, s1: DataFrame, truth: DataFrame, shard: int) -> DataFrame:
    """One row: violations of a training shard and its statistics. average candidates count every s1 row, the median those
    that have candidates; at_max compares to the largest number that occurs."""
    bad = [F.count_if(F.col(f).isNull() | F.isnan(f) | (F.abs(f) == float("inf"))) for f in FEATURES if f in rows.columns]
    total = bad[0] if bad else F.lit(0)
    for b in bad[1:]:
        total = total + b
    basic = rows.agg(
        F.count("*").alias("pairs"), F.count_if(tables.shard_of("s1_entity_id") != shard).alias("wrong_shard"), (F.count("*") - F.count_distinct("s1_entity_id", "candidate_entity_id")).alias("duplicates"),
        F.count_if(~F.col("candidate_source").isin("S2", "S3")).alias("bad_source"), F.count_if(F.col("label").isNull() | ~F.col("label").isin(0, 1)).alias("bad_label"), total.alias("bad_feature"),
        F.count_if(F.col("candidate_source") == "S2").alias("from_s2"), F.count_if(F.col("candidate_source") == "S3").alias("from_s3"), F.count_if(F.col("label") == 1).alias("positive"),
    )
    each = tables.spine(s1).join(rows.groupBy("s1_entity_id").agg(F.count("*").alias("n")), "s1_entity_id", "left").agg(
        F.count("*").alias("s1_rows"), F.avg(F.coalesce("n", F.lit(0))).alias("avg_candidates"), F.median("n").alias("median_candidates"), F.max("n").alias("max_candidates"), F.count_if(F.col("n").isNull()).alias("without_candidates"), F.max_by("n", "n").alias("_max"),
    ).drop("_max")
    top = rows.groupBy("s1_entity_id").agg(F.count("*").alias("n"))
    at_max = top.groupBy("n").agg(F.count("*").alias("k")).agg(F.max_by("k", "n").alias("at_max"))
    links = tables.truth_pairs(truth).join(tables.spine(s1), "s1_entity_id", "left_semi")
    found = links.join(rows.select("s1_entity_id", "candidate_entity_id").distinct().withColumn("hit", F.lit(1)), ["s1_entity_id", "candidate_entity_id"], "left").agg(F.count("*").alias("links"), F.count("hit").alias("recalled"))
    # four one-row tables
    return basic.crossJoin(each).crossJoin(at_max).crossJoin(found)


def require_valid(checks: DataFrame) -> dict:
    """The checks' row as a dict; raises if there is a violation."""
    row = checks.first().asDict()
    if wrong := {k: v for k, v in row.items() if k in ("wrong_shard", "duplicates", "bad_source", "bad_label", "bad_feature") and v}:
        raise ValueError(f"invalid training shard: {wrong}")
    return row


def entity_split(rows: DataFrame, ratio: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows: floor(n * ratio) entities, those first by MD5 of seed and id, are validation with all
    their rows."""
    held = split_ids(rows.select("s1_entity_id").distinct(), ratio, seed).filter("validation").select("s1_entity_id")
    return rows.join(held, "s1_entity_id", "left_anti"), rows.join(held, "s1_entity_id", "left_semi")


def split_ids(ids: DataFrame, ratio: float, seed: int = 42) -> DataFrame:
    """ids with `validation`. The cut is found among counts by the hash's first four hexadecimal digits, so only ids that
    share the cut's digits are ranked, not all."""
    marked = ids.select("s1_entity_id", F.md5(F.concat(F.lit(f"{seed}:"), F.col("s1_entity_id")).cast("binary")).alias("h")).withColumn("bin", F.substring("h", 1, 4))
    counts = sorted((r.bin, r.n) for r in marked.groupBy("bin").agg(F.count("*").alias("n")).collect())  # 65,536 at most
    want, seen, cut = int(sum(n for _, n in counts) * ratio), 0, None
    for name, n in counts:
        if seen + n > want:
            cut = name
            break
        seen += n
    if cut is None:
        return marked.select("s1_entity_id", F.lit(True).alias("validation"))
    inside = marked.filter(F.col("bin") == cut).orderBy("h", "s1_entity_id").limit(want - seen).select("s1_entity_id").withColumn("_in", F.lit(True))
    return marked.join(inside, "s1_entity_id", "left").select("s1_entity_id", ((F.col("bin") < cut) | F.coalesce("_in", F.lit(False))).alias("validation"))


def stratified_split(spine: DataFrame, ratio: float = 0.2, seed: int = 42) -> DataFrame:
    """spine (s1_entity_id, country, ids) -> with stratum (country and whether it has 0, 1 or more matches) and validation:
    of each stratum the first floor(n * ratio) by hash."""
    kind = F.when(F.size("ids") == 0, "singleton").when(F.size("ids") == 1, "single").otherwise("multi")
    rows = spine.select("s1_entity_id", F.concat_ws(":", "country", kind).alias("stratum"), F.md5(F.concat(F.lit(f"{seed}:"), F.col("s1_entity_id")).cast("binary")).alias("h"))
    # a stratum's cut lies in one bin of its hashes: only that bin's ids are ranked, not a stratum in one task
    rows = rows.withColumn("bin", F.substring("h", 1, 4))
    bins = rows.groupBy("stratum", "bin").agg(F.count("*").alias("n"))
    want = bins.groupBy("stratum").agg(F.floor(F.sum("n") * F.lit(ratio)).alias("want"))
    running = Window.partitionBy("stratum").orderBy("bin")
    edges = bins.withColumn("upto", F.sum("n").over(running)).join(want, "stratum").select("stratum", "bin", (F.col("upto") - F.col("n")).alias("before"), "upto", "want")
    placed = rows.join(edges, ["stratum", "bin"])
    sure = placed.filter((F.col("upto") <= F.col("want")) | (F.col("before") >= F.col("want"))).select("s1_entity_id", "stratum", (F.col("upto") <= F.col("want")).alias("validation"))
    inside = placed.filter((F.col("upto") > F.col("want")) & (F.col("before") < F.col("want")))
    place = F.row_number().over(Window.partitionBy("stratum", "bin").orderBy("h", "s1_entity_id"))
    return sure.unionByName(inside.select("s1_entity_id", "stratum", (F.col("before") + place <= F.col("want")).alias("validation")))


def feature_summary(rows: DataFrame) -> DataFrame:
    """feature, distinct, mode and its share, min, max, mean, median, std: one pass over all features unpivoted."""
    long = rows.select(*FEATURES).unpivot([], list(FEATURES), "feature", "value")
    counts = long.groupBy("feature", "value").agg(F.count("*").alias("n"))
    modes = counts.groupBy("feature").agg(F.count("*").alias("n_distinct"), F.max_by("value", F.struct("n", -F.col("value"))).alias("mode"), (F.max("n") / F.sum("n")).alias("mode_share"))
    rest = long.groupBy("feature").agg(F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.median("value").alias("median"), F.stddev("value").alias("std"))
    return modes.join(rest, "feature")
