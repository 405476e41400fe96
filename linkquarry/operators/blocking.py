"""Candidate pairs by blocking: equi-joins on keys within a country, bucket caps, ranked channels and their union.

A record is prepared once (its normal forms, tokens and house number) and written; all channels are joins over narrow
columns of that table. Buckets beyond a cap give nothing, which is a rule of the result and also bounds every join: a key
meets at most `cap` rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..sources import stage
from . import overlap, tfidf

PAIR = ["s1_entity_id", "candidate_entity_id", "candidate_source"]


@dataclass(frozen=True)
class Blocking:
    """Caps and budgets. key_mode: names as they are in keys and TF-IDF ("raw"), or normalized ("normalized")."""

    budget: int = 100
    bucket: int = 100
    token_df: int = 2000
    top: int = 30
    rarest: int = 5
    tfidf: bool = True
    tfidf_top: int = 40
    tfidf_least: float = 0.35
    tfidf_terms: int = 40_000
    key_mode: str = "raw"
    compose: bool = True


def prepare(records: DataFrame, how: Blocking = Blocking()) -> DataFrame:
    """Standard records -> with their normal forms. Rows without a country take part in nothing."""
    whole = text.composed if how.compose else text.filled
    rows = records.filter("country <> ''").select("entity_id", "business_name", "business_address", "country", "source", whole("business_name").alias("_name"), whole("business_address").alias("_address"))
    name, address = text.normalize_name("_name", compose=False), text.normalize_address("_address", compose=False)
    out = rows.select("entity_id", "business_name", "business_address", "country", "source", name.alias("norm_name"), address.alias("norm_address"), text.house_number("_address", compose=False).alias("house"))
    key = F.col("business_name") if how.key_mode == "raw" else F.col("norm_name")
    return out.select("*", key.alias("key_name"), text.distinctive_tokens(F.col("norm_name")).alias("tokens"), F.array_distinct(text.address_tokens(F.col("norm_address"))).alias("address_tokens"))


def _sides(s1: DataFrame, pool: DataFrame, keys: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """The two sides of a key join, each a narrow projection; a null or empty key part joins nothing."""
    left = s1.select(F.col("entity_id").alias("s1_entity_id"), *(c.alias(k) for k, c in keys.items()))
    right = pool.select(F.col("entity_id").alias("candidate_entity_id"), F.col("source").alias("candidate_source"), *(c.alias(k) for k, c in keys.items()))
    for k in keys:
        left, right = left.filter(F.col(k) != ""), right.filter(F.col(k) != "")
    return left, right


def key_join(s1: DataFrame, pool: DataFrame, keys: dict[str, Column], cap: int) -> DataFrame:
    """Pairs that agree in all keys, for keys that at most `cap` pool rows have (rows, not distinct ids)."""
    left, right = _sides(s1, pool, keys)
    names = list(keys)
    small = right.groupBy(*names).agg(F.count("*").alias("bucket")).filter(F.col("bucket") <= cap)
    return left.join(small.drop("bucket"), names).join(right, names)


def _country() -> dict[str, Column]:
    return {"country": F.col("country")}


def by_exact_name(s1: DataFrame, pool: DataFrame, cap: int = 100) -> DataFrame:
    return key_join(s1, pool, _country() | {"key": F.col("key_name")}, cap).select(*PAIR)


def by_name_prefix(s1: DataFrame, pool: DataFrame, size: int = 5, cap: int = 100) -> DataFrame:
    return key_join(s1, pool, _country() | {"key": F.substring("key_name", 1, size)}, cap).select(*PAIR)


def by_house(s1: DataFrame, pool: DataFrame, cap: int = 2000) -> DataFrame:
    return key_join(s1, pool, _country() | {"key": F.lower("house")}, cap).select(*PAIR)


def by_house_and_prefix(s1: DataFrame, pool: DataFrame, size: int = 3, cap: int = 2000) -> DataFrame:
    return key_join(s1, pool, _country() | {"key": F.lower("house"), "prefix": F.substring("key_name", 1, size)}, cap).select(*PAIR)


def by_address_tokens(s1: DataFrame, pool: DataFrame, cap: int = 2000, top: int = 100) -> DataFrame:
    """Pairs with a common address token; of each s1 row the first `top` by id."""
    pairs = key_join(s1, pool, _country() | {"key": F.explode("address_tokens")}, cap).select(*PAIR).distinct()
    return ranked(pairs, F.lit(0), top).select(*PAIR)


def ranked(pairs: DataFrame, score: Column, top: int) -> DataFrame:
    """The best `top` candidates of each s1 row by score, equal ones by id, with their `place` from 1."""
    order = Window.partitionBy("s1_entity_id").orderBy(score.desc(), F.col("candidate_entity_id"))
    return pairs.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)


def _tasks(df: DataFrame) -> int:
    """How many tasks there are for work that few bytes hold."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def alike(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records that address paths can't tell apart are one: no, n (how many ids), country, house, key_name (its first three
    characters), address_tokens, a row for each row that an id has; and no, entity_id, source of the ids."""
    rows = records.select("entity_id", "source", F.struct("country", F.lower("house").alias("house"), F.substring("key_name", 1, 3).alias("key_name"), F.array_sort("address_tokens").alias("address_tokens")).alias("row"))
    ids = stage.materialize(rows.groupBy("entity_id", "source").agg(F.sort_array(F.collect_list("row")).alias("rows")), "address-rows")
    forms = stage.materialize(ids.groupBy("rows").agg(F.count("*").alias("n")).withColumn("no", F.monotonically_increasing_id()), "address-forms")
    return forms.select("no", "n", F.explode("rows").alias("row")).select("no", "n", "row.*"), ids.join(forms, "rows").select("no", "entity_id", "source")


def by_address(s1: DataFrame, pool: DataFrame, how: Blocking = Blocking()) -> DataFrame:
    """House number with name prefix (3), each of the rarest address tokens (2) and house number (1): weights are summed;
    the best `top`, equal ones by id, with score and place. Records that are alike in these have the same scores, so pairs
    are of numbers of such forms; of a form of the pool only its first `top` ids by order can come among the best."""
    (s1, ask), (pool, ids) = alike(s1.filter("business_address <> '' OR house IS NOT NULL")), alike(pool)
    mine, theirs = s1.withColumnRenamed("no", "x"), pool.withColumnRenamed("no", "y")
    keyed = lambda d, no, key: d.select(no, "n", "country", *[c.alias(k) for k, c in key.items()]).filter(" AND ".join(f"{k} <> ''" for k in ("country", *key)))

    def met(key: dict[str, Column]) -> DataFrame:
        """Pairs that agree in all keys, a row for each, for keys that at most `token_df` pool rows have."""
        left, right, names = keyed(mine, "x", key).drop("n"), keyed(theirs, "y", key), ["country", *key]
        small = right.groupBy(*names).agg(F.sum("n").alias("bucket")).filter(F.col("bucket") <= how.token_df).drop("bucket")
        return left.join(small, names).join(right.drop("n"), names)

    token = {"key": F.explode("address_tokens")}
    left, right = keyed(mine, "x", token).drop("n"), keyed(theirs, "y", token)
    # an unseen token is the rarest of all, so it takes a place
    df = right.groupBy("country", "key").agg(F.sum("n").alias("df"))
    order = Window.partitionBy("x", "country").orderBy(F.coalesce("df", F.lit(0)), "key")
    rarest = left.join(df, ["country", "key"], "left").withColumn("place", F.row_number().over(order)).filter((F.col("place") <= how.rarest) & (F.col("df") <= how.token_df)).select("x", "country", "key")
    # the number of tasks is given, as few tokens can have many pairs
    parts = _tasks(s1)
    by_token = rarest.repartition(parts, "country", "key").join(right.drop("n").repartition(parts, "country", "key"), ["country", "key"])
    house, prefix = {"house": F.col("house")}, {"prefix": F.col("key_name")}
    first, *rest = [p.select("x", "y", F.lit(w).alias("weight")) for p, w in ((met(house | prefix), 3), (by_token, 2), (met(house), 1))]
    for p in rest:
        first = first.unionByName(p)
    scores = first.groupBy("x", "y").agg(F.sum("weight").alias("score"))
    nth = F.row_number().over(Window.partitionBy("no").orderBy("entity_id", "source"))
    held = ids.withColumn("nth", nth).filter(F.col("nth") <= how.top).select(F.col("no").alias("y"), F.col("entity_id").alias("candidate_entity_id"), F.col("source").alias("candidate_source"))
    order = Window.partitionBy("x").orderBy(F.desc("score"), "candidate_entity_id", "candidate_source")
    best = scores.join(held, "y").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= how.top)
    return ask.select(F.col("no").alias("x"), F.col("entity_id").alias("s1_entity_id")).join(best, "x").select(*PAIR, "score", "place")


def by_name_tokens(s1: DataFrame, pool: DataFrame, how: Blocking = Blocking()) -> DataFrame:
    """Number of common distinctive name tokens that at most `token_df` pool rows have; the best `top`, equal ones by id.

    s1 rows of a country with the same tokens have the same candidates, so each distinct set of tokens is looked up once,
    against the distinct sets of the pool; of a pool set only its first `top` ids by order can come among the best.
    """
    sets = lambda d: d.select("entity_id", "source", "country", F.array_sort("tokens").alias("tokens")).filter(F.size("tokens") > 0)
    mine, theirs = sets(s1), sets(pool)
    wanted, held = (d.groupBy("country", "tokens").agg(F.count("*").alias("n")) for d in (mine, theirs))
    small = held.select("country", F.explode("tokens").alias("key"), "n").groupBy("country", "key").agg(F.sum("n").alias("df")).filter(F.col("df") <= how.token_df).drop("df")
    x = wanted.select(F.col("tokens").alias("x"), "country", F.explode("tokens").alias("key")).join(small, ["country", "key"])
    y = held.select(F.col("tokens").alias("y"), "country", F.explode("tokens").alias("key"))
    met = x.join(y, ["country", "key"]).groupBy("country", "x", "y").agg(F.count("*").alias("score"))
    ids = theirs.distinct().withColumn("nth", F.row_number().over(Window.partitionBy("country", "tokens").orderBy("entity_id"))).filter(F.col("nth") <= how.top)
    ids = ids.select("country", F.col("tokens").alias("y"), F.col("entity_id").alias("candidate_entity_id"), F.col("source").alias("candidate_source"))
    order = Window.partitionBy("country", "x").orderBy(F.desc("score"), "candidate_entity_id")
    best = met.join(ids, ["country", "y"]).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= how.top).drop("y")
    ask = mine.distinct().select(F.col("entity_id").alias("s1_entity_id"), "country", F.col("tokens").alias("x"))
    return ask.join(best, ["country", "x"]).select(*PAIR, "score", "place")


def by_token_overlap(queries: DataFrame, index: DataFrame, least: int = 1, top: int = 50) -> DataFrame:
    """query_id, candidate_id, score from (query_id, token) and (candidate_id, token): the best `top` by common tokens, and
    of those the ones with `least`. No country, no cap: every pair counts.

    Tokens are numbers by falling frequency. Ids with the same tokens are one set; of a set of the index only its first
    `top` ids by order can come among the best. Blocks of sets meet in tasks, so pairs that share a frequent token are
    never rows.
    """
    mine, theirs = (stage.materialize(d.filter("token IS NOT NULL").distinct(), "id-tokens") for d in (queries, index))
    count = theirs.groupBy("token").agg(F.count("*").alias("n")).join(mine.select("token").distinct(), "token", "left_semi")
    order = [F.desc("n"), F.col("token")]
    words = stage.materialize(count.repartitionByRange(*order).sortWithinPartitions(*order).select("token", F.monotonically_increasing_id().alias("t")), "vocabulary")
    sets = lambda d, who: stage.materialize(d.join(words, "token").groupBy(F.col(who).alias("id")).agg(F.sort_array(F.collect_list("t")).alias("tokens")), "id-sets")
    asked_ids, held_ids = sets(mine, "query_id"), sets(theirs, "candidate_id")
    asked, held = _numbered_sets(asked_ids), _numbered_sets(held_ids)
    met = _best_sets(asked, held, max(1, least), top)
    nth = F.row_number().over(Window.partitionBy("p").orderBy("candidate_id"))
    ids = held_ids.join(held, "tokens").select(F.col("no").alias("p"), F.col("id").alias("candidate_id")).withColumn("nth", nth).filter(F.col("nth") <= top).drop("nth")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "candidate_id"))
    best = met.join(ids, "p").withColumn("place", place).filter(F.col("place") <= top)
    who = asked_ids.join(asked, "tokens").select(F.col("no").alias("q"), F.col("id").alias("query_id"))
    return who.join(best, "q").select("query_id", "candidate_id", "score")


def _numbered_sets(ids: DataFrame) -> DataFrame:
    """no, tokens: distinct sets of (id, tokens), numbered in the order of their least ids (a null id is the least)."""
    first = ids.groupBy("tokens").agg(F.min(F.struct("id")).alias("first"))
    return stage.materialize(first.repartitionByRange("first").sortWithinPartitions("first").select(F.monotonically_increasing_id().alias("no"), "tokens"), "sets")


def _best_sets(asked: DataFrame, held: DataFrame, least: int, top: int, asked_block: int = 50_000, held_block: int = 200_000) -> DataFrame:
    """q, p, score: for each asked set the best `top` of every block of held sets, by number if equal. There are as many
    blocks as sets need, and of asked sets enough for all cores."""
    import pyarrow as pa

    cores = asked.sparkSession.sparkContext.defaultParallelism
    n_held = -(-max(1, held.count()) // held_block)
    n_asked = max(-(-max(1, asked.count()) // asked_block), -(-3 * cores // n_held))

    def meet(x: pa.Table, y: pa.Table) -> pa.Table:
        none = np.empty(0, np.int64)
        who, whom, score = none, none, none
        if x.num_rows and y.num_rows:
            y = y.sort_by("no").combine_chunks()
            lists = y.column("tokens").combine_chunks()
            block = overlap.Held(lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False))
            tokens = x.column("tokens").combine_chunks()
            each = np.split(tokens.flatten().to_numpy(zero_copy_only=False), np.cumsum(tokens.value_lengths().to_numpy(zero_copy_only=False))[:-1])
            who, whom, score = overlap.matches(zip(x.column("no").to_pylist(), each, strict=True), block, y.column("no").to_numpy(), top, least)
        return pa.table({"q": who, "p": whom, "score": score})

    deal = lambda n, seed: F.pmod(F.xxhash64("no", F.lit(seed)), F.lit(n)).cast("int")
    parts = n_asked * n_held
    # a block of each side to a task; the number of tasks is given, as little data holds much work, and blocks have keys
    # that fall into different tasks
    spread = asked.sparkSession.range(20 * parts).select(F.col("id").cast("int").alias("key")).groupBy(F.pmod(F.hash("key"), F.lit(parts)).alias("task")).agg(F.min("key").alias("key")).collect()
    keys = [r.key for r in spread]
    keys += [-1 - k for k in range(parts - len(keys))]
    every = lambda n, place: F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.get(F.lit(keys), place(k))))
    left = asked.select(every(n_held, lambda k: deal(n_asked, 1) * n_held + k).alias("block"), "no", "tokens").repartition(parts, "block")
    right = held.select(every(n_asked, lambda k: deal(n_held, 2) + k * n_held).alias("block"), "no", "tokens").repartition(parts, "block")
    met = left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(meet, "q long, p long, score long")
    return stage.materialize(met, "met-sets")


def similar_texts(query: Column, candidates: Column, least: float = 0.5) -> Column:
    """The indexes (from 0) of an array's texts within a bigram similarity of a query, in order; blank ones never."""
    near = F.transform(candidates, lambda c, i: F.when((text.strip(c) != "") & (text.bigram_dice(F.lower(text.strip(query)), F.lower(text.strip(c))) >= least), i))
    return F.filter(near, lambda i: i.isNotNull())


def by_edit_distance(pairs: DataFrame, query: str, candidate: str, least: float = 0.5) -> DataFrame:
    """Pairs whose two texts have an Indel ratio of `least`, lower-cased and trimmed; a blank candidate never has."""
    tidy = lambda c: F.lower(text.strip(text.filled(c)))
    return pairs.filter(tidy(candidate) != "").withColumn("_ratio", text.indel_ratio(tidy(query), tidy(candidate))).filter(F.col("_ratio") >= least).drop("_ratio")


def candidates(s1: DataFrame, pool: DataFrame, how: Blocking = Blocking()) -> DataFrame:
    """Prepared tables -> s1_entity_id, candidate_entity_id, candidate_source, priority, rank.

    Channels in order: exact name, address, name prefix, name tokens, TF-IDF. A candidate counts in the first channel that
    has it; each s1 row keeps its first `budget`. rank numbers them from 1.
    """
    channels = [by_exact_name(s1, pool, how.bucket).withColumn("place", F.lit(0)), by_address(s1, pool, how), by_name_prefix(s1, pool, 5, how.bucket).withColumn("place", F.lit(0)), by_name_tokens(s1, pool, how)]
    if how.tfidf:
        left, right = (d.select("entity_id", "country", "source", F.col("key_name").alias("text")) for d in (s1, pool))
        channels.append(tfidf.similar(left, right, how.tfidf_top, how.tfidf_least, how.tfidf_terms))
    first, *rest = [c.select(*PAIR, F.lit(k + 1).alias("priority"), F.col("place").cast("int").alias("place")) for k, c in enumerate(channels)]
    for c in rest:
        first = first.unionByName(c)
    # one aggregation finds each pair's first channel, the window's shuffle follows its key
    best = first.groupBy("s1_entity_id", "candidate_entity_id").agg(F.min(F.struct("priority", "place", "candidate_source")).alias("at"))
    order = Window.partitionBy("s1_entity_id").orderBy("at.priority", "at.place", "candidate_entity_id")
    out = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= how.budget)
    return out.select("s1_entity_id", "candidate_entity_id", F.col("at.candidate_source").alias("candidate_source"), F.col("at.priority").alias("priority"), "rank")


def prepared(records: DataFrame, how: Blocking = Blocking()) -> DataFrame:
    """`prepare`, written to the shared folder and read again: channels read its columns, not the records. Records are dealt
    to all cores, as few bytes are few tasks of a reader but hold much work."""
    return stage.materialize(prepare(records.repartition(_tasks(records)), how), "prepared")


def generate(s1: DataFrame, s2: DataFrame, s3: DataFrame | None = None, how: Blocking = Blocking()) -> DataFrame:
    """Standard records of the reference table and the pools -> candidate pairs."""
    pool = s2 if s3 is None else s2.unionByName(s3)
    return candidates(prepared(s1, how), prepared(pool, how), how)
