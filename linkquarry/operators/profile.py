"""Profiles of raw tables: each a DataFrame that one or two aggregations make."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed, text

PERCENTILES = (1, 5, 25, 50, 75, 95, 99)


def pct(part: Column, whole: Column, digits: int = 4) -> Column:
    return F.when(whole > 0, F.bround(F.lit(100.0) * part / whole, digits)).otherwise(0.0)


def columns(df: DataFrame, names: list[str]) -> DataFrame:
    """name, n_rows, missing, missing_pct, min, max and mean length of each column: one pass over the table unpivoted."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), df[c].cast("string").alias("value")) for c in names])).alias("x")).select("x.name", "x.value")
    missing = F.col("value").isNull() | (text.strip(F.col("value")) == "")
    size = F.when(~missing, F.length("value"))
    out = long.groupBy("name").agg(F.count("*").alias("n_rows"), F.count_if(missing).alias("missing"), F.min(size).alias("min_length"), F.max(size).alias("max_length"), F.bround(F.avg(size), 4).alias("mean_length"))
    return out.withColumn("missing_pct", pct(F.col("missing"), F.col("n_rows")))


def length_percentiles(df: DataFrame, column: str, by: str | None = None) -> DataFrame:
    """percentile, length: the smallest length that so many percent of the non-empty values don't exceed (nearest rank)."""
    rows = df.filter(text.filled(column) != "").select(*([F.col(by)] if by else []), F.length(column).alias("n"))
    aggs = [F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY n)").cast("int").alias(f"p{p}") for p in PERCENTILES]
    wide = rows.groupBy(*([by] if by else [])).agg(*aggs)
    pairs = F.explode(F.array(*[F.struct(F.lit(p).alias("percentile"), F.col(f"p{p}").alias("length")) for p in PERCENTILES])).alias("x")
    return wide.select(*([by] if by else []), pairs).select(*([by] if by else []), "x.percentile", "x.length")


def distribution(df: DataFrame, column: str) -> DataFrame:
    """value (empty as MISSING), n."""
    v = text.strip(text.filled(column))
    return df.groupBy(F.when(v == "", "MISSING").otherwise(v).alias("value")).agg(F.count("*").alias("n"))


def group_size(n: Column) -> Column:
    return F.when(n == 1, "1").when(n <= 5, "2-5").when(n <= 10, "6-10").when(n <= 50, "11-50").otherwise("50+")


def duplication(keys: DataFrame) -> DataFrame:
    """One row about a column `key`: rows, distinct keys, keys and rows that are repeated, and their share."""
    counts = keys.filter("key <> ''").groupBy("key").agg(F.count("*").alias("n"))
    out = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("distinct_keys"), F.count_if(F.col("n") > 1).alias("duplicate_keys"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicate_rows"))
    return out.withColumn("duplicate_pct", pct(F.col("duplicate_rows"), F.col("n_rows")))


def group_sizes(keys: DataFrame) -> DataFrame:
    """size_group, n_keys."""
    return keys.filter("key <> ''").groupBy("key").agg(F.count("*").alias("n")).groupBy(group_size(F.col("n")).alias("size_group")).agg(F.count("*").alias("n_keys"))


def most_frequent(keys: DataFrame, top: int = 10) -> DataFrame:
    return keys.filter("key <> ''").groupBy("key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(top)


def collapsing(df: DataFrame, raw: str, normal: Column, examples: int = 5, top: int = 10) -> DataFrame:
    """key, n_raw, raws: normal forms that several raw values share; the first `examples` values, the `top` keys with most.
    Values are ranked within a key, so none is gathered beyond its examples."""
    values = df.select(normal.alias("key"), F.col(raw).alias("raw")).filter("key <> ''").distinct()
    best = values.groupBy("key").agg(F.count("*").alias("n_raw")).filter("n_raw > 1").orderBy(F.desc("n_raw"), "key").limit(top)
    shown = values.join(F.broadcast(best), "key").withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("raw"))).filter(F.col("place") <= examples)
    return shown.groupBy("key", "n_raw").agg(F.array_join(F.array_sort(F.collect_list("raw")), "|").alias("raws"))


def addresses(df: DataFrame) -> DataFrame:
    """By country: rows, missing addresses, and shares (%) of those with a postal code, a house number, a state."""
    a, c = text.filled("business_address"), F.lower("country")
    tokens = F.regexp_extract_all(F.lower(a), F.lit(r"\b[a-z0-9]+\b"), F.lit(0))
    some = lambda xs, values: F.arrays_overlap(xs, text.words(*values))
    postal = F.when(c == "us", a.rlike(fixed.US_ZIP)).when(c == "india", a.rlike(fixed.INDIA_PIN)).when(c == "france", a.rlike(fixed.FRANCE_POSTAL)).otherwise(False)
    state = F.when(c == "us", some(F.regexp_extract_all(a, F.lit(r"\b[A-Z]{2}\b"), F.lit(0)), fixed.US_STATES)).when(c == "india", some(tokens, fixed.INDIA_STATES)).when(c == "france", some(tokens, fixed.FRANCE_WORDS)).otherwise(False)
    there = text.strip(a) != ""
    out = df.groupBy("country").agg(F.count("*").alias("n_rows"), F.count_if(~there).alias("missing"), F.count_if(there & postal).alias("postal"), F.count_if(there & a.rlike(r"\b\d+[a-zA-Z]?\b")).alias("house"), F.count_if(there & state).alias("state"))
    valid = F.col("n_rows") - F.col("missing")
    return out.select("country", "n_rows", "missing", *(pct(F.col(x), valid, 2).alias(f"{x}_pct") for x in ("postal", "house", "state")))


def separators(df: DataFrame, top: int = 5) -> DataFrame:
    """country, item, n: the most frequent separators of addresses."""
    return _top(df.select("country", F.explode(text.numbers("business_address", fixed.SEPARATORS)).alias("item")), top)


def abbreviations(df: DataFrame, top: int = 10) -> DataFrame:
    tokens = F.array_distinct(text.numbers(F.lower(text.filled("business_address")), r"\b[a-z0-9]+\b"))
    return _top(df.select("country", F.explode(F.array_intersect(tokens, text.words(*fixed.ADDRESS_ABBREVIATIONS))).alias("item")), top)


def _top(items: DataFrame, top: int) -> DataFrame:
    counts = items.groupBy("country", "item").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("country").orderBy(F.desc("n"), "item"))).filter(F.col("place") <= top).drop("place")


def truth_distribution(truth: DataFrame) -> DataFrame:
    """One row about (s1_entity_id, ids): entities by number of links, links by source, the most links and who has them."""
    n, has = F.size("ids"), lambda s: F.exists("ids", lambda x: x.startswith(s))
    of = lambda s: F.size(F.filter("ids", lambda x: x.startswith(s)))
    return truth.agg(
        F.count("*").alias("entities"), *(F.count_if(n == k).alias(f"with_{k}") for k in range(4)), F.count_if(n >= 4).alias("with_4_or_more"), F.sum(of("S2-")).alias("s2_links"), F.sum(of("S3-")).alias("s3_links"),
        F.count_if(has("S2-") & has("S3-")).alias("both"), F.count_if(has("S2-") & ~has("S3-")).alias("only_s2"), F.count_if(~has("S2-") & has("S3-")).alias("only_s3"),
        F.max(n).alias("most_links"), F.max_by(F.col("s1_entity_id"), F.struct(n, F.col("s1_entity_id"))).alias("most_linked"),
    )


def truth_histogram(truth: DataFrame) -> DataFrame:
    return truth.groupBy(F.size("ids").alias("n_links")).agg(F.count("*").alias("n"))


def cleaned(records: DataFrame, fold: bool = True, keep: tuple[str, ...] = ("entity_id",)) -> DataFrame:
    """Records with what the measures below need, made once a record, and the columns to keep."""
    name, address = text.clean_text("business_name", fold), text.clean_text("business_address", fold)
    out = records.select(*keep, "country", text.filled("business_name").alias("name"), text.filled("business_address").alias("address"), name.alias("cname"), address.alias("caddress"))
    return out.select(
        "*", text.clean_tokens(F.col("cname")).alias("name_tokens"), text.clean_tokens(F.col("caddress"), stopwords=False).alias("address_tokens"), F.array_distinct(text.numbers("address")).alias("numbers"),
        F.array_distinct(text.numbers("address", fixed.US_ZIP)).alias("zips"), F.array_distinct(text.numbers("address", r"\b[A-Z]{2}\b")).alias("codes"), text.address_part("address", 2).alias("city"), text.address_part("address", 1).alias("state"), F.get(F.split("cname", " "), F.lit(0)).alias("first_word"),
        text.bigram_marks(F.col("cname")).alias("cname_marks"), text.bigram_marks(F.col("caddress")).alias("caddress_marks"),
    )


def _side(d: DataFrame, p: str) -> DataFrame:
    return d.select(*[F.col(c).alias(f"{p}_{c}") for c in d.columns])


def linked(pairs: DataFrame, s1: DataFrame, pool: DataFrame) -> DataFrame:
    """Pairs with both cleaned records, a_ and b_, and `n`, 1; pairs without one are left out."""
    rows = pairs.join(_side(s1, "a"), F.col("s1_entity_id") == F.col("a_entity_id")).join(_side(pool, "b"), F.col("candidate_entity_id") == F.col("b_entity_id"))
    return rows.withColumn("n", F.lit(1).cast("long"))


def linked_by(records: DataFrame, keys: list[str], fold: bool = True) -> DataFrame:
    """`linked` where a reference record's links are all pool records that agree in the keys; a null key links nothing.

    Records of a side with the same keys and contents are one, so a row stands for `n` pairs. Only records are dealt out:
    pairs come from the join on the keys and needn't be written anywhere.
    """
    content = [*keys, "country", "business_name", "business_address"]
    spark = records.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)

    def side(which: Column, p: str) -> DataFrame:
        rows = records.filter(which).groupBy(*content).agg(F.count("*").alias("n"))
        # the number of tasks is given, as few records can have many pairs
        return _side(cleaned(rows.repartition(parts, *keys), fold, keep=(*keys, "n")), p)

    a, b = side(F.col("source") == "S1", "a"), side(F.col("source") != "S1", "b")
    same = [F.col(f"a_{k}") == F.col(f"b_{k}") for k in keys]
    return a.join(b, reduce(Column.__and__, same)).withColumn("n", F.col("a_n") * F.col("b_n"))


def set_jaccard(a: str, b: str) -> Column:
    """Of two arrays without repeats."""
    x, y = F.col(a), F.col(b)
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(both / (F.size(x) + F.size(y) - both))


def clean_dice(a: str, b: str) -> Column:
    """`text.bigram_dice` of two cleaned texts by their marks; 0 if either is empty."""
    x, y, xs, ys = F.col(a), F.col(b), F.col(f"{a}_marks"), F.col(f"{b}_marks")
    some = F.lit(2.0) * F.size(F.array_intersect(xs, ys)) / (F.size(xs) + F.size(ys))
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).when((F.size(xs) == 0) | (F.size(ys) == 0), 0.0).otherwise(some)


def difficulty(rows: DataFrame) -> DataFrame:
    """One row of how alike linked records are; means over addresses are over pairs whose pool record has one."""
    rows = rows.select("*", set_jaccard("a_name_tokens", "b_name_tokens").alias("nj"), clean_dice("a_cname", "b_cname").alias("nd"), set_jaccard("a_address_tokens", "b_address_tokens").alias("aj0"), clean_dice("a_caddress", "b_caddress").alias("ad"))
    there = text.strip("b_address") != ""
    rows = rows.withColumn("aj", F.when(there, F.col("aj0")).otherwise(0.0))
    same = (F.col("a_cname") == F.col("b_cname")) & (F.col("a_cname") != "")
    gap = lambda a, b: F.abs(F.length(a) - F.length(b))
    n = F.col("n")
    times = lambda test: F.coalesce(F.sum(F.when(test, n)), F.lit(0).cast("long"))
    mean = lambda x: F.sum(x * n) / F.sum(F.when(x.isNotNull(), n))
    return rows.agg(
        times(F.lit(True)).alias("pairs"), mean(same.cast("double")).alias("exact_name"), mean(F.col("nj")).alias("name_jaccard"), mean(F.col("nd")).alias("name_dice"), mean(gap("a_name", "b_name")).alias("name_gap"), times(~there).alias("no_address"),
        mean(F.when(there, ((F.col("a_caddress") == F.col("b_caddress")) & (F.col("a_caddress") != "")).cast("double"))).alias("exact_address"), mean(F.when(there, F.col("aj"))).alias("address_jaccard"), mean(F.when(there, F.col("ad"))).alias("address_dice"), mean(F.when(there, gap("a_address", "b_address"))).alias("address_gap"),
        times(~same & (F.col("nj") >= 0.5)).alias("similar_names"), times((F.col("nj") < 0.3) & (F.col("aj") >= 0.5)).alias("weak_name_strong_address"), times((F.col("nj") < 0.3) & (F.col("aj") < 0.3)).alias("both_noisy"),
    )


def blocking_predicates() -> dict[str, Column]:
    """Ten tests of whether blocking would bring a linked pair together (over columns of `linked`)."""
    country = F.col("a_country") == F.col("b_country")
    meet = lambda x: F.arrays_overlap(f"a_{x}", f"b_{x}")
    name = (F.col("a_cname") != "") & (F.col("a_cname") == F.col("b_cname"))
    prefix = (F.col("a_cname") != "") & (F.substring("a_cname", 1, 5) == F.substring("b_cname", 1, 5))
    c = F.lower("a_country")
    state = F.when(c == "us", meet("codes")).when(c == "india", meet("address_tokens") & country).otherwise(False)
    first = meet("numbers") & (F.col("a_first_word") == F.col("b_first_word")) & (F.col("a_first_word") != "") & country
    two = (F.size(F.array_intersect("a_address_tokens", "b_address_tokens")) >= 2) & country & (clean_dice("a_cname", "b_cname") >= 0.4)
    return {
        "01_name": name, "02_name_country": name & country, "03_prefix_country": prefix & country, "04_name_token_country": meet("name_tokens") & country, "05_zip": meet("zips"),
        "06_city_country": (F.col("a_city") == F.col("b_city")) & country, "07_state": state, "08_number_country": meet("numbers") & country, "09_address_token_country": meet("address_tokens") & country,
        "10_composite": (meet("name_tokens") & country) | first | two,
    }


def blocking_recall(rows: DataFrame) -> DataFrame:
    """strategy, hits, n_pairs, recall_pct: all ten in one pass."""
    tests = blocking_predicates()
    times = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0).cast("long"))
    wide = rows.agg(times(F.lit(True)).alias("n_pairs"), *(times(t).alias(k) for k, t in tests.items()))
    return wide.select("n_pairs", F.explode(F.array(*[F.struct(F.lit(k).alias("strategy"), F.col(k).alias("hits")) for k in tests])).alias("x")).select("x.strategy", "x.hits", "n_pairs", pct(F.col("hits"), F.col("n_pairs"), 3).alias("recall_pct"))


def bucket_metrics(records: DataFrame) -> DataFrame:
    """strategy, unique_keys, avg_bucket, max_bucket of ten key families over cleaned records. Of token families the first
    two tokens by name count, as the first two of a set have no order."""
    c = F.col("country")
    two = lambda x: F.slice(F.array_sort(x), 1, 2)
    one = lambda x: F.when(x.isNotNull() & (x != ""), F.array(x)).otherwise(F.array().cast("array<string>"))
    at = lambda keys: F.transform(keys, lambda k: F.concat_ws("_", k, c))
    number = F.get(text.numbers("address"), F.lit(0))
    families = {
        "01_name": one(F.col("cname")), "02_name_country": at(one(F.col("cname"))), "03_prefix_country": at(one(F.substring("cname", 1, 5))), "04_name_token_country": at(two("name_tokens")), "05_zip": text.numbers("address", fixed.US_ZIP),
        "06_city_country": at(one(F.col("city"))), "07_state_country": at(one(F.col("state"))), "08_number_country": at(one(number)), "09_address_token_country": at(two("address_tokens")),
        "10_first_word_number": F.when((F.col("first_word") != "") & number.isNotNull(), at(one(F.concat_ws("_", F.col("first_word"), number)))).otherwise(F.array().cast("array<string>")),
    }

    def named(family: str) -> Column:
        return F.transform(families[family], lambda k: F.struct(F.lit(family).alias("strategy"), k.alias("key")))

    long = records.select(F.explode(F.flatten(F.array(*map(named, families)))).alias("x")).select("x.*")
    return long.groupBy("strategy", "key").agg(F.count("*").alias("n")).groupBy("strategy").agg(F.count("*").alias("unique_keys"), F.bround(F.avg("n"), 2).alias("avg_bucket"), F.max("n").alias("max_bucket"))


def ambiguity(records: DataFrame) -> DataFrame:
    """One row over cleaned records: names with several addresses, addresses with several names, and rates of short and long
    names, `&`, legal forms and abbreviations. Legal forms are looked for among all words of a name."""
    several = lambda key, other: records.groupBy(key).agg(F.count_distinct(other).alias("n")).agg(F.count("*").alias(f"{key}_keys"), F.count_if(F.col("n") > 1).alias(f"{key}_ambiguous"))
    has = lambda c, values: F.arrays_overlap(F.split(c, " "), text.words(*values))
    size = F.length(text.strip("name"))
    rates = records.agg(
        F.count("*").alias("n_rows"), F.count_if(size <= 3).alias("short_names"), F.count_if(size >= 50).alias("long_names"), F.count_if(F.col("name").contains("&")).alias("ampersand"),
        F.count_if(has("cname", fixed.PROFILE_SUFFIXES)).alias("legal_suffix"), F.count_if(has("caddress", ("st", "rd", "ave", "dr", "blvd", "pvt", "ltd"))).alias("abbreviation"),
    )
    # three one-row tables
    return rates.crossJoin(several("cname", "caddress")).crossJoin(several("caddress", "cname"))


def totals(sources: dict[str, DataFrame]) -> DataFrame:
    """source, n_rows, missing_names, missing_addresses of several tables."""
    empty = lambda c: F.count_if(text.strip(text.filled(c)) == "")
    return reduce(DataFrame.unionAll, [d.agg(F.count("*").alias("n_rows"), empty("business_name").alias("missing_names"), empty("business_address").alias("missing_addresses")).select(F.lit(k).alias("source"), "*") for k, d in sources.items()])


def foreign_script_links(records: DataFrame, pool: DataFrame, truth_links: DataFrame, top: int = 10) -> DataFrame:
    """The first links whose pool name isn't ASCII, with both names."""
    odd = pool.filter(text.has_non_ascii("business_name")).select(F.col("entity_id").alias("candidate_entity_id"), F.col("business_name").alias("candidate_name"))
    names = records.select(F.col("entity_id").alias("s1_entity_id"), F.col("business_name").alias("s1_name"))
    return truth_links.join(odd, "candidate_entity_id").join(names, "s1_entity_id").select("s1_entity_id", "candidate_entity_id", "s1_name", "candidate_name").orderBy("s1_entity_id", "candidate_entity_id").limit(top)


def to_json(path: str, **profiles: DataFrame) -> None:
    """Writes each profile as JSON lines under its name."""
    for name, df in profiles.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def to_markdown(title: str, **profiles: DataFrame) -> str:
    """A report of small profiles as Markdown tables."""
    out = [f"# {title}"]
    for name, df in profiles.items():
        out += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join(str(v) for v in r) + " |" for r in df.limit(1000).collect()]
    return "\n".join(out) + "\n"
