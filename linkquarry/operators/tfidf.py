"""Cosine similarity of character n-gram TF-IDF vectors as a join over terms.

Grams of 3 and 4 characters within words padded by a space; a word no longer than a gram is one gram itself, and then
has no longer ones. Vocabulary and document frequencies come from the pool, country by country. Weights are
(1 + ln tf) * (ln((1 + N) / (1 + df)) + 1), over their norm.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..sources import stage


def grams(text: Column, low: int = 3, high: int = 4) -> Column:
    """All grams of a text, repeated as they are."""
    words = F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != "")

    def of(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        size = F.length(padded)
        out = []

        def every(n: int) -> Column:
            return F.transform(F.sequence(F.lit(1), F.greatest(size - F.lit(n - 1), F.lit(1))), lambda i: F.substr(padded, i, F.lit(n)))

        for n in range(low, high + 1):
            many = every(n)
            # a shorter word was a gram of the size before, and is none again
            out.append(many if n == low else F.when(size > n - 1, many).otherwise(F.array().cast("array<string>")))
        return F.concat(*out)

    return F.flatten(F.transform(words, of))


def pool_counts(pool: DataFrame) -> DataFrame:
    """country, term, tf, n: as `counts`, for all ids with the same texts at once; n is how many ids those are."""
    ids = pool.groupBy("entity_id", "country").agg(F.sort_array(F.collect_list("text")).alias("texts"))
    forms = ids.groupBy("country", "texts").agg(F.count("*").alias("n"))
    terms = forms.select("country", "texts", "n", F.explode(F.flatten(F.transform("texts", lambda t: grams(t)))).alias("term"))
    return terms.groupBy("country", "texts", "n", "term").agg(F.count("*").alias("tf")).drop("texts")


def counts(rows: DataFrame, low: int = 3, high: int = 4) -> DataFrame:
    """entity_id, country, term, tf from entity_id, country, text."""
    return rows.select("entity_id", "country", F.explode(grams(F.col("text"), low, high)).alias("term")).groupBy("entity_id", "country", "term").agg(F.count("*").alias("tf"))


def vocabulary(held: DataFrame, documents: DataFrame, min_df: int = 2, most: int = 40_000) -> DataFrame:
    """country, term, idf: terms of min_df pool rows (one, if a country has fewer than five rows or no such term); of those
    the `most` with the largest total count."""
    terms = held.groupBy("country", "term").agg(F.sum("n").alias("df"), F.sum(F.col("tf") * F.col("n")).alias("total"))
    enough = terms.groupBy("country").agg(F.max("df").alias("max_df"))
    need = documents.join(enough, "country").select("country", "n", F.when((F.col("n") < 5) | (F.col("max_df") < min_df), 1).otherwise(min_df).alias("need"))
    kept = terms.join(need, "country").filter(F.col("df") >= F.col("need"))
    order = Window.partitionBy("country").orderBy(F.desc("total"), "term")
    kept = kept.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
    return kept.select("country", "term", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def weights(side_counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """entity_id, country, term, w: rows of unit length."""
    raw = side_counts.join(vocab, ["country", "term"]).select("entity_id", "country", "term", ((F.log("tf") + 1) * F.col("idf")).alias("w"))
    norm = raw.groupBy("entity_id", "country").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, ["entity_id", "country"]).select("entity_id", "country", "term", (F.col("w") / F.col("norm")).alias("w"))


def vectors(texts: DataFrame, vocab: DataFrame) -> DataFrame:
    """text_id, country, term, w of a table of distinct texts (text_id, country, text)."""
    return weights(counts(texts.withColumnRenamed("text_id", "entity_id")), vocab).withColumnRenamed("entity_id", "text_id")


def heavy_part(rows: DataFrame, least: float, df: DataFrame) -> DataFrame:
    """The terms of each unit vector that an index needs: the most frequent ones go as long as what goes is shorter than
    `least`. Two vectors whose product reaches `least` share a term that both keep: else all that they share would lie in
    what one of them dropped, and that is too short."""
    order = Window.partitionBy("text_id").orderBy(F.desc("df"), "term").rowsBetween(Window.unboundedPreceding, 0)
    gone = F.sqrt(F.sum(F.col("w") * F.col("w")).over(order))
    return rows.join(df, ["country", "term"]).withColumn("gone", gone).filter(F.col("gone") >= least - 1e-9).select("text_id", "country", "term", "w")


def numbered_vectors(rows: DataFrame) -> DataFrame:
    """text_id, terms (numbers of the country's terms, ascending), w."""
    terms = rows.select("country", "term").distinct().withColumn("no", F.monotonically_increasing_id())
    sparse = rows.join(stage.materialize(terms, "terms"), ["country", "term"]).groupBy("text_id").agg(F.array_sort(F.collect_list(F.struct("no", "w"))).alias("v"))
    return sparse.select("text_id", F.col("v.no").alias("terms"), F.col("v.w").alias("w"))


@F.pandas_udf(T.DoubleType())
def products(tx: pd.Series, wx: pd.Series, ty: pd.Series, wy: pd.Series) -> pd.Series:
    """Inner products of sparse vectors, a batch of pairs at once: each side's terms are marked with their pair's number,
    so that one search finds all common ones."""
    import numpy as np

    def flat(terms: pd.Series, weights_: pd.Series) -> tuple:
        n = np.array([len(t) for t in terms], np.int64)
        return np.repeat(np.arange(len(n)), n), np.concatenate([np.empty(0, np.int64), *terms]), np.concatenate([np.empty(0), *weights_])

    (px, x, u), (py, y, v) = flat(tx, wx), flat(ty, wy)
    values, code = np.unique(np.concatenate((x, y)), return_inverse=True)
    kx, ky = px * len(values) + code[: len(x)], py * len(values) + code[len(x) :]
    if not len(ky):
        return pd.Series(np.zeros(len(tx)))
    at = np.minimum(np.searchsorted(ky, kx), len(ky) - 1)  # pairs and their terms ascend
    hit = ky[at] == kx
    return pd.Series(np.bincount(px[hit], u[hit] * v[at[hit]], len(tx)))


def similar(s1: DataFrame, pool: DataFrame, top: int = 40, least: float = 0.35, most_terms: int = 40_000, min_df: int = 2) -> DataFrame:
    """s1 and pool (entity_id, country, source, text) -> pairs with similarity and place: of each s1 row the `top` most
    similar pool rows of its country with `least`, equal ones by id.

    Rows with the same text have the same vector and the same candidates, so distinct texts are compared, and a text's
    best pool rows are found once for all s1 rows that have it. Texts meet by terms that both index (`heavy_part`): the
    postings of frequent terms are never joined, and pairs that meet are few enough for their full vectors to be held
    against each other. A pool id that occurs twice with different texts counts by its best one.
    """
    docs = pool.groupBy("country").agg(F.count("*").alias("n"))
    vocab = stage.materialize(vocabulary(pool_counts(pool), docs, min_df, most_terms), "vocabulary")
    both = s1.select("country", "text", F.lit(True).alias("s")).unionByName(pool.select("country", "text", F.lit(False).alias("s")))
    texts = both.groupBy("country", "text").agg(F.max("s").alias("in_s1"), F.max(~F.col("s")).alias("in_pool"))
    texts = stage.materialize(texts.withColumn("text_id", F.monotonically_increasing_id()), "texts")
    rows = stage.materialize(vectors(texts.select("text_id", "country", "text"), vocab), "vectors")
    sides = {k: rows.join(texts.filter(k).select("text_id"), "text_id", "left_semi") for k in ("in_s1", "in_pool")}
    # how many texts hold a term: the order in which both sides drop terms
    df = rows.groupBy("country", "term").agg(F.count("*").alias("df"))
    left, right = (heavy_part(sides[k], least, df).select(F.col("text_id").alias(a), "country", "term") for k, a in (("in_s1", "x"), ("in_pool", "y")))
    met = left.join(right, ["country", "term"]).select("x", "y").distinct()
    whole = stage.materialize(numbered_vectors(rows), "sparse")
    xs, ys = (whole.select(F.col("text_id").alias(a), F.col("terms").alias(f"t{a}"), F.col("w").alias(f"w{a}")) for a in ("x", "y"))
    scored = met.join(xs, "x").join(ys, "y").select("x", "y", products("tx", "wx", "ty", "wy").alias("similarity")).filter(F.col("similarity") >= least)

    # of a text that many rows have, only the first ids can come among the best
    ids = pool.join(texts.filter("in_pool").select("country", "text", F.col("text_id").alias("y")), ["country", "text"]).select("y", F.col("entity_id").alias("candidate_entity_id"), "source").distinct()
    ids = ids.withColumn("nth", F.row_number().over(Window.partitionBy("y").orderBy("candidate_entity_id", F.desc("source")))).filter(F.col("nth") <= 2 * top)
    best = scored.join(ids, "y").groupBy("x", "candidate_entity_id").agg(F.max("similarity").alias("similarity"), F.max("source").alias("candidate_source"))
    order = Window.partitionBy("x").orderBy(F.desc(F.round("similarity", 9)), "candidate_entity_id")
    best = best.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)
    mine = s1.join(texts.filter("in_s1").select("country", "text", F.col("text_id").alias("x")), ["country", "text"]).select("x", F.col("entity_id").alias("s1_entity_id")).distinct()
    return mine.join(best, "x").select("s1_entity_id", "candidate_entity_id", "candidate_source", "similarity", "place")
