"""Connected components over a distributed table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links (a, b: long) -> node, root: each node's smallest reachable node, for the nodes that have links.

    Each round every node joins the one of itself and its neighbours that is first in an order by hash, which is another
    order each round, and links between what has become one node vanish. A constant share of the nodes goes each round,
    whatever the shape, so all rounds together handle a few times the links. Each round's tables are in the shared folder;
    the driver sees whether links are left. Hot nodes cost nothing: first neighbours are combined before the shuffle.
    """
    ends = [F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")]
    edges = common.materialize(links.select(*ends).filter("u <> v").distinct(), "links")
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        if len(maps) == most_rounds:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
        order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(len(maps))).alias("h"), F.col(c).alias("x"))  # noqa: B023, E731
        both = edges.select(F.col("u").alias("node"), order("v").alias("near")).unionAll(edges.select(F.col("v").alias("node"), order("u").alias("near")))
        step = both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("near", order("node"))["x"].alias("label"))
        step = common.materialize(step, "labels")
        maps.append(step)
        moved = edges.join(step.select(F.col("node").alias("u"), F.col("label").alias("a")), "u").join(step.select(F.col("node").alias("v"), F.col("label").alias("b")), "v")
        edges = common.materialize(moved.select(*ends).filter("u <> v").distinct(), "links")
    if not maps:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    whole = maps.pop()
    while maps:
        later = whole.select(F.col("node").alias("label"), F.col("label").alias("last"))
        whole = maps.pop().join(later, "label", "left").select("node", F.coalesce("last", "label").alias("label"))
    whole = common.materialize(whole, "labels")
    return whole.join(whole.groupBy("label").agg(F.min("node").alias("root")), "label").select("node", "root")
