"""Comparing what lies in common buckets block by block, without a row for each pair."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def links_within(rest: DataFrame, values: DataFrame, alike: Callable[[list, np.ndarray], np.ndarray], block_nodes: int, block_weight: int) -> DataFrame:
    """rest (band, node, n, root): members of buckets with their weights and components; values (node, value) -> links (a, b)
    between members of a bucket that lie in different components.

    The buckets with the same largest component are a family, and each pair of a bucket's members lies in one. A family is
    split into blocks of about block_nodes members and block_weight of their weights; a task holds two blocks and asks
    `alike` (values, a matrix of the pairs that matter) for the pairs that are links. Rows grow with the square of a
    family's size over block_nodes, and only links leave a task.
    """
    counts = rest.groupBy("band", "root").agg(F.count("*").alias("k"))
    anchors = counts.groupBy("band").agg(F.max_by("root", F.struct("k", -F.col("root"))).alias("anchor"))
    family = common.materialize(rest.join(anchors, "band").select("anchor", "node", "n", "root").distinct(), "families")
    blocks = family.groupBy("anchor").agg(F.greatest(F.ceil(F.count("*") / block_nodes), F.ceil(F.sum("n") / block_weight)).cast("int").alias("blocks"))
    placed = family.join(blocks, "anchor").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    placed = placed.select("anchor", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "root").join(values, "node")

    def compare(table: pa.Table) -> pa.Table:
        node, root, block = (table.column(c).to_numpy() for c in ("node", "root", "block"))
        matter = (root[:, None] != root[None, :]) & (node[:, None] < node[None, :])
        if block.min() != block.max():
            matter &= block[:, None] != block[None, :]
        a, b = np.nonzero(alike(table.column("value").to_pylist() if pa.types.is_string(table.schema.field("value").type) else [x.values.to_numpy() for x in table.column("value")], matter))
        return pa.table([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

    return placed.groupBy("anchor", "low", "high").applyInArrow(compare, "a long, b long")
