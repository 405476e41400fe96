"""Shared pieces of the training-data operators: durable intermediate tables (of the library) and batch slicing."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stage import drop, drop_path, materialize, new_path, shared_dir  # noqa: F401

A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The six characters that separate words: space and \\x09-\\x0D.
WORD_GAP = "[\\x20\\x09-\\x0D]+"


def dealt(blocks: DataFrame, parts: int) -> DataFrame:
    """Rows with a part `p` below `parts`, dealt so that no task has many parts at once where there are more of them than
    shuffle partitions; else Spark deals and coalesces them."""
    return blocks.repartition(parts, "p") if parts > int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")) else blocks


def ascii_lower(c: Column | str) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(c if isinstance(c, Column) else F.col(c), A_TO_Z, A_TO_Z.lower())


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches into runs of rows with about `most` bytes of text, so that what Python holds at once is
    bounded by that or by the longest single text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        first = size = 0
        for i, n in enumerate(lengths):
            if size and size + n > most:
                yield batch.slice(first, i - first)
                first, size = i, 0
            size += int(n) + 64
        yield batch.slice(first)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [t or "" for t in batch.column(column).to_pylist()]
