"""Candidates for a stream of reference records against a pool that stays: each micro-batch is a stream-static join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import blocking
from ..sources import stage, tables


def candidate_stream(records: DataFrame, pool: DataFrame, output: str, checkpoint: str, how: blocking.Blocking = blocking.Blocking()) -> StreamingQuery:
    """records: a stream under any of the record columns' names. Each micro-batch's candidates go to a folder of their own,
    overwritten if the batch is run again, so a restart neither loses nor repeats any. The pool is prepared once and
    written, a batch's records once a batch; those are removed when the batch is done."""
    ready = blocking.prepared(tables.standardize(pool), how)

    def each(batch: DataFrame, number: int) -> None:
        s1 = blocking.prepared(tables.standardize(batch, "S1"), how)
        blocking.candidates(s1, ready, how).write.mode("overwrite").parquet(f"{output}/batch={number}")
        stage.drop(s1)

    return records.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
