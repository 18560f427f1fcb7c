"""The bounded probe as a stream: files of the probe side come in micro-batches under a byte budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessel.operators.joins import sort_merge_join


def probe_stream(spark: SparkSession, path: str, schema, budget_bytes: int) -> DataFrame:
    """A stream over parquet files whose batches take whole files up to about budget_bytes."""
    if budget_bytes < 1:
        raise ValueError("the budget must be positive")
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", str(budget_bytes)).parquet(path)


def start_bounded_join(build: DataFrame, probe: DataFrame, out: str, checkpoint: str, key: str = "key") -> StreamingQuery:
    """Join each batch of the probe stream to the build table and append it to out; ends when the input is read.

    Restarted with the same checkpoint it goes on where it stopped, and each batch is written once.
    """
    joined = sort_merge_join(build, probe, key)
    return joined.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
