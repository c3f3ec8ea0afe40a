"""The same operators on streams: each is local to a row, so none needs state or a watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    """New Parquet files of a folder as they come."""
    r = spark.readStream.schema(schema).format("parquet")
    return (r.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else r).load(path)


def run_stream(sources: DataFrame, operator: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write ``operator(sources)`` to Parquet; exactly once, by the checkpoint."""
    w = operator(sources).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()
