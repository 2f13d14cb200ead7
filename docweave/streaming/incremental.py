"""Incremental runs. Batch operators are applied to a stream as they are; state lives in tables with a commit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import state


def stream(spark: SparkSession, path: str, schema: str, max_files: int = 100) -> DataFrame:
    """New Parquet files below ``path`` as they appear."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def run(source: DataFrame, operator: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Apply a stateless operator to everything that is new, once, exactly once per file."""
    return operator(source).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_decisions(log: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Keep a table of the last accepted decision per region up to date from a stream of events."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = state.latest_decisions(batch)
        old = _read(spark, f"{out}/v{batch_id - 1}", new)
        both = old.unionByName(new).groupBy("region_id").agg(F.max_by("decision", "event_no").alias("decision"), F.max("event_no").alias("event_no"))
        both.write.mode("overwrite").parquet(f"{out}/v{batch_id}")

    return log.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _read(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(like.schema).parquet(path) if there else like.limit(0)


def windowed_counts(events: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Events (ts, event) per window and kind, closed once the watermark has passed."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event").count()
