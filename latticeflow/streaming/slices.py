"""Slices that arrive over time, and event streams with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.geometry import floor_div

SLICES = "z long, x long, y long, v long"


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, slices_per_batch: int = 32, schema: str = SLICES) -> StreamingQuery:
    """Slice files (Parquet) flow into a voxel table, slices_per_batch files at a
    time, partitioned by the batch of slices they belong to. A batch that runs
    again replaces what it wrote before, so nothing is stored twice; what is left
    at the end is flushed."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", slices_per_batch).parquet(source)

    def flush(batch: DataFrame, number: int) -> None:
        rows = batch.where("v <> 0").withColumn("slab", floor_div(F.col("z"), slices_per_batch))
        rows.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, at: str, value: str, keys: list[str], width: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums by time window; rows later than late are dropped and
    closed windows leave the state."""
    w = F.window(at, width, slide) if slide else F.window(at, width)
    return (
        events.withWatermark(at, late)
        .groupBy(w, *keys)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
        .select(F.col("window.start").alias("start"), *keys, "n", "total")
    )


def sessions(events: DataFrame, at: str, keys: list[str], gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    w = F.session_window(at, gap)
    return events.withWatermark(at, late).groupBy(w, *keys).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n"
    )
