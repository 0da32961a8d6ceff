"""Tables written to the folder that driver and executors share, to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or what setCheckpointDir set, or a folder of our own on
    one machine. A cluster without one is an error: its executors would write to
    disks that the others can't read."""
    global _own_dir
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    context = spark.sparkContext
    if (set_ := context._jsc.sc().getCheckpointDir()).isDefined():
        return set_.get().rstrip("/")
    if not re.match(r"local(\[|$)", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="latticeflow-")
    return _own_dir


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/latticeflow-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[str], name: str, first: int = 1) -> DataFrame:
    """df with a dense number in the order of columns, counted in parallel: rows
    are range-partitioned and sorted, and each partition starts where the counts
    of those before it end. The driver gets one count a partition."""
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    fixed = written(sorted_.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    counts = sorted((r["_part"], r["n"], r["low"]) for r in fixed.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("low")).collect())
    starts, total = [], first
    for part, n, low in counts:
        starts.append((part, total - low))
        total += n
    offsets = df.sparkSession.createDataFrame(starts or [(0, first)], "_part int, _shift long")
    return fixed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")
