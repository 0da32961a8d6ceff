"""Running Python functions over many arguments as Spark tasks.

Spark does what executors do: it batches, retries, moves results and reports
failures. These are the calls that a user of futures expects.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT = "index long, ok boolean, value binary, error string"


def named_partial(fn: Callable, *args, **kwargs) -> Callable:
    """fn with arguments filled in; it keeps its name."""

    def call(*more, **others):
        return fn(*args, *more, **(kwargs | others))

    call.__name__ = getattr(fn, "__name__", "call")
    return call


def map_to_table(spark: SparkSession, fn: Callable[[Any], Any], args: Iterable[Any], batch_size: int | None = None, job_count: int | None = None, fail_fast: bool = True) -> DataFrame:
    """One row (RESULT) per argument, in no order. The function travels once, the
    arguments one per row; batch_size arguments share a task, or they are dealt
    to job_count tasks. With fail_fast the first error fails the job, which Spark
    retries as often as spark.task.maxFailures says; else errors are rows."""
    rows = [(i, cloudpickle.dumps(a)) for i, a in enumerate(args)]
    n = job_count or -(-len(rows) // (batch_size or 1)) or 1
    code = cloudpickle.dumps(fn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = cloudpickle.loads(code)
        for b in batches:
            for i, arg in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    row = (i, True, cloudpickle.dumps(call(cloudpickle.loads(arg))), None)
                except Exception as e:
                    if fail_fast:
                        raise
                    row = (i, False, None, f"{type(e).__name__}: {e}")
                kinds = (pa.int64(), pa.bool_(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["index", "ok", "value", "error"])

    df = spark.createDataFrame(rows, "index long, arg binary")
    return df.repartition(min(n, max(1, len(rows)))).mapInArrow(run, RESULT)


def map_in_order(spark: SparkSession, fn: Callable[[Any], Any], args: Iterable[Any], **how) -> Iterator[Any]:
    """Results in the order of the arguments, one partition at a time on the driver."""
    for r in map_to_table(spark, fn, args, **how).orderBy("index").toLocalIterator():
        if not r["ok"]:
            raise RuntimeError(r["error"])
        yield cloudpickle.loads(r["value"])


def submit(spark: SparkSession, fn: Callable, *args, **kwargs) -> Any:
    return next(map_in_order(spark, lambda _: fn(*args, **kwargs), [None]))


def retried(fn: Callable[[], Any], tries: int = 5, first_wait: float = 0.5, errors: tuple = (OSError,)) -> Any:
    """fn's result, waiting twice as long after each failure that may pass."""
    for k in range(tries):
        try:
            return fn()
        except errors:
            if k == tries - 1:
                raise
            time.sleep(first_wait * 2**k)


def batches(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """df with the number of the batch of size rows that each row belongs to."""
    from ..plans.tables import numbered

    return numbered(df, order, "_index", first=0).withColumn("batch", F.floor(F.col("_index") / size)).drop("_index")
