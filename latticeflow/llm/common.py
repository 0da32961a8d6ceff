"""Helpers shared by the corpus operators: shared-folder tables and Arrow mapping."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans.tables import new_path


class Table:
    """A Parquet table in the shared folder; writing it cuts the lineage."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = new_path(self.spark, name)
        self.schema = df.schema
        df.write.parquet(self.path)

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of Arrow data whose rows are Python objects at one time.
SLICE_BYTES = 2 << 20


def _slices(batch: pa.RecordBatch | pa.Array, slice_bytes: int) -> Iterator:
    n = len(batch)
    step = max(1, int(n * slice_bytes / max(batch.nbytes, 1)))
    for at in range(0, n, step):
        yield batch.slice(at, step)


#: Rows of ids up to which the smaller side of a join is broadcast (some 30 MB); beyond, it is a shuffled join.
BROADCAST_ROWS = 500_000


def light(df: DataFrame) -> DataFrame:
    """df (a written table of ids and keys), to be broadcast if it is small enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def arrow_map(
    df: DataFrame,
    fn: Callable[[pa.RecordBatch], dict | None],
    schema: T.StructType,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """Apply fn to slices of about slice_bytes of Arrow data; fn returns columns
    by name. The Arrow batch itself is bounded by the session's
    spark.sql.execution.arrow.maxBytesPerBatch; what fn makes of it by the slice."""
    names = schema.fieldNames()
    types = [f.type for f in to_arrow_schema(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _slices(batch, slice_bytes):
                out = fn(some)
                if out is not None:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(out[n], type=t) for n, t in zip(names, types, strict=True)],
                        names=names,
                    )

    return df.mapInArrow(run, schema)


def arrow_column(fn: Callable[[list], list], kind: T.DataType, column: Column, slice_bytes: int = SLICE_BYTES) -> Column:
    """A column of fn's values for slices of another one. Only that column goes
    to Python; the others stay in the JVM."""
    of = to_arrow_schema(T.StructType([T.StructField("x", kind)])).field("x").type

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in arrays:
            parts = [pa.array(fn(some.to_pylist()), type=of) for some in _slices(values, slice_bytes)]
            yield pa.concat_arrays(parts) if parts else pa.array([], type=of)

    return F.arrow_udf(run, kind)(column)


def fresh(name: str, taken: list[str]) -> str:
    """A column name that is not taken, whatever its case."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


#: Tables of these many bytes that lie in fewer files than there are cores are dealt
#: anew: one row group is one task, whatever Python has to do with its rows.
SPREAD_BYTES = (1 << 20, 256 << 20)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    cores = spark.sparkContext.defaultParallelism
    if SPREAD_BYTES[0] < size < SPREAD_BYTES[1] and len(df.inputFiles()) < cores:
        df = df.repartition(cores)
    return df
