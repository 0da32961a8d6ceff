"""Copying trees of files, and paged services as tables."""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import open_fs, put

MODES = ("copy", "move", "symlink")


def copy_tree(spark: SparkSession, source: str, target: str, ignore: tuple[str, ...] = ()) -> int:
    """Copy every file below source whose name fits none of ignore; the list is
    dealt to tasks and each file moves into place whole. Returns the bytes copied."""
    fs, root = open_fs(source)
    files = [f.path for f in fs.get_file_info(pa.fs.FileSelector(root, recursive=True)) if f.is_file]
    chosen = [(p[len(root) :],) for p in files if not any(fnmatch.fnmatch(os.path.basename(p), g) for g in ignore)]
    if not chosen:
        return 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(source)
        n = 0
        for b in batches:
            for p in b.column(0).to_pylist():
                with fs.open_input_stream(root + p, compression=None) as f:
                    data = f.read()
                put(target + p, data)
                n += len(data)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    done = spark.createDataFrame(chosen, "path string").repartition(min(len(chosen), 256)).mapInArrow(run, "n long")
    return sum(r["n"] for r in done.collect())


def transfer(spark: SparkSession, source: str, target: str, mode: str = "copy") -> None:
    """copy; move, leaving a link behind; or link only (shared mounts)."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    fs, a = open_fs(source)
    _, b = open_fs(target)
    if mode == "copy":
        copy_tree(spark, source, target)
        return
    if mode == "move":
        fs.move(a, b)
        a, b = b, a
    os.symlink(a, b)


class _Page(InputPartition):
    def __init__(self, number: int):
        self.number = number


def paged(name: str, schema: str, count: Callable[[], int], fetch: Callable[[int, int], list[tuple]], size: int = 1000) -> type[DataSource]:
    """A data source over a service that returns pages: one task a page. count
    tells how many rows there are; fetch(limit, page) gives the rows of one."""

    class Reader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            return [_Page(k) for k in range(-(-count() // size))]

        def read(self, partition: _Page) -> Iterator[tuple]:
            yield from fetch(size, partition.number)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:
            return Reader()

    return Source


def load_pages(spark: SparkSession, source: type[DataSource]) -> DataFrame:
    spark.dataSource.register(source)
    return spark.read.format(source.name()).load()


class RegionService:
    """Chunks of a remote array through any function box -> bytes (Fortran order)."""

    def __init__(self, fetch: Callable[[tuple, tuple], bytes | None], dtype: str):
        self.fetch, self.dtype = fetch, dtype

    def read(self, spark: SparkSession, box, chunk: int = 512) -> DataFrame:
        import numpy as np

        from .files import VOXELS

        rows = [(*map(int, b.low), *map(int, b.size)) for b in box.chunks(chunk)]
        fetch, dtype = self.fetch, self.dtype

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    data = fetch(r[:3], r[3:])
                    if data:
                        a = np.frombuffer(data, dtype).reshape(r[3:], order="F")
                        p = np.argwhere(a)
                        q = p + np.array(r[:3])
                        yield pa.RecordBatch.from_pydict({"x": q[:, 0], "y": q[:, 1], "z": q[:, 2], "v": a[tuple(p.T)].astype(np.int64)})

        df = spark.createDataFrame(rows, "x long, y long, z long, sx long, sy long, sz long")
        return df.repartition(max(1, len(rows))).mapInArrow(run, VOXELS)
