"""Long arrays beside a layer (1-D, or 2-D of a few columns) as sharded zarr 3."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import ArrayInfo, _decode_chunk, _zarr3_blocks, _zarr3_shard, zarr3_info, zarr3_metadata
from .files import get, put, scan

#: Bytes that a chunk and a shard aim at.
CHUNK_BYTES, SHARD_BYTES = 1 << 20, 16 << 20


def write_column(df: DataFrame, path: str, length: int, dtype: str, columns: tuple[str, ...] = ("value",), chunk_bytes: int = CHUNK_BYTES, shard_bytes: int = SHARD_BYTES) -> int:
    """df (index, columns) as an array of length rows; one column makes it 1-D. A
    task holds one shard; rows that df lacks are 0, shards of zeros are left out.
    Returns how many shards were written."""
    wide = len(columns)
    row = np.dtype(dtype).itemsize * wide
    chunk = max(1, chunk_bytes // row)
    per = min(max(1, shard_bytes // (chunk * row)), max(1, -(-length // chunk)))
    tail = (wide,) if wide > 1 else ()
    info = ArrayInfo("zarr3", dtype, (length, *tail), (chunk, *tail), (chunk * per, *tail), True, 1, ("i", "j")[: 1 + len(tail)])
    meta = zarr3_metadata(info)
    put(f"{path}/zarr.json", json.dumps(meta).encode())
    name = lambda k: f"{path}/c/{k}" + "/0" * len(tail)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, dense, n = None, None, 0
        for b in batches:
            if not b.num_rows:
                continue
            shard, index = b.column(0).to_numpy(), b.column(1).to_numpy()
            values = np.stack([b.column(2 + k).to_numpy(zero_copy_only=False) for k in range(wide)], axis=1).astype(dtype)
            cuts = np.flatnonzero(np.diff(shard)) + 1
            for s, i, v in zip(np.split(shard, cuts), np.split(index, cuts), np.split(values, cuts), strict=True):
                if s[0] != key:
                    if key is not None and dense.any():
                        put(name(key), _zarr3_shard(meta, info, dense))
                        n += 1
                    key, dense = int(s[0]), np.zeros(info.shard, dtype)
                dense[i - key * info.shard[0]] = v if wide > 1 else v[:, 0]
        if key is not None and dense.any():
            put(name(key), _zarr3_shard(meta, info, dense))
            n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    shard = F.floor(F.col("index") / info.shard[0]).alias("shard")
    dealt = df.select(shard, F.col("index").cast("long").alias("index"), *columns).repartition("shard").sortWithinPartitions("shard", "index")
    return sum(r["n"] for r in dealt.mapInArrow(run, "n long").collect())


def read_column(spark: SparkSession, path: str, columns: tuple[str, ...] = ("value",)) -> DataFrame:
    """(index, columns) of every row, zeros too."""
    meta = json.loads(get(f"{path}/zarr.json"))
    info = zarr3_info(meta | {"dimension_names": ["i", "j"][: len(meta["shape"])]})
    real = np.dtype(info.dtype).kind == "f"
    kind = np.float64 if real else np.int64
    key = re.compile(r"/c/(\d+)(?:/0)?$")
    names = ["index", *columns]

    def rows(first: int, a: np.ndarray) -> pa.RecordBatch:
        a = a.reshape(len(a), -1)[: max(0, info.shape[0] - first)].astype(kind)
        return pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(a))), *(pa.array(a[:, k]) for k in range(len(columns)))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                shard, data = b.column(0)[k].as_py(), b.column(1)[k].as_py()
                first, stored = shard * info.shard[0], {}
                if data is not None and info.shard == info.chunk and meta["codecs"][0]["name"] != "sharding_indexed":
                    stored[first] = _decode_chunk(data, info.chunk, info.dtype, meta["codecs"])
                elif data is not None:
                    flat = replace(info, axes=("x", "y")[: len(info.axes)])
                    stored = {int(c[0]): a.reshape(info.chunk) for c, a in _zarr3_blocks(meta, flat, (shard, 0)[: len(info.axes)], data, 0)}
                for at in range(first, min(first + info.shard[0], info.shape[0]), info.chunk[0]):
                    yield rows(at, stored.get(at, np.zeros(info.chunk, info.dtype)))

    shards = spark.range(-(-info.shape[0] // info.shard[0])).withColumnRenamed("id", "shard")
    files = scan(spark, path).where(F.col("path").rlike(key.pattern)).select(F.regexp_extract("path", key.pattern, 1).cast("long").alias("shard"), "content")
    schema = ", ".join(["index long", *(f"{c} {'double' if real else 'long'}" for c in columns)])
    return shards.join(files, "shard", "left").select("shard", "content").mapInArrow(run, schema)
