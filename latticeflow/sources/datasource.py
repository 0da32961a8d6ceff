"""spark.read.format("voxels"): array formats behind Spark's Python Data Source API.

One input partition per chunk file; a box in the options leaves files out that
can't hold it. Paths must be on a file system that Arrow or a mount reaches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import arrays
from .files import VOXELS, get, open_fs


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class VoxelReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.driver = options.get("driver") or arrays.detect(self.path)
        self.box = json.loads(options["box"]) if "box" in options else None
        if self.driver not in ("zarr3", "wkw"):
            raise ValueError(f"{self.driver}: use read_array")

    def _side(self) -> tuple[int, ...]:
        if self.driver == "wkw":
            h = arrays.WkwHeader.parse(get(f"{self.path}/header.wkw"))
            return (h.block * h.blocks,) * 3
        return arrays.zarr3_info(json.loads(get(f"{self.path}/zarr.json"))).shard

    def _index(self, path: str) -> tuple[int, ...] | None:
        if self.driver == "wkw":
            m = re.search(r"/z(\d+)/y(\d+)/x(\d+)\.wkw$", path)
            return tuple(map(int, m.groups()[::-1])) if m else None
        m = re.search(r"/c/(\d+)/(\d+)/(\d+)$", path)
        return tuple(map(int, m.groups())) if m else None

    def partitions(self) -> list[InputPartition]:
        from pyarrow.fs import FileSelector

        fs, root = open_fs(self.path)
        side, found = self._side(), []
        for f in fs.get_file_info(FileSelector(root, recursive=True)):
            at = self._index(f.path)
            if at is None:
                continue
            if self.box and any(i * s >= hi or (i + 1) * s <= lo for i, s, lo, hi in zip(at, side, *self.box, strict=True)):
                continue
            found.append(_File(f.path))
        return found

    def read(self, partition: _File) -> Iterator[tuple]:
        fs, _ = open_fs(self.path)
        with fs.open_input_stream(partition.path, compression=None) as f:
            data = f.read()
        at = self._index(partition.path)
        if self.driver == "wkw":
            h = arrays.WkwHeader.parse(data)
            blocks = ((np.array(at) * h.block * h.blocks + np.array(b) * h.block, a[0]) for b, a in arrays.wkw_blocks(data))
        else:
            meta = json.loads(get(f"{self.path}/zarr.json"))
            info = arrays.zarr3_info(meta)
            blocks = arrays._clipped(info, arrays._zarr3_blocks(meta, info, at, data, 0))
        for corner, a in blocks:
            for p in np.argwhere(a):
                q = p + corner
                if self.box is None or all(lo <= c < hi for c, lo, hi in zip(q, *self.box, strict=True)):
                    yield (*map(int, q), int(a[tuple(p)]))


class VoxelSource(DataSource):
    """Options: path, driver (zarr3 or wkw, else found out), box as JSON [[x0, y0, z0], [x1, y1, z1]]."""

    @classmethod
    def name(cls) -> str:
        return "voxels"

    def schema(self) -> str:
        return VOXELS

    def reader(self, schema) -> DataSourceReader:
        return VoxelReader(self.options)


def register(spark) -> None:
    spark.dataSource.register(VoxelSource)
