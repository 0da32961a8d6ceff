"""Dataset, Layer and Mag: a thin object view over voxel tables and their metadata.

A dataset is a folder with a properties file; each magnification of a layer is a
Parquet voxel table or an array in one of the chunked formats. Everything is
lazy until it is written.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import affine
from .functions.geometry import Box, Vec, mag, mag_name
from .functions.scalars import SPARK_TYPES
from .operators import aggregate, region, resample
from .plans import schedule
from .sources import arrays, metadata, transfer, volumes
from .sources.files import get, open_fs, put

CATEGORIES = ("color", "segmentation")
#: Kinds of attachments, and those of which a layer has one at most (fixed values).
ATTACHMENTS = ("meshes", "agglomerates", "connectomes", "segmentIndex", "segmentStatistics", "cumsum")
SINGLE = ("segmentIndex", "segmentStatistics", "cumsum")
FORMATS = ("parquet", "zarr3", "zarr2", "wkw", "n5", "precomputed")
WRITABLE = ("parquet", "zarr3", "zarr2", "wkw")


@dataclass
class Mag:
    """One magnification of a layer; coordinates are in voxels of magnification 1
    at the surface and in its own voxels in the table."""

    layer: Layer
    mag: Vec
    view_box: Box | None = None

    @property
    def path(self) -> str:
        return f"{self.layer.path}/{mag_name(self.mag)}"

    @property
    def box(self) -> Box:
        """The layer's box grown to this magnification, or the view's part of it."""
        return (self.view_box or self.layer.box).aligned(self.mag, ceil=True)

    def table(self, box: Box | None = None) -> DataFrame:
        """Voxels, or those of a box in this magnification's voxels: of an array
        only the files that it touches are read. A layer of several channels has
        a column c."""
        spark = self.layer.dataset.spark
        if self.view_box is not None:
            inner = self.view_box.in_mag(self.mag)
            box = box.intersected(inner) if box is not None else inner
        if self.layer.data_format == "parquet":
            df = spark.read.parquet(self.path)
        else:
            some = {} if box is None or self.layer.data_format == "precomputed" else {"box": box}
            df = arrays.read_array(spark, self.path, self.layer.data_format, channel=None if self.layer.channels > 1 else 0, **some)
        return region.read(df, box) if box is not None else df

    def view(self, top_left, size) -> Mag:
        """A lazy part; top_left and size in voxels of magnification 1."""
        part = Box.of(top_left, size)
        if not self.box.contains_box(part):
            raise ValueError("a view must lie inside")
        return Mag(self.layer, self.mag, part)

    def read(self, box: Box | None = None, dense: bool = False) -> DataFrame:
        inner = (box or self.box).aligned(self.mag, ceil=True).in_mag(self.mag)
        return (region.read_dense if dense else region.read)(self.table(inner), inner)

    def used_storage(self) -> int:
        """Bytes of its files."""
        files = self.layer.dataset.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.path)
        return files.agg(F.sum("length")).first()[0] or 0

    def chunk_boxes(self, shape=None) -> list[Box]:
        return list(self.box.chunks(shape or Vec.of(self.layer.shard) * self.mag))

    def for_each_chunk(self, fn: Callable, schema: str, shape=None) -> DataFrame:
        return region.map_chunks(region.to_chunks(self.table(), shape or self.layer.shard), fn, schema)

    map_chunk = for_each_chunk

    def write(self, data: DataFrame, box: Box | None = None, allow_resize: bool = False) -> Mag:
        """Replace a box (all if none) by data; the table is written anew beside
        the old one and then takes its place."""
        if box is not None:
            if not self.box.contains_box(box):
                if not allow_resize:
                    raise ValueError("the box reaches over the layer")
                self.layer.box = self.layer.box.hull(box)
            data = region.write(self.table(), data, box.in_mag(self.mag))
        return self._store(data)

    def _store(self, data: DataFrame) -> Mag:
        layer = self.layer
        fs, path = open_fs(self.path)
        fresh = f"{self.path}.new"
        fs_fresh = f"{path}.new"
        if fs.get_file_info(fs_fresh).is_file is False and fs.get_file_info(fs_fresh).type.name == "Directory":
            fs.delete_dir(fs_fresh)
        extra = {"c": layer.channels} if layer.channels > 1 else {}
        kind = "double" if layer.dtype.startswith("float") else "long"
        data = data.select(*extra, "x", "y", "z", F.col("v").cast(kind).alias("v")).where("v <> 0")
        shape = layer.box.aligned(self.mag, ceil=True).in_mag(self.mag).high
        if layer.data_format == "parquet":
            data.repartitionByRange(*region.chunk_key(layer.shard)).sortWithinPartitions("x", "y", "z").write.parquet(fresh)
        elif layer.data_format == "zarr3":
            arrays.write_zarr3(data, fresh, shape, layer.dtype, layer.chunk, layer.shard, extra=extra)
        elif extra and layer.data_format == "zarr2":
            raise ValueError("zarr2 layers have one channel")
        elif layer.data_format == "zarr2":
            arrays.write_zarr2(data, fresh, shape, "<" + {"uint": "u", "int": "i", "float": "f"}[layer.dtype.rstrip("0123456789")] + str(int(layer.dtype.lstrip("uintfloa")) // 8), layer.chunk)
        elif layer.data_format == "wkw":
            arrays.write_wkw(data, fresh, layer.dtype, Vec.of(layer.chunk).x, Vec.of(layer.shard).x // Vec.of(layer.chunk).x, channels=extra.get("c"))
        else:
            raise ValueError(f"{layer.data_format} is read only")
        # The old one is moved aside first: whenever this stops, one of the two is whole.
        aside, there = f"{path}.old", fs.get_file_info(path).type.name == "Directory"
        if there:
            if fs.get_file_info(aside).type.name == "Directory":
                fs.delete_dir(aside)
            fs.move(path, aside)
        fs.move(fs_fresh, path)
        if there:
            fs.delete_dir(aside)
        layer.dataset.save()
        return self

    def overlay(self, other: Mag) -> Mag:
        return self._store(region.overlay(self.table(), other.table(), self.layer.shard))

    def rechunk(self, chunk, shard) -> Mag:
        self.layer.chunk, self.layer.shard = tuple(Vec.of(chunk)), tuple(Vec.of(shard))
        return self._store(self.table())

    def content_is_equal(self, other: Mag) -> bool:
        """Sizes and voxels agree; where the boxes lie doesn't matter."""
        if tuple(self.box.size) != tuple(other.box.size):
            return False
        by = [-v for v in self.box.in_mag(self.mag).low], [-v for v in other.box.in_mag(other.mag).low]
        return bool(region.content_difference(region.shifted(self.table(), by[0]), region.shifted(other.table(), by[1])).first()["equal"])


@dataclass
class Layer:
    dataset: Dataset
    name: str
    category: str
    box: Box
    dtype: str = "uint32"
    data_format: str = "parquet"
    chunk: tuple = (32, 32, 32)
    shard: tuple = (128, 128, 128)
    mags: dict[str, Mag] = field(default_factory=dict)
    largest_segment_id: int | None = None
    attachments: list[dict] = field(default_factory=list)
    channels: int = 1

    @property
    def path(self) -> str:
        return f"{self.dataset.path}/{self.name}"

    def add_mag(self, m, data: DataFrame | None = None) -> Mag:
        m = mag(m)
        if mag_name(m) in self.mags:
            raise ValueError(f"magnification {mag_name(m)} exists")
        made = self.mags[mag_name(m)] = Mag(self, m)
        if data is not None:
            made._store(data)
        self.dataset.save()
        return made

    def get_or_add_mag(self, m) -> Mag:
        return self.mags.get(mag_name(mag(m))) or self.add_mag(m)

    def finest(self) -> Mag:
        return min(self.mags.values(), key=lambda x: x.mag.largest())

    def delete_mag(self, m) -> None:
        fs, path = open_fs(self.mags.pop(mag_name(mag(m))).path)
        fs.delete_dir(path)
        self.dataset.save()

    def downsample(self, coarsest=None, mode: str = "default", sampling: str = "anisotropic", from_mag=None) -> list[Mag]:
        start = self.mags[mag_name(mag(from_mag))] if from_mag else self.finest()
        last = mag(coarsest) if coarsest is not None else schedule.default_coarsest(self.box.size)
        if sampling == "constant_z":
            last = last.replace("z", start.mag.z)
        size = self.dataset.voxel_size if sampling == "anisotropic" else None
        others = [m.mag for layer in self.dataset.layers.values() if layer is not self for m in layer.mags.values()]
        made = []
        for step in schedule.coarser_mags(start.mag, last, size, others):
            made.append(self.downsample_mag(start.mag, step, mode))
            start = made[-1]
        return made

    def downsample_mag(self, source, target, mode: str = "default") -> Mag:
        source, target = mag(source), mag(target)
        mode = schedule.interpolation(mode, self.category)
        table = self.mags[mag_name(source)].table()
        factor = target // source
        spline = mode in ("nearest", "bilinear", "bicubic")
        made = resample.resample_tiles(table, factor, mode) if spline else resample.downsample(table, factor, mode)
        return self.get_or_add_mag(target)._store(made)

    def redownsample(self, mode: str = "default") -> list[Mag]:
        order = sorted((m.mag for m in self.mags.values()), key=lambda m: m.largest())
        return [self.downsample_mag(a, b, mode) for a, b in zip(order, order[1:], strict=False)]

    def upsample(self, from_mag, finest=1, sampling: str = "anisotropic") -> list[Mag]:
        now, made = mag(from_mag), []
        size = self.dataset.voxel_size if sampling == "anisotropic" else None
        for step in schedule.finer_mags(now, finest, size):
            table = resample.upsample(self.mags[mag_name(now)].table(), now // step)
            made.append(self.get_or_add_mag(step)._store(table))
            now = step
        return made

    def transform(self, matrix: affine.Matrix, name: str, target: Box | None = None, fill: int = 0, mask: Layer | None = None) -> Layer:
        """A new layer with this one's finest voxels moved; the result is shifted
        so that nothing lies below 0."""
        view = self.finest()
        source = view.box.in_mag(view.mag)
        reach = target or affine.apply_to_box(matrix, source)
        shift = [-min(0, v) for v in reach.low]
        full = affine.chain(matrix, affine.translation(shift))
        reach = reach.offset(shift)
        where = mask.finest().table() if mask else None
        moved = region.transformed(view.table(), full, source, reach, fill, where) if fill else region.moved(view.table(), full, source, reach, where)
        made = self.dataset.add_layer(name, self.category, reach.from_mag(view.mag), self.dtype, self.data_format)
        made.add_mag(view.mag, moved)
        return made

    def refresh_largest_segment_id(self) -> int | None:
        self.largest_segment_id = aggregate.largest_id(self.finest().table()).first()["largest"]
        self.dataset.save()
        return self.largest_segment_id

    def add_mag_from_files(self, m, path: str, move: bool = False, extend_box: bool = True) -> Mag:
        """An array that is there already becomes a magnification: moved in, or
        linked. Its type and format must be the layer's; the layer's box grows to
        the array's unless it is kept."""
        m = mag(m)
        driver = arrays.detect(path)
        if driver != self.data_format:
            raise ValueError(f"the array is {driver}, the layer {self.data_format}")
        if mag_name(m) in self.mags:
            raise ValueError(f"magnification {mag_name(m)} exists")
        made = Mag(self, m)
        fs, target = open_fs(made.path)
        fs.create_dir(target.rpartition("/")[0])
        if move:
            fs.move(open_fs(path)[1], target)
        else:
            transfer.transfer(self.dataset.spark, path, made.path, "symlink")
        if extend_box:
            self.box = self.box.hull(arrays.array_box(made.path, driver).from_mag(m))
        self.mags[mag_name(m)] = made
        self.dataset.save()
        return made

    def attachment(self, kind: str, name: str) -> dict:
        found = [a for a in self.attachments if (a["kind"], a["name"]) == (kind, name)]
        if not found:
            raise KeyError(f"{kind} {name}")
        return found[0]

    def add_attachment(self, kind: str, name: str, path: str, copy: bool = False) -> None:
        """Register what lies at path, or a copy of it beside the layer. Names are
        unique within a kind, and of some kinds there is one at most."""
        if kind not in ATTACHMENTS:
            raise ValueError(f"no attachments are called {kind}")
        if any(a["kind"] == kind and (a["name"] == name or kind in SINGLE) for a in self.attachments):
            raise ValueError(f"attachment {name} exists")
        if copy:
            target = f"{self.path}/{kind}/{path.rstrip('/').rpartition('/')[2]}"
            fs, source = open_fs(path)
            if fs.get_file_info(source).type.name == "Directory":
                transfer.copy_tree(self.dataset.spark, path, target)
            else:
                put(target, get(path))
            path = target
        self.attachments.append({"kind": kind, "name": name, "path": path})
        self.dataset.save()

    def rename_attachment(self, kind: str, name: str, to: str) -> None:
        if any((a["kind"], a["name"]) == (kind, to) for a in self.attachments):
            raise ValueError(f"attachment {to} exists")
        self.attachment(kind, name)["name"] = to
        self.dataset.save()

    def delete_attachment(self, kind: str, name: str, files: bool = False) -> None:
        """Forget it; its files go only if they lie beside the layer and that is asked for."""
        found = self.attachment(kind, name)
        self.attachments.remove(found)
        if files and found["path"].startswith(f"{self.path}/"):
            fs, path = open_fs(found["path"])
            (fs.delete_dir if fs.get_file_info(path).type.name == "Directory" else fs.delete_file)(path)
        self.dataset.save()

    def detect_attachments(self) -> list[dict]:
        """Register files of older datasets that only their place tells."""
        fs, root = open_fs(self.path)
        for kind in ("meshes", "agglomerates", "connectomes", "segmentIndex"):
            if fs.get_file_info(f"{root}/{kind}").type.name != "Directory":
                continue
            for f in sorted(fs.get_file_info(pafs.FileSelector(f"{root}/{kind}")), key=lambda f: f.path):
                stem, _, suffix = f.base_name.rpartition(".")
                if suffix == "hdf5":
                    self.add_attachment(kind, stem, f"{self.path}/{kind}/{f.base_name}")
        if fs.get_file_info(f"{root}/agglomerates/cumsum.json").is_file:
            self.add_attachment("cumsum", "cumsum", f"{self.path}/agglomerates/cumsum.json")
        return self.attachments

    def rename(self, name: str) -> None:
        fs, old = open_fs(self.path)
        del self.dataset.layers[self.name]
        self.name = name
        self.dataset.layers[name] = self
        fs.move(old, open_fs(self.path)[1])
        self.dataset.save()


class Dataset:
    def __init__(self, spark: SparkSession, path: str, voxel_size=(1.0, 1.0, 1.0), unit: str = "nanometer", name: str | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.voxel_size, self.unit = tuple(voxel_size), unit
        self.name = name or self.path.rpartition("/")[2]
        self.layers: dict[str, Layer] = {}

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Dataset:
        p = metadata.read(path)
        scale = p["scale"]
        factor, unit = (scale["factor"], scale.get("unit", "nanometer")) if isinstance(scale, dict) else (scale, "nanometer")
        ds = cls(spark, path, factor, unit, p["id"]["name"])
        for at in p["dataLayers"]:
            b = at["boundingBox"]
            kind = at["elementClass"]
            layer = Layer(ds, at["name"], at["category"], Box.of(b["topLeft"], (b["width"], b["height"], b["depth"])), kind, at.get("dataFormat", "wkw"))
            layer.largest_segment_id = at.get("largestSegmentId")
            layer.attachments = at.get("attachments", [])
            layer.chunk, layer.shard = tuple(at.get("chunk", layer.chunk)), tuple(at.get("shard", layer.shard))
            layer.channels = at.get("numChannels", 1)
            for m in at["mags"]:
                v = mag(m["mag"])
                layer.mags[mag_name(v)] = Mag(layer, v)
            ds.layers[layer.name] = layer
        return ds

    def save(self) -> None:
        rows = []
        for x in self.layers.values():
            mags = [{"mag": list(m.mag), "path": f"./{x.name}/{n}"} for n, m in sorted(x.mags.items(), key=lambda kv: kv[1].mag.largest())]
            at = metadata.layer(x.name, x.category, x.box, x.dtype, x.data_format, mags, x.largest_segment_id)
            rows.append(at | {"chunk": list(x.chunk), "shard": list(x.shard), "attachments": x.attachments, "numChannels": x.channels})
        metadata.write(self.path, metadata.properties(self.name, self.voxel_size, self.unit, rows))

    def add_layer(self, name: str, category: str, box: Box, dtype: str = "uint32", data_format: str = "parquet", chunk=(32, 32, 32), shard=(128, 128, 128), channels: int = 1) -> Layer:
        if name in self.layers:
            raise ValueError(f"layer {name} exists")
        if category not in CATEGORIES or dtype not in SPARK_TYPES or data_format not in FORMATS:
            raise ValueError("unknown category, type or format")
        if any(v < 0 for v in box.low):
            raise ValueError("a layer can't begin below 0")
        layer = self.layers[name] = Layer(self, name, category, box, dtype, data_format, tuple(Vec.of(chunk)), tuple(Vec.of(shard)), channels=channels)
        self.save()
        return layer

    def get_or_add_layer(self, name: str, category: str, box: Box, **how) -> Layer:
        found = self.layers.get(name)
        if found and found.category != category:
            raise ValueError(f"layer {name} is of another category")
        return found or self.add_layer(name, category, box, **how)

    def add_layer_like(self, other: Layer, name: str) -> Layer:
        return self.add_layer(name, other.category, other.box, other.dtype, other.data_format, other.chunk, other.shard, other.channels)

    def write_layer(self, name: str, category: str, data: DataFrame, box: Box, downsample: bool = False, **how) -> Layer:
        layer = self.add_layer(name, category, box, **how)
        layer.add_mag(1, data)
        if category == "segmentation":
            layer.refresh_largest_segment_id()
        if downsample:
            layer.downsample()
        return layer

    def by_category(self, category: str) -> list[Layer]:
        return [x for x in self.layers.values() if x.category == category]

    def bounding_box(self) -> Box:
        boxes = [x.box for x in self.layers.values()]
        total = boxes[0]
        for b in boxes[1:]:
            total = total.hull(b)
        return total

    def delete_layer(self, name: str) -> None:
        fs, path = open_fs(self.layers.pop(name).path)
        if fs.get_file_info(path).type.name == "Directory":
            fs.delete_dir(path)
        self.save()

    def downsample(self, coarsest=None, sampling: str = "anisotropic") -> None:
        for layer in self.layers.values():
            layer.downsample(coarsest, sampling=sampling)

    def copy(self, path: str, data_format: str | None = None, chunk=None, shard=None, ignore: tuple[str, ...] = ()) -> Dataset:
        made = Dataset(self.spark, path, self.voxel_size, self.unit)
        for x in self.layers.values():
            if x.name not in ignore:
                made.copy_layer(x, data_format=data_format, chunk=chunk, shard=shard)
        return made

    def shallow_copy(self, path: str, ignore: tuple[str, ...] = ()) -> Dataset:
        """A dataset of its own properties whose layers are links to this one's files."""
        made = Dataset(self.spark, path, self.voxel_size, self.unit)
        for x in self.layers.values():
            if x.name in ignore:
                continue
            layer = made.add_layer_like(x, x.name)
            layer.largest_segment_id, layer.attachments = x.largest_segment_id, [dict(a) for a in x.attachments]
            for n, m in x.mags.items():
                layer.mags[n] = Mag(layer, m.mag)
                fs, target = open_fs(layer.mags[n].path)
                fs.create_dir(target.rpartition("/")[0])
                transfer.transfer(self.spark, m.path, layer.mags[n].path, "symlink")
        made.save()
        return made

    def copy_layer(self, other: Layer, name: str | None = None, data_format: str | None = None, chunk=None, shard=None) -> Layer:
        target = data_format or (other.data_format if other.data_format in WRITABLE else "zarr3")
        layer = self.add_layer(name or other.name, other.category, other.box, other.dtype, target, chunk or other.chunk, shard or other.shard, other.channels)
        for m in other.mags.values():
            layer.add_mag(m.mag, m.table())
        layer.largest_segment_id = other.largest_segment_id
        self.save()
        return layer

    def is_equal(self, other: Dataset) -> bool:
        if self.layers.keys() != other.layers.keys():
            return False
        for n, x in self.layers.items():
            y = other.layers[n]
            if (tuple(x.box.low), tuple(x.box.high), x.mags.keys()) != (tuple(y.box.low), tuple(y.box.high), y.mags.keys()):
                return False
            if not all(m.content_is_equal(y.mags[k]) for k, m in x.mags.items()):
                return False
        return True

    def merge_fallback(self, volume: Layer, fallback: Layer, name: str) -> Layer:
        """The fallback layer with the annotated chunks on top, at the volume's finest magnification."""
        layer = self.copy_layer(fallback, name)
        layer.box = layer.box.hull(volume.box)
        m = volume.finest()
        layer.get_or_add_mag(m.mag).overlay(m)
        return layer

    @classmethod
    def from_raw(cls, spark: SparkSession, source: str, path: str, shape, dtype: str, layer: str = "color", **how) -> Dataset:
        ds = cls(spark, path)
        data = volumes.read_raw(spark, source, tuple(shape), dtype, **how)
        ds.write_layer(layer, "color", data, Box.of(0, tuple(shape)), dtype=dtype)
        return ds

    @classmethod
    def from_images(cls, spark: SparkSession, source: str, path: str, layer: str = "color", category: str = "color", dtype: str = "uint8") -> Dataset:
        ds = cls(spark, path)
        data = volumes.read_tiff_stack(spark, source)
        ds.write_layer(layer, category, data, Box.of(0, volumes.stack_shape(spark, source)), dtype=dtype)
        return ds
