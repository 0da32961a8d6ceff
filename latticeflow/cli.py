"""Command line: python -m latticeflow.cli COMMAND ..."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .api import Dataset
from .functions.geometry import Box, Vec, mag
from .sources import arrays, volumes


def _vec(text: str) -> tuple:
    return tuple(Vec.parse(text))


def _box(text: str) -> Box:
    n = [int(v) for v in text.split(",")]
    return Box.of(n[:3], n[3:])


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="latticeflow")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *positional: str, **options):
        c = sub.add_parser(name)
        for x in positional:
            c.add_argument(x)
        for k, kw in options.items():
            c.add_argument("--" + k.replace("_", "-"), **kw)

    layer = {"layer_name": {"default": None}}
    down = {"coarsest_mag": {"default": None}, "sampling_mode": {"default": "anisotropic", "choices": ["anisotropic", "isotropic", "constant_z"]}}
    target = {"data_format": {"default": None}, "chunk_shape": {"type": _vec, "default": None}, "shard_shape": {"type": _vec, "default": None}}
    add("check-equality", "source", "target", **layer)
    add("compress", "target", **layer)
    add("convert", "source", "target", category={"default": "color"}, dtype={"default": "uint8"}, downsample={"action": "store_true"}, layer_name={"default": "color"})
    add("convert-cubes", "source", "target", dtype={"default": "uint8"}, layer_name={"default": "color"})
    add("convert-raw", "source", "target", shape={"type": _vec, "required": True}, dtype={"default": "uint8"}, order={"default": "F"}, flip_axes={"default": ""}, layer_name={"default": "color"})
    add("convert-zarr", "source", "target", category={"default": "color"}, dtype={"default": "uint32"}, layer_name={"default": "color"})
    add("copy-dataset", "source", "target", **target)
    add("downsample", "target", **layer, **down)
    add("upsample", "target", from_mag={"required": True}, **layer, sampling_mode=down["sampling_mode"])
    add("export-as-tiff", "source", "target", layer_name={"default": "color"}, mag={"default": "1"}, bbox={"type": _box, "default": None}, tile={"type": _vec, "default": None})
    add("merge-fallback", "target", "source", "volume", "fallback")
    return p


def run(spark: SparkSession, argv: list[str]) -> int:
    a = parser().parse_args(argv)
    if a.command == "check-equality":
        x, y = Dataset.open(spark, a.source), Dataset.open(spark, a.target)
        if a.layer_name:
            x.layers, y.layers = ({a.layer_name: d.layers[a.layer_name]} for d in (x, y))
        return int(not x.is_equal(y))
    if a.command == "convert":
        ds = Dataset.from_images(spark, a.source, a.target, a.layer_name, a.category, a.dtype)
        if a.downsample:
            ds.downsample()
    elif a.command == "convert-cubes":
        found = volumes.cube_list(spark, a.source).agg({"x": "max", "y": "max", "z": "max"}).first()
        high = [(found[f"max({c})"] + 1) * volumes.CUBE for c in "xyz"]
        Dataset(spark, a.target).write_layer(a.layer_name, "color", volumes.read_cubes(spark, a.source, a.dtype), Box.of(0, high), dtype=a.dtype)
    elif a.command == "convert-raw":
        Dataset.from_raw(spark, a.source, a.target, a.shape, a.dtype, a.layer_name, order=a.order, flip=a.flip_axes)
    elif a.command == "convert-zarr":
        data = arrays.read_array(spark, a.source)
        Dataset(spark, a.target).write_layer(a.layer_name, a.category, data, arrays.array_box(a.source), dtype=a.dtype)
    elif a.command == "copy-dataset":
        Dataset.open(spark, a.source).copy(a.target, a.data_format, a.chunk_shape, a.shard_shape)
    elif a.command == "merge-fallback":
        ds, src = Dataset(spark, a.target), Dataset.open(spark, a.source)
        ds.merge_fallback(src.layers[a.volume], src.layers[a.fallback], a.fallback)
    elif a.command == "export-as-tiff":
        m = Dataset.open(spark, a.source).layers[a.layer_name].mags[a.mag]
        size = m.box.in_mag(m.mag).high
        volumes.write_tiff_slices(m.read(a.bbox), a.target, (size.x, size.y), m.layer.dtype, a.tile and a.tile[:2])
    else:
        ds = Dataset.open(spark, a.target)
        chosen = [ds.layers[a.layer_name]] if a.layer_name else list(ds.layers.values())
        for x in chosen:
            if a.command == "downsample":
                x.downsample(a.coarsest_mag, sampling=a.sampling_mode)
            elif a.command == "upsample":
                x.upsample(mag(a.from_mag), sampling=a.sampling_mode)
            else:
                for m in list(x.mags.values()):
                    m._store(m.table())
    return 0


if __name__ == "__main__":
    sys.exit(run(SparkSession.builder.appName("latticeflow").getOrCreate(), sys.argv[1:]))
