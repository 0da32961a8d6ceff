"""Dataset properties and image metadata as JSON, to and from tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import UNITS_NM
from .files import get, put

NAME = "datasource-properties.json"
LAYERS = "dataset string, layer string, category string, x0 long, y0 long, z0 long, x1 long, y1 long, z1 long, element_class string, data_format string, channels int, largest_segment_id long"
MAGS = "dataset string, layer string, x int, y int, z int, path string, cube_length int"


def read(path: str) -> dict:
    found = get(f"{path}/{NAME}")
    if found is None:
        raise FileNotFoundError(f"{path}/{NAME}")
    return json.loads(found)


def voxel_size_nm(properties: dict) -> tuple[float, float, float]:
    scale = properties["scale"]
    if isinstance(scale, dict):
        return tuple(f * UNITS_NM[scale.get("unit", "nanometer")] for f in scale["factor"])
    return tuple(map(float, scale))


def _mag(m) -> list[int]:
    m = m.get("mag", m.get("resolution")) if isinstance(m, dict) else m
    return [m] * 3 if isinstance(m, int) else list(m)


def catalogue(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """(layers, mags) of datasets; a dataset is a few lines of metadata."""
    layers, mags = [], []
    for path in paths:
        p = read(path)
        name = p.get("id", {}).get("name", path)
        for at in p["dataLayers"]:
            b = at["boundingBox"]
            low = b["topLeft"]
            high = [a + s for a, s in zip(low, (b["width"], b["height"], b["depth"]), strict=True)]
            layers.append(
                (name, at["name"], at["category"], *low, *high, at["elementClass"], at.get("dataFormat", "wkw"), at.get("numChannels") or 1, at.get("largestSegmentId"))
            )
            for m in at.get("mags") or at.get("wkwResolutions") or []:
                mags.append((name, at["name"], *_mag(m), m.get("path") if isinstance(m, dict) else None, m.get("cubeLength") if isinstance(m, dict) else None))
    return spark.createDataFrame(layers, LAYERS), spark.createDataFrame(mags, MAGS)


def properties(name: str, voxel_size, unit: str, layers: list[dict]) -> dict:
    return {"id": {"name": name, "team": ""}, "scale": {"factor": list(voxel_size), "unit": unit}, "dataLayers": layers, "version": 1}


def layer(name: str, category: str, box, element_class: str, data_format: str, mags: list[dict], largest: int | None = None) -> dict:
    size = box.size
    found = {
        "name": name,
        "category": category,
        "boundingBox": {"topLeft": list(box.low), "width": size.x, "height": size.y, "depth": size.z},
        "elementClass": element_class,
        "dataFormat": data_format,
        "mags": mags,
    }
    return found | ({"largestSegmentId": largest} if category == "segmentation" else {})


def write(path: str, found: dict) -> None:
    put(f"{path}/{NAME}", json.dumps(found, indent=2).encode())


def ome(mags: DataFrame, voxel_size, version: str = "0.5") -> DataFrame:
    """(dataset, layer, json): multiscale metadata; scale is voxel size times magnification, in nanometres."""
    size = [F.col(a).cast("double") * float(s) for a, s in zip("xyz", voxel_size, strict=True)]
    one = F.lit(1.0)
    level = F.struct(
        F.when((F.col("x") == F.col("y")) & (F.col("y") == F.col("z")), F.col("x").cast("string")).otherwise(F.concat_ws("-", "x", "y", "z")).alias("path"),
        F.array(F.struct(F.array(one, *size).alias("scale"), F.lit("scale").alias("type"))).alias("coordinateTransformations"),
    )
    ordered = F.transform(F.sort_array(F.collect_list(F.struct(F.greatest("x", "y", "z").alias("k"), level.alias("v")))), lambda s: s["v"])
    unit = lambda a: F.struct(F.lit(a).alias("name"), F.lit("space").alias("type"), F.lit("nanometer").alias("unit"))
    channel = F.struct(F.lit("c").alias("name"), F.lit("channel").alias("type"), F.lit(None).cast("string").alias("unit"))
    scales = F.struct(F.lit(version).alias("version"), F.array(channel, *map(unit, "xyz")).alias("axes"), ordered.alias("datasets"))
    body = F.to_json(F.struct(F.array(scales).alias("multiscales")))
    if version == "0.5":
        body = F.to_json(F.struct(F.lit(3).alias("zarr_format"), F.lit("group").alias("node_type"), F.struct(F.struct(F.array(scales).alias("multiscales")).alias("ome")).alias("attributes")))
    return mags.groupBy("dataset", "layer").agg(body.alias("json"))
