"""Agglomerate graphs: the binary message, and arrays in flat (CSR) form."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAPH = "segments array<long>, edges array<struct<source:long,target:long,affinity:double>>, positions array<struct<x:int,y:int,z:int>>"


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int, object]]:
    """(number, wire type, value) of a protobuf message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        elif kind == 5:
            value, at = data[at : at + 4], at + 4
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        else:
            raise ValueError("a damaged message")
        yield key >> 3, kind, value


def _signed(v: int, bits: int = 64) -> int:
    v &= (1 << bits) - 1
    return v - (1 << bits) if v >> (bits - 1) else v


def _integers(kind: int, value) -> list[int]:
    if kind == 0:
        return [_signed(value)]
    out, at = [], 0
    while at < len(value):
        v, at = _varint(value, at)
        out.append(_signed(v))
    return out


def parse(data: bytes) -> dict:
    """segments = 1, edges = 2 {source = 1, target = 2}, positions = 3 {x, y, z},
    affinities = 4; edges without an affinity have 0."""
    segments, edges, positions, affinities = [], [], [], []
    for number, kind, value in fields(data):
        if number == 1:
            segments += _integers(kind, value)
        elif number == 2:
            at = {n: _signed(v) for n, _, v in fields(value)}
            edges.append((at.get(1, 0), at.get(2, 0)))
        elif number == 3:
            at = {n: _signed(v) for n, _, v in fields(value)}
            positions.append({"x": at.get(1, 0), "y": at.get(2, 0), "z": at.get(3, 0)})
        elif number == 4:
            affinities += [struct.unpack("<f", value)[0]] if kind == 5 else np.frombuffer(value, "<f4").tolist()
    affinities += [0.0] * (len(edges) - len(affinities))
    return {"segments": segments, "edges": [{"source": a, "target": b, "affinity": f} for (a, b), f in zip(edges, affinities, strict=False)], "positions": positions}


def decode(df: DataFrame, column: str = "content") -> DataFrame:
    """df's messages as GRAPH rows."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = df.sparkSession.createDataFrame([], GRAPH).schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [parse(x) for x in b.column(0).to_pylist()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in arrow], schema=arrow)

    return df.select(column).mapInArrow(run, schema)


def flat_arrays(members: DataFrame, edges: DataFrame, offsets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments, edges) in flat form: each row has its place in the list. Edges
    name their ends by place within the agglomerate and are sorted by them."""
    from ..plans.tables import numbered

    base = members.join(offsets.select("agglomerate", "segment_offset", "edge_offset"), "agglomerate")
    flat = base.select((F.col("segment_offset") + F.col("position")).alias("index"), "segment", "agglomerate")
    at = lambda c: members.select(F.col("segment").alias(c), F.col("position").alias(f"{c}_at"), F.col("agglomerate").alias(f"{c}_in"))
    ends = edges.join(at("source"), "source").join(at("target"), "target")
    local = ends.select(F.col("source_in").alias("agglomerate"), F.least("source_at", "target_at").alias("a"), F.greatest("source_at", "target_at").alias("b"), F.coalesce("affinity", F.lit(0.0)).alias("affinity"))
    return flat, numbered(local, ["agglomerate", "a", "b"], "index", first=0)


def from_flat(flat: DataFrame, local: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The inverse of flat_arrays: (segment, agglomerate) and edges (agglomerate,
    source, target, affinity) by segment id."""
    first = flat.groupBy("agglomerate").agg(F.min("index").alias("first"))
    placed = flat.join(first, "agglomerate").select("agglomerate", "segment", (F.col("index") - F.col("first")).alias("at"))
    end = lambda c, n: placed.select("agglomerate", F.col("at").alias(c), F.col("segment").alias(n))
    edges = local.join(end("a", "source"), ["agglomerate", "a"]).join(end("b", "target"), ["agglomerate", "b"])
    return flat.select("segment", "agglomerate"), edges.select("agglomerate", "source", "target", "affinity")


#: Names of an attachment's arrays (fixed values).
ARRAYS = (
    "segment_to_agglomerate", "agglomerate_to_segments_offsets", "agglomerate_to_segments", "agglomerate_to_positions",
    "agglomerate_to_edges_offsets", "agglomerate_to_edges", "agglomerate_to_affinities",
)


def write_attachment(members: DataFrame, edges: DataFrame, path: str, positions: DataFrame | None = None, dtype: str = "uint32") -> None:
    """Agglomerates as a folder of arrays: members (segment, agglomerate, position)
    as graph.agglomerates gives, edges (source, target, affinity), positions
    (segment, x, y, z), 0 where unknown. Segments must be 1 to their count."""
    from ..operators.graph import agglomerate_offsets
    from .columns import write_column

    found = validate(members).first()
    if found["from_one"] is False or found["dense"] is False:
        raise ValueError("segments must be the whole numbers from 1 to their count")
    offsets = agglomerate_offsets(members, edges)
    flat, local = flat_arrays(members, edges, offsets)
    sizes = offsets.agg(F.count(F.lit(1)).alias("n"), F.sum("n_segments").alias("s"), F.sum("n_edges").alias("e")).first()
    n, segments, links = sizes["n"], sizes["s"] or 0, sizes["e"] or 0
    a = dict(zip(ARRAYS, (f"{path}/{x}" for x in ARRAYS), strict=True))
    write_column(members.select(F.col("segment").alias("index"), F.col("agglomerate").alias("value")), a[ARRAYS[0]], segments + 1, "uint64")
    write_column(flat.select("index", F.col("segment").alias("value")), a[ARRAYS[2]], segments, dtype)
    for name, start, total in ((ARRAYS[1], "segment_offset", segments), (ARRAYS[4], "edge_offset", links)):
        end = offsets.sparkSession.createDataFrame([(n + 1, total)], "index long, value long")
        write_column(offsets.select(F.col("agglomerate").alias("index"), F.col(start).alias("value")).unionByName(end), a[name], n + 2, "uint64")
    at = flat.select("index", "segment")
    placed = at.join(positions, "segment", "left") if positions is not None else at.withColumns(dict.fromkeys("xyz", F.lit(0)))
    write_column(placed.select("index", *[F.coalesce(c, F.lit(0)).cast("int").alias(c) for c in "xyz"]), a[ARRAYS[3]], segments, "int32", ("x", "y", "z"))
    write_column(local.select("index", "a", "b"), a[ARRAYS[5]], links, dtype, ("a", "b"))
    write_column(local.select("index", F.col("affinity").cast("float").alias("value")), a[ARRAYS[6]], links, "float32")


def read_attachment(spark, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(segment, agglomerate), edges (agglomerate, source, target, affinity) and
    positions (segment, x, y, z) of a folder of arrays."""
    from .columns import read_column

    get = lambda name, *columns: read_column(spark, f"{path}/{name}", columns or ("value",))
    of = get(ARRAYS[0]).where("index > 0").select(F.col("index").alias("segment"), F.col("value").alias("agglomerate"))
    listed = get(ARRAYS[2]).withColumnRenamed("value", "segment")
    flat = listed.join(of, "segment").select("index", "segment", "agglomerate")
    starts = get(ARRAYS[4]).withColumnRenamed("value", "start")
    ends = starts.select((F.col("index") - 1).alias("index"), F.col("start").alias("end"))
    owner = starts.join(ends, "index").where("index > 0 and start < end")
    owner = owner.select(F.col("index").alias("agglomerate"), F.explode(F.sequence("start", F.col("end") - 1)).alias("index"))
    local = get(ARRAYS[5], "a", "b").join(get(ARRAYS[6]).withColumnRenamed("value", "affinity"), "index").join(owner, "index")
    members, edges = from_flat(flat, local)
    where = get(ARRAYS[3], "x", "y", "z").join(listed, "index").select("segment", "x", "y", "z")
    return members, edges, where


def validate(segments: DataFrame) -> DataFrame:
    """One row: whether ids are the whole numbers from 1 to their count."""
    return segments.agg((F.min("segment") == 1).alias("from_one"), (F.countDistinct("segment") == F.max("segment")).alias("dense"))
