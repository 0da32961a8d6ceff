"""Skeleton annotations: XML files to node, edge, tree and group tables, and back."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from itertools import chain
from xml.etree import ElementTree as ET
from xml.sax.saxutils import quoteattr

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import put, scan

_NODE = (
    "id:long,x:double,y:double,z:double,radius:double,rot_x:double,rot_y:double,rot_z:double,in_vp:int,in_mag:int,bit_depth:int,"
    "interpolation:boolean,time:long,comment:string,is_branchpoint:boolean,branchpoint_time:long"
)
ANNOTATION = (
    "file string, parameters map<string,map<string,string>>, meta map<string,string>, "
    "trees array<struct<id:long,group_id:long,name:string,color:array<double>,is_visible:boolean,"
    f"nodes:array<struct<{_NODE}>>,edges:array<struct<source:long,target:long>>>>, "
    "groups array<struct<id:long,parent:long,name:string>>, volumes array<map<string,string>>, "
    "segments array<struct<volume:long,id:long,name:string,x:long,y:long,z:long>>"
)


def _number(e: ET.Element, name: str, kind=float, default=None):
    v = e.get(name)
    return default if v in (None, "") else kind(float(v)) if kind is int else kind(v)


#: Fields of a node, the attributes that hold them and their kinds; the others come from comments and branchpoints.
_ATTRIBUTES = (
    ("id", "id", int), ("x", "x", float), ("y", "y", float), ("z", "z", float), ("radius", "radius", float), ("rot_x", "rotX", float), ("rot_y", "rotY", float),
    ("rot_z", "rotZ", float), ("in_vp", "inVp", int), ("in_mag", "inMag", int), ("bit_depth", "bitDepth", int), ("interpolation", "interpolation", bool), ("time", "time", int),
)


def _column(found: list[dict], name: str, kind: type) -> list:
    """An attribute of all elements, null where it is missing or empty."""
    texts = [a.get(name) for a in found]
    if name == "id":
        return list(map(int, texts))
    if kind is bool:
        return [None if v is None else v.lower() == "true" for v in texts]
    if kind is int:
        return [None if v is None or v == "" else int(float(v)) for v in texts]
    return [None if v is None or v == "" else float(v) for v in texts]


def _nested(parts: list[list[dict]], fields: dict[str, list], of: pa.DataType) -> pa.Array:
    """A list of structs for each part, out of columns over all of them."""
    values = pa.StructArray.from_arrays([pa.array(fields[f.name], f.type) for f in of.value_type], fields=list(of.value_type))
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, type=of)


def _trees(root: ET.Element, of: pa.DataType) -> pa.Array:
    """The trees of one file as one value; comments and branchpoints join their nodes."""
    comments = {int(c.get("node")): c.get("content") for c in root.iterfind("comments/comment")}
    branches = {int(b.get("id")): _number(b, "time", int) for b in root.iterfind("branchpoints/branchpoint")}
    things = root.findall("thing")
    nodes = [[n.attrib for n in t.iterfind("nodes/node")] for t in things]
    edges = [[e.attrib for e in t.iterfind("edges/edge")] for t in things]
    every, links = list(chain.from_iterable(nodes)), list(chain.from_iterable(edges))
    held = {field: _column(every, name, kind) for field, name, kind in _ATTRIBUTES}
    held["comment"] = list(map(comments.get, held["id"])) if comments else [None] * len(every)
    held["is_branchpoint"] = [i in branches for i in held["id"]]
    held["branchpoint_time"] = list(map(branches.get, held["id"])) if branches else [None] * len(every)
    colors = [[_number(t, f"color.{c}") for c in "rgba"] for t in things]
    kinds = {f.name: f.type for f in of.value_type}
    fields = {
        "id": [int(t.get("id")) for t in things],
        "group_id": [_number(t, "groupId", int) for t in things],
        "name": [t.get("name") for t in things],
        "color": [None if c[0] is None else [1.0 if v is None else v for v in c] for c in colors],
        "is_visible": [(t.get("isVisible") or "true").lower() == "true" for t in things],
    }
    columns = {n: pa.array(v, kinds[n]) for n, v in fields.items()}
    columns["nodes"] = _nested(nodes, held, kinds["nodes"])
    columns["edges"] = _nested(edges, {n: [int(e[n]) for e in links] for n in ("source", "target")}, kinds["edges"])
    values = pa.StructArray.from_arrays([columns[f.name] for f in of.value_type], fields=list(of.value_type))
    return pa.ListArray.from_arrays(pa.array([0, len(things)], pa.int32()), values, type=of)


def _others(root: ET.Element) -> dict:
    """One file without its trees: groups get parents."""
    groups: list[dict] = []
    todo = [(g, None) for g in root.iterfind("groups/group")]
    while todo:
        g, parent = todo.pop(0)
        groups.append({"id": int(g.get("id")), "parent": parent, "name": g.get("name")})
        todo += [(c, int(g.get("id"))) for c in g.iterfind("group")]
    segments = []
    for v in root.iterfind("volume"):
        for s in v.iterfind("segments/segment"):
            at = {a.lower(): _number(s, f"anchorPosition{a}", int) for a in "XYZ"}
            segments.append({"volume": _number(v, "id", int, 0), "id": int(s.get("id")), "name": s.get("name")} | at)
    return {
        "parameters": {p.tag: dict(p.attrib) for p in root.iterfind("parameters/*")},
        "meta": {m.get("name"): m.get("content") for m in root.iterfind("meta")},
        "groups": groups,
        "volumes": [dict(v.attrib) for v in root.iterfind("volume")],
        "segments": segments,
    }


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per .nml file, also inside .zip files; one file is in memory at a time."""
    schema = spark.createDataFrame([], ANNOTATION).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                name, data = b.column(0)[k].as_py(), b.column(1)[k].as_py()
                found = {name: data} if name.endswith(".nml") else {}
                if name.endswith(".zip"):
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        found = {f"{name}/{n}": z.read(n) for n in z.namelist() if n.endswith(".nml")}
                for f, text in found.items():
                    root = ET.fromstring(text)
                    row = {"file": f} | _others(root)
                    row["meta"] = list(row["meta"].items())
                    row["parameters"] = [(p, list(a.items())) for p, a in row["parameters"].items()]
                    row["volumes"] = [list(v.items()) for v in row["volumes"]]
                    yield pa.RecordBatch.from_arrays([_trees(root, c.type) if c.name == "trees" else pa.array([row[c.name]], c.type) for c in arrow], schema=arrow)

    return scan(spark, path, "*.{nml,zip}").mapInArrow(run, schema)


def tables(annotations: DataFrame) -> dict[str, DataFrame]:
    """trees, nodes, edges, groups and segments, each with its file."""
    t = annotations.select("file", F.explode("trees").alias("t"))
    flat = lambda c: annotations.select("file", F.inline(c))
    return {
        "trees": t.select("file", "t.id", "t.group_id", "t.name", "t.color", "t.is_visible"),
        "nodes": t.select("file", F.col("t.id").alias("tree"), F.inline("t.nodes")),
        "edges": t.select("file", F.col("t.id").alias("tree"), F.inline("t.edges")),
        "groups": flat("groups"),
        "segments": flat("segments"),
    }


def _tag(element: str, /, **attrs) -> str:
    said = "".join(f" {k.replace('__', '.')}={quoteattr(_text(v))}" for k, v in attrs.items() if v is not None)
    return f"<{element}{said}"


def _text(v) -> str:
    return str(v).lower() if isinstance(v, bool) else str(v)


#: What a tree says of itself, and the fields of a node in the order of its attributes.
_HEAD = ["id", "group_id", "name", "color", "is_visible"]
_WRITTEN = (
    ("id", "id"), ("radius", "radius"), ("x", "x"), ("y", "y"), ("z", "z"), ("rot_x", "rotX"), ("rot_y", "rotY"), ("rot_z", "rotZ"), ("in_vp", "inVp"), ("in_mag", "inMag"),
    ("bit_depth", "bitDepth"), ("interpolation", "interpolation"), ("time", "time"),
)


def _lines(values: pa.StructArray, element: str, names: tuple[tuple[str, str], ...]) -> list[str]:
    """One tag for each struct, with the attributes that it has; columns of nulls cost nothing."""
    form, columns = f"<{element}", []
    for name, attribute in names:
        column = values.field(name)
        if column.null_count == len(column):
            continue
        found = column.to_pylist()
        if pa.types.is_boolean(column.type):
            found = [None if v is None else _text(v) for v in found]
        form += f' {attribute}="%s"' if not column.null_count else "%s"
        columns.append(found if not column.null_count else ["" if v is None else f' {attribute}="{v}"' for v in found])
    form += " />"
    return [form % row for row in zip(*columns, strict=True)] if columns else [form] * len(values)


def _sorted(values: pa.StructArray, sizes: np.ndarray, *names: str) -> pa.StructArray:
    """The structs of each list in order of names; sizes are the lists'."""
    values = pa.StructArray.from_arrays(values.flatten(), fields=list(values.type))  # without an offset
    part = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort([*(values.field(n).to_numpy(zero_copy_only=False) for n in names[::-1]), part])
    return values if (order == np.arange(len(order))).all() else values.take(pa.array(order))


def serialise(annotation: pa.RecordBatch) -> str:
    """The XML of one annotation, a batch of one row as read() gives it; trees by
    id, nodes by id. Nodes and edges are worked on as columns, none becomes a dict."""
    at = annotation.schema.get_field_index("trees")
    trees = annotation.column(at).flatten()
    trees = _sorted(trees, np.array([len(trees)]), "id")
    annotation = annotation.drop_columns(["trees"]).to_pylist()[0]
    heads = pa.StructArray.from_arrays([trees.field(n) for n in _HEAD], _HEAD).to_pylist()
    sizes = {n: trees.field(n).value_lengths().fill_null(0).to_numpy() for n in ("nodes", "edges")}
    nodes = _sorted(trees.field("nodes").flatten(), sizes["nodes"], "id")
    edges = _sorted(trees.field("edges").flatten(), sizes["edges"], "source", "target")
    points, links = _lines(nodes, "node", _WRITTEN), _lines(edges, "edge", (("source", "source"), ("target", "target")))
    out = ["<?xml version='1.0' encoding='utf-8'?>", "<things>"]
    out += [_tag("meta", name=k, content=v) + " />" for k, v in dict(annotation.get("meta") or {}).items()]
    out.append("<parameters>")
    out += [_tag(p, **dict(a)) + " />" for p, a in dict(annotation.get("parameters") or {}).items()]
    out.append("</parameters>")
    ends = {n: np.cumsum([0, *s]).tolist() for n, s in sizes.items()}
    for k, t in enumerate(heads):
        color = dict(zip(("color__r", "color__g", "color__b", "color__a"), t["color"] or [], strict=False))
        out.append(_tag("thing", id=t["id"], **color, name=t["name"], groupId=t["group_id"], isVisible=t["is_visible"]) + "><nodes>")
        out += points[ends["nodes"][k] : ends["nodes"][k + 1]]
        out.append("</nodes><edges>")
        out += links[ends["edges"][k] : ends["edges"][k + 1]]
        out.append("</edges></thing>")
    noted = nodes.filter(nodes.field("comment").is_valid())
    comments = [_tag("comment", node=i, content=c) + " />" for i, c in zip(noted.field("id").to_pylist(), noted.field("comment").to_pylist(), strict=True)]
    forks = nodes.filter(nodes.field("is_branchpoint").fill_null(False))
    branches = [_tag("branchpoint", id=i, time=v) + " />" for i, v in zip(forks.field("id").to_pylist(), forks.field("branchpoint_time").to_pylist(), strict=True)]
    out += ["<branchpoints>", *branches, "</branchpoints>", "<comments>", *comments, "</comments>", "<groups>"]
    below: dict = {}
    for g in annotation.get("groups") or []:
        below.setdefault(g["parent"], []).append(g)

    def nest(parent) -> None:
        for g in below.get(parent, []):
            out.append(_tag("group", id=g["id"], name=g["name"]) + ">")
            nest(g["id"])
            out.append("</group>")

    nest(None)
    out.append("</groups>")
    for v in annotation.get("volumes") or []:
        v = dict(v)
        out.append(_tag("volume", **v) + "><segments>")
        mine = [s for s in annotation.get("segments") or [] if str(s["volume"]) == v.get("id", "0")]
        out += [_tag("segment", id=s["id"], name=s["name"], anchorPositionX=s["x"], anchorPositionY=s["y"], anchorPositionZ=s["z"]) + " />" for s in mine]
        out.append("</segments></volume>")
    out.append("</things>")
    return "\n".join(out)


def assemble(nodes: DataFrame, edges: DataFrame, trees: DataFrame | None = None, name: str = "annotation") -> DataFrame:
    """Annotation rows out of node (tree, id, x, y, z, ...) and edge tables with a
    file column; one row, and so one XML file, for each file value."""
    spark = nodes.sparkSession
    want = spark.createDataFrame([], ANNOTATION).schema
    node = want["trees"].dataType.elementType["nodes"].dataType.elementType
    if "file" not in nodes.columns:
        nodes, edges = nodes.withColumn("file", F.lit(name)), edges.withColumn("file", F.lit(name))
    cols = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in nodes.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in node.fields]
    by = nodes.groupBy("file", "tree").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("nodes"))
    ends = edges.groupBy("file", "tree").agg(F.sort_array(F.collect_list(F.struct(F.col("source").cast("long").alias("source"), F.col("target").cast("long").alias("target")))).alias("edges"))
    both = by.join(ends, ["file", "tree"], "left")
    if trees is not None:
        both = both.join(trees.select(F.col("id").alias("tree"), "group_id", "name", "color", "is_visible"), "tree", "left")
    else:
        both = both.select("*", *[F.lit(v).cast(t).alias(c) for c, t, v in (("group_id", "long", None), ("name", "string", ""), ("color", "array<double>", None), ("is_visible", "boolean", True))])
    tree = F.struct(F.col("tree").cast("long").alias("id"), "group_id", "name", "color", "is_visible", "nodes", F.coalesce("edges", F.array().cast(want["trees"].dataType.elementType["edges"].dataType)).alias("edges"))
    rows = both.groupBy("file").agg(F.sort_array(F.collect_list(tree)).alias("trees"))
    return rows.select(*[F.col(f.name).cast(f.dataType) if f.name in ("file", "trees") else F.lit(None).cast(f.dataType).alias(f.name) for f in want.fields])


def write(annotations: DataFrame, path: str) -> int:
    """One .nml per row, named by its file; returns how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for b in batches:
            at = b.schema.get_field_index("file")
            for k in range(b.num_rows):  # one file at a time
                name = b.column(at)[k].as_py().rpartition("/")[2].removesuffix(".nml")
                put(f"{path}/{name}.nml", serialise(b.slice(k, 1)).encode())
                n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return sum(r["n"] for r in annotations.mapInArrow(run, "n long").collect())
