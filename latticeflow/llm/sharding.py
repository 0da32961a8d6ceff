"""K-d tree sharding by bytes.

Points are groups of equal texts; a node is split at the weighted median along
its widest metadata dimension until each leaf is one shard of about total /
shards bytes. Medians are found exactly by narrowing histograms: every round is
one map-side-combined aggregate for all nodes of a level, and the driver gets at
most BUCKETS rows a node.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Table

BUCKETS = 1024
#: A group of equal texts above this share of a shard's bytes is split into its documents.
SPLIT_SHARE = 0.05
#: A split that is off by more than this share of a shard is filled up from the next NEXT points.
UNEVEN, NEXT = 0.001, 64
#: Parts of a shard that number their rows independently.
SLOT_PARTS = 256
DIMS = ("size", "lang", "source")
MAX_SHARDS = 4096


@dataclass
class Node:
    first: int  # its first shard
    shards: int
    total: int = 0
    dim: int = 0


@dataclass
class Boundary:
    """Points up to (key, h) go left, the last only if inclusive; moved ones go left too."""

    key: int = 0
    h: int = 0
    inclusive: bool = False
    short: int = 0  # bytes that the left lacks without the last point
    over: int = 0  # and has too many with it
    moved: tuple[int, ...] = ()


@dataclass
class Search:
    """Where a node's median lies: values of key below lo are known to be left."""

    node: Node
    target: float
    lo: int
    hi: int
    below: int = 0
    first_key: int | None = None  # the median's first key, once known
    done: Boundary | None = None


def sized(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    crc = lambda c: F.crc32(F.coalesce(F.col(c).cast("string"), F.lit(""))).cast("long")
    return docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(text), 1).alias("h"),
        crc(lang_col).alias("lang"),
        crc(source_col).alias("source"),
    )


def _pick(values: list, node: Column, kind: str) -> Column:
    """The value for the row's node out of a list by node number."""
    return F.get(F.array(*[F.lit(v).cast(kind) for v in values]), node)


def _medians(points: DataFrame, nodes: list[Node], targets: list[float]) -> list[Boundary]:
    """The weighted median of each node along its dimension."""
    key = F.element_at(F.array(*DIMS), _pick([n.dim + 1 for n in nodes], F.col("node"), "int"))
    rows = points.withColumn("key", key)
    bounds = rows.groupBy("node").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    found = {r["node"]: Search(nodes[r["node"]], targets[r["node"]], r["lo"], r["hi"]) for r in bounds.collect()}
    while todo := {i: s for i, s in found.items() if s.done is None}:
        all_ = range(len(nodes))
        get = lambda f, kind: _pick([f(todo[i]) if i in todo else None for i in all_], F.col("node"), kind)
        second = get(lambda s: s.first_key, "long")
        value = F.when(second.isNull(), F.col("key")).otherwise(F.col("h"))
        lo, hi = get(lambda s: s.lo, "long"), get(lambda s: s.hi, "long")
        width = get(lambda s: (s.hi - s.lo) // BUCKETS + 1, "long")
        counted = (
            rows.withColumn("value", value)
            .where((second.isNull() | (F.col("key") == second)) & F.col("value").between(lo, hi))
            .groupBy("node", F.floor((F.col("value") - lo) / width).cast("int").alias("bucket"))
            .agg(F.sum("weight").alias("w"), F.min("value").alias("lo"), F.max("value").alias("hi"))
        )
        got: dict[int, list] = {}
        for r in sorted(counted.collect(), key=lambda r: (r["node"], r["bucket"])):
            got.setdefault(r["node"], []).append(r)
        for i, s in todo.items():
            for r in got[i]:
                if s.below + r["w"] >= s.target or r is got[i][-1]:
                    break
                s.below += r["w"]
            s.lo, s.hi = r["lo"], r["hi"]
            if s.lo < s.hi:
                continue
            if s.first_key is None:
                s.first_key, s.lo, s.hi = s.lo, 0, (1 << 63) - 1
            else:
                left_short, right_short = s.target - s.below, s.below + r["w"] - s.target
                s.done = Boundary(s.first_key, s.lo, right_short <= left_short, int(left_short), int(right_short))
    return [found[i].done if i in found else Boundary() for i in range(len(nodes))]


def _filled(points: DataFrame, dim: str, node: int, b: Boundary) -> Boundary:
    """A better boundary where one document is heavy for its node: it goes right,
    and of the next NEXT points in order those that still fit go left."""
    after = (F.col(dim) > b.key) | ((F.col(dim) == b.key) & (F.col("h") > b.h))
    rows = points.where((F.col("node") == node) & after).orderBy(dim, "h").limit(NEXT).select("h", "weight").collect()
    room, moved = b.short, []
    for r in sorted(rows, key=lambda r: (-r["weight"], r["h"])):
        if r["weight"] <= room:
            room -= r["weight"]
            moved.append(r["h"])
    return Boundary(b.key, b.h, False, room, b.over, tuple(moved)) if room < min(b.short, b.over) else b


def split_points(points: DataFrame, shards: int) -> DataFrame:
    """points (h, weight and DIMS) with shard 0 .. shards - 1."""
    nodes = [Node(0, shards)]
    points = points.withColumn("node", F.lit(0))
    while any(n.shards > 1 for n in nodes):
        spread = points.groupBy("node").agg(
            F.sum("weight").alias("total"),
            *[(F.max(d) - F.min(d)).alias(d) for d in DIMS],
        )
        extents = {r["node"]: r for r in spread.collect()}
        if len(nodes) == 1:
            whole = {d: max(1, (extents[0][d] if 0 in extents else 0) or 0) for d in DIMS}
        for i, n in enumerate(nodes):
            if i in extents:
                n.total = extents[i]["total"]
                n.dim = max(range(len(DIMS)), key=lambda k: (extents[i][DIMS[k]] / whole[DIMS[k]], -k))
        split = _medians(points, nodes, [n.total * ((n.shards + 1) // 2) / n.shards for n in nodes])
        for i, (n, b) in enumerate(zip(nodes, split, strict=True)):
            if n.shards > 1 and min(b.short, b.over) > UNEVEN * n.total / n.shards:
                split[i] = _filled(points, DIMS[n.dim], i, b)
        after: list[Node] = []
        left_of, right_of = [], []
        for n in nodes:
            half = (n.shards + 1) // 2
            left_of.append(len(after))
            after.append(Node(n.first, half))
            right_of.append(len(after) if n.shards > 1 else left_of[-1])
            if n.shards > 1:
                after.append(Node(n.first + half, n.shards - half))
        node = F.col("node")
        key = F.element_at(F.array(*DIMS), _pick([n.dim + 1 for n in nodes], node, "int"))
        b1, b2, incl = (_pick([getattr(b, k) for b in split], node, kind) for k, kind in (("key", "long"), ("h", "long"), ("inclusive", "boolean")))
        left = (key < b1) | ((key == b1) & ((F.col("h") < b2) | ((F.col("h") == b2) & incl)))
        for i, b in enumerate(split):
            if b.moved:
                left = left | ((node == i) & F.col("h").isin(*b.moved))
        # Written, since a plan that nests every level's choice grows without bound.
        points = Table(
            points.withColumn("node", F.when(left, _pick(left_of, node, "int")).otherwise(_pick(right_of, node, "int"))),
            "nodes",
        ).df
        nodes = after
    return points.withColumn("shard", _pick([n.first for n in nodes], F.col("node"), "int")).drop("node")


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (with shard) with slot: gapless from 0 in each shard. Each shard is
    numbered in SLOT_PARTS parts, so no task sees a whole shard."""
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(SLOT_PARTS)).cast("int"))
    counts = rows.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("shard").orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select("shard", "_part", F.coalesce(before, F.lit(0)).alias("_start"))
    within = F.row_number().over(W.partitionBy("shard", "_part").orderBy(*order)) - 1
    # At most shards x SLOT_PARTS rows are broadcast.
    return (
        rows.withColumn("_n", within)
        .join(F.broadcast(starts), ["shard", "_part"])
        .withColumn("slot", (F.col("_start") + F.col("_n")).cast("long"))
        .drop("_part", "_start", "_n")
    )


def kd_shards(
    docs: DataFrame,
    shards: int = 8,
    target_bytes: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """One row (id, size, text_crc32, shard, slot) per row of docs; shards hold
    nearly equal bytes. With target_bytes the number of shards follows from it.

    size: UTF-8 bytes of the text plus 1. Null texts and metadata count as empty.
    Equal texts share a shard unless together they exceed SPLIT_SHARE of a
    shard's bytes; then their documents are points of their own. Null and
    repeated ids are rows like any other (equal rows of a split group stay
    together). Extra columns are ignored; an empty table gives an empty result.
    """
    meta = Table(sized(docs, id_col, text_col, lang_col, source_col), "sizes").df
    total = meta.agg(F.sum("size")).first()[0] or 0
    if target_bytes:
        shards = max(1, -(-total // target_bytes))
    if not 1 <= shards <= MAX_SHARDS:
        raise ValueError(f"1 to {MAX_SHARDS} shards")
    groups = Table(
        meta.groupBy("h").agg(
            F.sum("size").alias("weight"), F.count(F.lit(1)).alias("n"), *[F.min(d).alias(d) for d in DIMS]
        ),
        "groups",
    ).df
    # At most shards / SPLIT_SHARE groups can be that heavy: 160 for 8 shards.
    heavy = groups.where((F.col("n") > 1) & (F.col("weight") > SPLIT_SHARE * total / shards)).select("h", F.lit(True).alias("heavy"))
    own = F.shiftrightunsigned(F.xxhash64("h", "id", "lang", "source"), 1)
    rows = meta.join(F.broadcast(heavy), "h", "left").withColumn("point", F.when(F.col("heavy"), own).otherwise(F.col("h")))
    light = groups.join(F.broadcast(heavy), "h", "left_anti").select("h", "weight", *DIMS)
    single = (
        rows.where("heavy").groupBy(F.col("point").alias("h")).agg(F.sum("size").alias("weight"), *[F.min(d).alias(d) for d in DIMS])
    )
    points = Table(light.unionByName(single), "points").df
    placed = split_points(points, shards).select(F.col("h").alias("point"), "shard")
    found = Table(rows.join(placed, "point").select("id", "size", "text_crc32", "shard"), "placed").df
    return numbered(found, ["id", "text_crc32", "size"])


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write docs (unique ids) as one Parquet folder per shard."""
    placed = assigned.select(F.col("id").alias(id_col), "shard", "slot")
    docs.join(placed, id_col).repartition("shard", F.floor(F.col("slot") / 100_000)).write.partitionBy("shard").parquet(path)
