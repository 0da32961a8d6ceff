"""Skeletons and agglomerates: joins on space, components and recursion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import AXES
from ..plans.tables import numbered, written


def with_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (tree, source, target) with the positions of both ends as ax .. bz."""
    a = nodes.select("tree", F.col("node").alias("source"), *[F.col(c).alias(f"a{c}") for c in AXES])
    b = nodes.select("tree", F.col("node").alias("target"), *[F.col(c).alias(f"b{c}") for c in AXES])
    return edges.join(a, ["tree", "source"]).join(b, ["tree", "target"])


def _distance(a: str, b: str, scale=(1.0, 1.0, 1.0)):
    d = [(F.col(f"{a}{c}") - F.col(f"{b}{c}")).cast("double") * float(s) for c, s in zip(AXES, scale, strict=True)]
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


def path_lengths(nodes: DataFrame, edges: DataFrame, voxel_size=(1.0, 1.0, 1.0)) -> DataFrame:
    """Cable length of each tree that has an edge."""
    return with_ends(edges, nodes).groupBy("tree").agg(F.sum(_distance("a", "b", voxel_size)).alias("length"))


def tree_stats(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("n_nodes"), F.max("node").alias("max_node"))


def degrees(edges: DataFrame) -> DataFrame:
    """Edges at each node, counted with both ends."""
    ends = edges.select("tree", F.explode(F.array("source", "target")).alias("node"))
    return ends.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("degree"))


def pairs_within(nodes: DataFrame, distance: float, scale=(1.0, 1.0, 1.0)) -> DataFrame:
    """Pairs of nodes of different trees (tree_a < tree_b) at most distance apart.

    Nodes meet in grid buckets of that width: one side is copied to the
    neighbouring buckets, so the join is an equi-join on the bucket."""
    cell = [F.floor(F.col(c) * float(s) / float(distance)) for c, s in zip(AXES, scale, strict=True)]
    sides = {}
    for side in "ab":
        sides[side] = nodes.select(
            F.col("tree").alias(f"tree_{side}"), F.col("node").alias(f"node_{side}"), *[F.col(c).alias(f"{side}{c}") for c in AXES], *[v.alias(f"k{c}") for v, c in zip(cell, AXES, strict=True)]
        )
    # A cell and half of its neighbours: every unordered pair of cells meets once.
    half = [(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1) if (x, y, z) >= (0, 0, 0)]
    steps = F.array(*[F.struct(*[F.lit(v).cast("long").alias(c) for v, c in zip(o, AXES, strict=True)]) for o in half])
    near = sides["b"].withColumn("_d", F.explode(steps))
    near = near.select(*[c for c in near.columns if c[0] != "k" and c != "_d"], *[(F.col(f"k{c}") + F.col(f"_d.{c}")).alias(f"k{c}") for c in AXES], ((F.col("_d.x") == 0) & (F.col("_d.y") == 0) & (F.col("_d.z") == 0)).alias("_own"))
    met = sides["a"].join(near, ["kx", "ky", "kz"]).where(
        F.when(F.col("_own"), F.col("tree_a") < F.col("tree_b")).otherwise(F.col("tree_a") != F.col("tree_b")) & (_distance("a", "b", scale) <= distance)
    )
    turned = F.col("tree_a") > F.col("tree_b")
    names = [("tree_a", "tree_b"), ("node_a", "node_b"), *[(f"a{c}", f"b{c}") for c in AXES]]
    one = [F.when(turned, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in names]
    two = [F.when(turned, F.col(a)).otherwise(F.col(b)).alias(b) for a, b in names]
    return met.select(*one, *two, _distance("a", "b", scale).alias("distance"))


def midpoints(pairs: DataFrame) -> DataFrame:
    """Half way between the ends, rounded half to even."""
    mid = [F.bround((F.col(f"a{c}") + F.col(f"b{c}")) / 2, 0).cast("long").alias(c) for c in AXES]
    return pairs.select("tree_a", "node_a", "tree_b", "node_b", *mid)


def closest_pairs(pairs: DataFrame) -> DataFrame:
    """The closest pair of nodes for each pair of trees; ties go to the smallest node ids."""
    best = F.min(F.struct("distance", "node_a", "node_b"))
    return pairs.groupBy("tree_a", "tree_b").agg(best.alias("m")).select("tree_a", "tree_b", "m.distance", "m.node_a", "m.node_b")


def components(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """(node, component): the smallest node that can be reached. Large-star and
    small-star steps; every round is written, and only a count and a checksum
    reach the driver."""
    now = written(
        edges.where(F.col(source) != F.col(target)).select(F.greatest(source, target).alias("u"), F.least(source, target).alias("v")).distinct(), "edges"
    )
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if not state["n"] or state == seen:
            break
        seen = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "edges")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def import_graphs(nodes: DataFrame, edges: DataFrame, first: int = 1, radius: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Graphs by name (nodes: tree, node, x, y, z and maybe radius; edges: tree,
    source, target) under ids of one numbering from first, in the order of tree
    and node; other attributes of edges are left out."""
    held = nodes if "radius" in nodes.columns else nodes.withColumn("radius", F.lit(None).cast("double"))
    made = numbered(held.withColumn("radius", F.coalesce("radius", F.lit(radius))), ["tree", "node"], "id", first=first)
    end = lambda c: made.select("tree", F.col("node").alias(c), F.col("id").alias(f"{c}_id"))
    links = edges.select("tree", "source", "target").join(end("source"), ["tree", "source"]).join(end("target"), ["tree", "target"])
    return made.select("tree", "id", "node", "x", "y", "z", "radius"), links.select("tree", F.col("source_id").alias("source"), F.col("target_id").alias("target"))


def agglomerates(segments: DataFrame, edges: DataFrame) -> DataFrame:
    """(segment, agglomerate, position): components numbered from 1 in the order
    of their smallest segment; position counts the members of one from 0."""
    found = components(edges)
    all_ = segments.select("segment").join(found.withColumnRenamed("node", "segment"), "segment", "left")
    all_ = all_.select("segment", F.coalesce("component", "segment").alias("root"))
    ids = numbered(all_.select("root").distinct(), ["root"], "agglomerate")
    placed = numbered(all_.join(ids, "root").select("segment", "agglomerate"), ["agglomerate", "segment"], "index", first=0)
    starts = placed.groupBy("agglomerate").agg(F.min("index").alias("start"))
    return placed.join(starts, "agglomerate").select("segment", "agglomerate", (F.col("index") - F.col("start")).alias("position"))


def agglomerate_offsets(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(agglomerate, segment_offset, n_segments, edge_offset, n_edges): where each
    agglomerate begins in the flat member and edge lists."""
    sizes = members.groupBy("agglomerate").agg(F.count(F.lit(1)).alias("n_segments"))
    of_edge = edges.join(members.select(F.col("segment").alias("source"), "agglomerate"), "source").groupBy("agglomerate").agg(F.count(F.lit(1)).alias("n_edges"))
    both = sizes.join(of_edge, "agglomerate", "left").na.fill(0, ["n_edges"])
    return _running(both, "agglomerate", {"n_segments": "segment_offset", "n_edges": "edge_offset"})


def _running(df: DataFrame, key: str, sums: dict[str, str]) -> DataFrame:
    """Exclusive running sums in the order of key, partition by partition."""
    from pyspark.sql import Window as W

    parts = written(df.repartitionByRange(key).withColumn("_part", F.spark_partition_id()), "running")
    totals = {r["_part"]: r for r in parts.groupBy("_part").agg(*[F.sum(c).alias(c) for c in sums]).collect()}
    rows, before = [], dict.fromkeys(sums, 0)
    for p in sorted(totals):
        rows.append((p, *before.values()))
        before = {c: before[c] + totals[p][c] for c in sums}
    schema = "_part int, " + ", ".join(f"_{c} long" for c in sums)
    starts = df.sparkSession.createDataFrame(rows, schema)
    within = W.partitionBy("_part").orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    out = parts.join(F.broadcast(starts), "_part")
    for c, name in sums.items():
        out = out.withColumn(name, F.col(f"_{c}") + F.coalesce(F.sum(c).over(within), F.lit(0)))
    return out.drop("_part", *[f"_{c}" for c in sums])


def representatives(nodes: DataFrame, seg: DataFrame) -> DataFrame:
    """(id, mapped): the segments under a tree's nodes go to the segment under its
    first node; a segment of several trees follows the smallest tree."""
    under = nodes.join(seg.select(*AXES, F.col("v").alias("segment")), list(AXES)).where("segment <> 0")
    first = under.groupBy("tree").agg(F.min_by("segment", "node").alias("mapped"))
    return under.join(first, "tree").groupBy(F.col("segment").alias("id")).agg(F.min_by("mapped", "tree").alias("mapped"))


def merge_trees(a: DataFrame, b: DataFrame) -> DataFrame:
    """Trees of b added to a (columns tree, name): ids that a has are renewed in
    order, beginning after the largest id; nodes keep theirs. Adds old_tree."""
    top = a.select("tree").unionByName(b.select("tree")).agg(F.max("tree")).first()[0] or 0
    clash = b.join(a.select("tree"), "tree", "left_semi")
    renewed = numbered(clash.withColumnRenamed("tree", "old_tree"), ["old_tree"], "tree", first=top + 1)
    kept = b.join(a.select("tree"), "tree", "left_anti")
    plain = lambda df: df.select("tree", "name", F.col("tree").alias("old_tree"))
    return plain(a).unionByName(plain(kept)).unionByName(renewed.select("tree", "name", "old_tree"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two node or edge tables has, with the side."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def flattened(groups: DataFrame) -> DataFrame:
    """(id, root, depth, path) of a tree of groups (id, parent, name); parents
    null at the top. Levels are joined until one is empty, so depth is not bound
    by a setting. Groups that no top reaches (a circle, a parent that isn't
    there) are a ValueError."""
    level = groups.where("parent is null").select("id", F.col("id").alias("root"), F.lit(0).alias("depth"), F.col("name").alias("path"))
    found = level
    while not level.isEmpty():
        above = level.select(F.col("id").alias("parent"), "root", "depth", "path")
        level = written(
            groups.join(above, "parent").select("id", "root", (F.col("depth") + 1).alias("depth"), F.concat_ws("/", "path", "name").alias("path")), "level"
        )
        found = found.unionByName(level)
    if found.count() < groups.count():
        raise ValueError("some groups have no way up to a top")
    return found


def subtree_sums(groups: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """For each group the sum of value over itself and all below it. Parents that
    go in a circle are a ValueError."""
    up = groups.select("id", "parent")
    now = values.groupBy("id").agg(F.sum(value).alias(value))
    found, most = now, groups.count()
    while not now.isEmpty():
        if most < 0:
            raise ValueError("parents go in a circle")
        most -= 1
        now = written(now.join(up, "id").where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.sum(value).alias(value)), "sums")
        found = found.unionByName(now)
    return found.groupBy("id").agg(F.sum(value).alias(value))


def spanning_links(pairs: DataFrame) -> DataFrame:
    """Minimum spanning links between trees (Boruvka) out of closest pairs
    (tree_a, tree_b, distance): each round every set takes its cheapest link,
    then sets are merged and what lies inside one is dropped."""
    links = written(pairs.select("tree_a", "tree_b", "distance", F.col("tree_a").alias("set_a"), F.col("tree_b").alias("set_b")), "links")
    chosen = links.select("tree_a", "tree_b", "distance").limit(0)
    while not links.isEmpty():
        ends = links.select("*", F.explode(F.array("set_a", "set_b")).alias("set"))
        best = ends.groupBy("set").agg(F.min(F.struct("distance", "tree_a", "tree_b", "set_a", "set_b")).alias("m"))
        best = written(best.select("m.*").distinct(), "chosen")
        chosen = chosen.unionByName(best.select("tree_a", "tree_b", "distance"))
        sets = written(components(best, "set_a", "set_b"), "sets")
        for c in ("set_a", "set_b"):
            links = links.join(sets.select(F.col("node").alias(c), F.col("component").alias("_to")), c, "left")
            links = links.withColumn(c, F.coalesce("_to", c)).drop("_to")
        links = written(links.where("set_a <> set_b"), "links")
    return chosen
