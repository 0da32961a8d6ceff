"""Connected components by alternating large-star and small-star steps.

Edges stay distributed; every round is written to the shared folder, so a lost
executor costs one round at most. The driver sees only a count and a checksum.
Before a round is written, the edges that lie together are contracted to stars,
which saves rounds: the steps only have to join what lies apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Table

#: Edges that one task contracts at a time.
BLOCK = 1 << 20


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node reachable by these edges) for all but the smallest ones."""
    nodes, spot = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = spot[: len(u)], spot[len(u) :]
    parent = np.arange(len(nodes))
    while True:
        x, y = parent[a], parent[b]
        if (x == y).all():
            break
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while (parent != (up := parent[parent])).any():
            parent = up
    low = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[low], nodes[parent[low]]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            u, v = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in range(2))
            kinds = held[0].schema.types
            yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(stars(u, v), kinds, strict=True)], names=["u", "v"])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= BLOCK:
            yield from flush()
            held.clear()
    yield from flush()


def _contract(edges: DataFrame) -> DataFrame:
    """The same components with fewer and shorter paths; types that numpy does not order as Spark does stay as they are."""
    if not isinstance(edges.schema["u"].dataType, T.IntegralType):
        return edges
    return edges.mapInArrow(_contracted, edges.schema)


def _state(df: DataFrame) -> tuple:
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
    ).first()
    return row["n"], row["h"]


def components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has
    an edge to another node. Nodes of any orderable type; null ends, self-loops
    and repeated edges are ignored; no edges give an empty result.
    """
    pairs = (
        edges.where(F.col(src) != F.col(dst))
        .select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .distinct()
    )
    now = Table(_contract(pairs), "edges")
    state = _state(now.df)
    while state[0]:
        e = now.df
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(least, "u")
            .where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.withColumnRenamed("m", "v")).distinct()
        after = Table(_contract(small), "edges")
        now.drop()
        now, before = after, state
        state = _state(now.df)
        if state == before:
            break
    e = now.df
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
