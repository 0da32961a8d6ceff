"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors are rotated onto the principal axes; grid cells of width epsilon on
the leading axes give the order in which vectors of a label are sorted and cut
into blocks. Only blocks whose cells are neighbours meet, and a pair of blocks is
joined by halving both sequences again and again, skipping halves whose boxes
are provably further apart than epsilon. A cosine of c is a distance of
sqrt(2 - 2c) between unit vectors, and a rotation can only shorten a distance
when axes are left out, so nothing is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Table
from .components import components

THRESHOLD = 0.98
#: Leading axes that give the grid, and rows of a block.
GRID_AXES, BOX_AXES, BLOCK, LEAF = 3, 8, 512, 64
_SLACK = 1e-6


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a double matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _usable(vec_col: str, label_col: str) -> F.Column:
    """Never null: whether the row's vector can link."""
    vec = F.col(vec_col).cast("array<double>")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(vec, lambda x: F.coalesce(x != 0, F.lit(False)))
    return F.col(label_col).isNotNull() & F.coalesce(finite & some, F.lit(False))


def _valid(df: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(id, label, vec) of the rows that can link; -0.0 becomes 0.0."""
    vec = F.transform(F.col(vec_col).cast("array<double>"), lambda x: x + F.lit(0.0))
    return df.where(_usable(vec_col, label_col)).select(
        F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), vec.alias("vec")
    )


def principal_axes(classes: DataFrame, dims: int) -> np.ndarray:
    """Eigenvectors, largest first, of the second moments of the unit vectors;
    the driver gets one dims x dims matrix from each task's sums."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for b in batches:
            if b.num_rows:
                m = _unit(_matrix(b.column(0)))
                total += m.T @ m
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(dims), pa.int32()), "row": pa.array(total.tolist())})

    parts = classes.select("vec").mapInArrow(sums, "i int, row array<double>")
    summed = parts.select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"))
    moment = np.zeros((dims, dims))
    for r in summed.collect():
        moment[r["i"], r["j"]] = r["x"]
    _, axes = np.linalg.eigh(moment)
    return np.ascontiguousarray(axes[:, ::-1])


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)  # no over- or underflow in the squares
    return m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]


def _boxes_apart(a: np.ndarray, b: np.ndarray) -> float:
    gap = np.maximum(0, np.maximum(a.min(0) - b.max(0), b.min(0) - a.max(0)))
    return float(np.sqrt((gap * gap).sum()))


def join_sequences(
    va: np.ndarray, pa_: np.ndarray, vb: np.ndarray, pb: np.ndarray, threshold: float, eps: float, same: bool
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs with cosine >= threshold. v: unit vectors, p: their leading
    coordinates, both in grid order. same: a and b are one sequence, i < j."""
    todo = [(0, len(va), 0, len(vb))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if same and b1 <= a0:
            continue
        if _boxes_apart(pa_[a0:a1], pb[b0:b1]) > eps:
            continue
        if a1 - a0 <= LEAF and b1 - b0 <= LEAF:
            i, j = np.nonzero(va[a0:a1] @ vb[b0:b1].T >= threshold - 1e-9)
            i, j = i + a0, j + b0
            if same:
                keep = i < j
                i, j = i[keep], j[keep]
            # The verdict is taken on the pair's own dot product, summed the same way on any machine.
            sure = np.einsum("ij,ij->i", va[i], vb[j]) >= threshold
            if sure.any():
                yield i[sure], j[sure]
            continue
        ma, mb = (a0 + a1) // 2, (b0 + b1) // 2
        left = [(a0, ma), (ma, a1)] if a1 - a0 > LEAF else [(a0, a1)]
        right = [(b0, mb), (mb, b1)] if b1 - b0 > LEAF else [(b0, b1)]
        todo += [(*x, *y) for x in left for y in right]


class _Sets:
    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def join(self, a: int, b: int) -> bool:
        for x in (a, b):
            self.parent.setdefault(x, x)
        while self.parent[a] != a:
            self.parent[a] = self.parent[self.parent[a]]
            a = self.parent[a]
        while self.parent[b] != b:
            self.parent[b] = self.parent[self.parent[b]]
            b = self.parent[b]
        self.parent[a] = b
        return a != b


_FOUND = T.StructType(
    [
        T.StructField("u", T.LongType()),
        T.StructField("v", T.LongType()),
        T.StructField("n", T.LongType()),
    ]
)


def _join_blocks(dims: int, axes: np.ndarray, threshold: float, eps: float):
    """Rows: one pair of blocks. Out: spanning links (u, v, null) and, for each
    class with links here, (u, null, number of vectors linked)."""

    def unpack(ids, counts, vecs):
        v = np.frombuffer(vecs, np.float64).reshape(-1, dims)
        return np.frombuffer(ids, np.int64), np.frombuffer(counts, np.int64), v, v @ axes[:, :BOX_AXES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(i)[k].as_py() for i, n in enumerate(batch.schema.names)}
                same = row["a"] == row["b"]
                ia, na, va, pa_ = unpack(row["a_ids"], row["a_counts"], row["a_vecs"])
                ib, nb, vb, pb = (ia, na, va, pa_) if same else unpack(row["b_ids"], row["b_counts"], row["b_vecs"])
                links_a, links_b, sets, us, vs = np.zeros(len(ia), np.int64), np.zeros(len(ib), np.int64), _Sets(), [], []
                for i, j in join_sequences(va, pa_, vb, pb, threshold, eps, same):
                    np.add.at(links_a, i, nb[j])
                    np.add.at(links_b, j, na[i])
                    for x, y in zip(ia[i].tolist(), ib[j].tolist(), strict=True):
                        if sets.join(x, y):
                            us.append(x)
                            vs.append(y)
                linked = np.concatenate((np.flatnonzero(links_a), np.flatnonzero(links_b) + len(ia)))
                both_ids, both_n = np.concatenate((ia, ib)), np.concatenate((links_a, links_b))
                if len(linked):
                    yield pa.RecordBatch.from_pydict(
                        {
                            "u": pa.array(np.concatenate((np.array(us, np.int64), both_ids[linked]))),
                            "v": pa.array([*vs, *[None] * len(linked)], pa.int64()),
                            "n": pa.array([None] * len(us) + both_n[linked].tolist(), pa.int64()),
                        }
                    )

    return run


def _pack_blocks(dims: int, axes: np.ndarray, cell: float):
    """Sorted rows (label, id, n, vec) -> blocks of at most BLOCK rows of one
    label, with the distinct grid cells that they hold."""
    schema = (
        "block long, label string, cells array<array<int>>, ids binary, counts binary, vecs binary"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        serial = TaskContext.get().partitionId() << 40
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal serial, held
            label = held[0][0]
            vecs = _unit(np.array([h[3] for h in held], np.float64))
            cells = np.unique(np.floor((vecs @ axes[:, :GRID_AXES]) / cell).astype(np.int32), axis=0)
            out = pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([serial], pa.int64()),
                    "label": pa.array([label], pa.string()),
                    "cells": pa.array([cells.tolist()], pa.list_(pa.list_(pa.int32()))),
                    "ids": pa.array([np.array([h[1] for h in held], np.int64).tobytes()], pa.binary()),
                    "counts": pa.array([np.array([h[2] for h in held], np.int64).tobytes()], pa.binary()),
                    "vecs": pa.array([vecs.tobytes()], pa.binary()),
                }
            )
            serial += 1
            held = []
            return out

        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(3)]
            m = _matrix(batch.column(3)) if batch.num_rows else None
            for k in range(batch.num_rows):
                if held and (len(held) >= BLOCK or held[0][0] != cols[0][k]):
                    yield flush()
                held.append((cols[0][k], cols[1][k], cols[2][k], m[k]))
        if held:
            yield flush()

    return run, schema


def _links_of_width(classes: DataFrame, dims: int, threshold: float) -> DataFrame:
    """(u, v, n) as _join_blocks gives, for classes whose vectors have dims components."""
    axes = principal_axes(classes, dims)
    eps = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + _SLACK
    lead = axes[:, :GRID_AXES]

    @F.pandas_udf("array<int>")
    def cell_of(vec: pd.Series) -> pd.Series:
        if not len(vec):
            return pd.Series([], dtype=object)
        return pd.Series(np.floor(_unit(np.stack(vec.to_numpy())) @ lead / eps).astype(np.int32).tolist())

    pack, packed = _pack_blocks(dims, axes, eps)
    ordered = (
        classes.withColumn("cell", cell_of("vec"))
        .repartitionByRange("label", "cell", "id")
        .sortWithinPartitions("label", "cell", "id")
        .select("label", "id", "n", "vec")
    )
    blocks = Table(ordered.mapInArrow(pack, packed), "blocks").df
    held = blocks.select("block", "label", F.explode("cells").alias("cell"))
    steps = F.array(*[F.lit(x) for x in (-1, 0, 1)])
    near = held
    for k in range(GRID_AXES):
        near = near.withColumn(f"s{k}", F.explode(steps))
    moved = F.array(*[F.element_at("cell", k + 1) + F.col(f"s{k}") for k in range(min(GRID_AXES, dims))])
    near = near.select("label", moved.alias("cell"), F.col("block").alias("b"))
    pairs = (
        held.select("label", "cell", F.col("block").alias("a"))
        .join(near, ["label", "cell"])
        .where("a <= b")
        .select("a", "b")
        .distinct()
    )
    side = lambda x: blocks.select(F.col("block").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("ids", "counts", "vecs")])
    jobs = pairs.join(side("a"), "a").join(side("b"), "b")
    return jobs.mapInArrow(_join_blocks(dims, axes, threshold, eps), _FOUND)


def near_duplicates(
    df: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row (id, n_links, component) per row of df.

    Rows link when their labels are equal and not null and their cosine is at
    least threshold. Vectors that are null, empty, zero or hold a null, NaN or
    infinity, and vectors of different lengths, do not link. Equal vectors are
    one class with a count, so copies cost nothing; repeated ids are rows of
    their own; a null id counts as a vector but names no component unless alone.
    Extra columns are ignored; an empty table gives an empty result.
    """
    rows = Table(_valid(df, id_col, vec_col, label_col), "vectors").df
    classes = Table(
        rows.groupBy("label", "vec")
        .agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
        .select("label", "vec", "least", "n", F.size("vec").alias("size"), F.monotonically_increasing_id().alias("id")),
        "classes",
    ).df
    found = df.sparkSession.createDataFrame([], _FOUND)
    for width in [r["size"] for r in classes.select("size").distinct().collect()]:
        links = _links_of_width(classes.where(F.col("size") == width), width, threshold)
        found = found.unionByName(links)
    found = Table(found, "found").df
    counted = found.where("n is not null").groupBy(F.col("u").alias("id")).agg(F.sum("n").alias("others"))
    grouped = components(found.where("v is not null"), "u", "v").withColumnRenamed("node", "id")
    smallest = (
        grouped.join(classes.select("id", "least"), "id").groupBy("component").agg(F.min("least").alias("smallest"))
    )
    named = grouped.join(smallest, "component").select("id", "smallest")
    by_class = (
        classes.join(counted, "id", "left")
        .join(named, "id", "left")
        .select(
            "label",
            "vec",
            (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
            F.coalesce("smallest", "least").alias("component"),
        )
    )
    linked = rows.join(by_class, ["label", "vec"]).select("id", "n_links", "component")
    lone = df.where(~_usable(vec_col, label_col)).select(
        F.col(id_col).alias("id"), F.lit(0).cast("long").alias("n_links"), F.col(id_col).alias("component")
    )
    return linked.unionByName(lone)
