"""Lattices and graphs out of the driver's relational tables.

vox: parts x suppliers x line numbers with a quantity; seg: orders x line
numbers with a supplier as segment id; nodes and edges: the lines of an order as
a chain in that space.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str, flag: str | None = None) -> DataFrame:
    """What vox is made of: a row for each line. Of those at one place vox has the greatest."""
    lines = table(spark, sf_dir, "lineitem")
    if flag:
        lines = lines.where(F.col("l_returnflag") == flag)
    return lines.select(
        F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("y"), F.col("l_linenumber").cast("long").alias("z"), F.col("l_quantity").cast("long").alias("v")
    )


def vox(spark: SparkSession, sf_dir: str, flag: str | None = None) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    if flag:
        lines = lines.where(F.col("l_returnflag") == flag)
    return lines.groupBy(
        F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("y"), F.col("l_linenumber").cast("long").alias("z")
    ).agg(F.max("l_quantity").cast("long").alias("v"))


def seg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("x"), F.col("l_linenumber").cast("long").alias("y"))
        .agg(F.max("l_suppkey").alias("v"))
        .select("x", "y", F.lit(0).cast("long").alias("z"), "v")
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("tree"),
        F.row_number().over(order).cast("long").alias("node"),
        F.col("l_partkey").alias("x"),
        F.col("l_suppkey").alias("y"),
        F.col("l_linenumber").cast("long").alias("z"),
    )


def edges(nodes: DataFrame) -> DataFrame:
    """Consecutive nodes of each tree."""
    after = F.lead("node").over(W.partitionBy("tree").orderBy("node"))
    return nodes.select("tree", F.col("node").alias("source"), after.alias("target")).where("target is not null")


SQL = {
    "vox": "SELECT l_partkey AS x, l_suppkey AS y, l_linenumber::BIGINT AS z, max(l_quantity)::BIGINT AS v FROM lineitem GROUP BY 1, 2, 3",
    "vox_r": "SELECT l_partkey AS x, l_suppkey AS y, l_linenumber::BIGINT AS z, max(l_quantity)::BIGINT AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2, 3",
    "seg": "SELECT l_orderkey AS x, l_linenumber::BIGINT AS y, 0::BIGINT AS z, max(l_suppkey) AS v FROM lineitem GROUP BY 1, 2",
    "nodes": "SELECT l_orderkey AS tree, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)::BIGINT AS node, "
    "l_partkey AS x, l_suppkey AS y, l_linenumber::BIGINT AS z FROM lineitem",
    "edges": "SELECT tree, node AS source, lead(node) OVER (PARTITION BY tree ORDER BY node) AS target FROM nodes QUALIFY target IS NOT NULL",
    "boxes": "SELECT l_suppkey AS id, min(l_partkey) AS x0, min(l_suppkey) AS y0, min(l_linenumber)::BIGINT AS z0, "
    "max(l_partkey) + 1 AS x1, max(l_suppkey) + 1 AS y1, max(l_linenumber)::BIGINT + 1 AS z1 FROM lineitem GROUP BY 1",
}


def sql(*names: str, then: str) -> str:
    """A query over named lattices."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + " " + then
