"""Catalogue and administration queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def filter_datasets(
    df: DataFrame, name: tuple[str, str] | None = None, tags: Sequence[str] | None = None, folder: tuple[str, str] | None = None, match: str = "any"
) -> DataFrame:
    """Rows by (column, value) of name and folder and by overlap of their tags;
    match='all' asks for every tag."""
    for at in (name, folder):
        if at:
            df = df.where(F.col(at[0]) == at[1])
    if tags:
        wanted = F.array(*map(F.lit, tags))
        df = df.where(F.arrays_overlap("tags", wanted) if match == "any" else F.size(F.array_except(wanted, "tags")) == 0)
    return df


def page(df: DataFrame, order: Sequence[str], limit: int, number: int) -> DataFrame:
    """Page number (from 0) of limit rows in the order of columns."""
    return df.orderBy(*order).offset(limit * number).limit(limit)


def owned(df: DataFrame, owner: str, owners: DataFrame, key: str) -> DataFrame:
    return df.join(owners, F.col(owner) == F.col(key))


def per_month(df: DataFrame, user: str, at: str, value: str) -> DataFrame:
    return df.groupBy(user, F.year(at).cast("long").alias("year"), F.month(at).cast("long").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total")
    )


def mag_summary(mags: DataFrame) -> DataFrame:
    """Finest and coarsest magnification of each layer, ordered by the largest axis."""
    size = F.greatest("x", "y", "z")
    return mags.groupBy("layer").agg(F.min_by("x", size).alias("finest"), F.max_by("x", size).alias("coarsest"), F.countDistinct("x", "y", "z").alias("n"))


def asof(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """left with the last value of right at or before each row's time, by key.
    One shuffle by key and one sort; no row meets more than its neighbours."""
    names = left.columns
    pad = lambda df, cols: df.select(*[F.col(c) if c in df.columns else F.lit(None).alias(c) for c in cols])
    both = pad(left.withColumn("_side", F.lit(1)), [*names, value, "_side"]).unionByName(pad(right.withColumn("_side", F.lit(0)), [*names, value, "_side"]))
    before = W.partitionBy(key).orderBy(at, "_side").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(before)).where("_side = 1").drop("_side")
