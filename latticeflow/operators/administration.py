"""Users, teams, projects, tasks and annotations as tables with checked changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables and their key columns.
SCHEMAS = {
    "users": "id string, email string, first_name string, last_name string, is_admin boolean, teams array<string>",
    "teams": "id string, name string, organization string",
    "projects": "id string, name string, team string, owner string, priority int, paused boolean",
    "task_types": "id string, name string, description string, team string",
    "tasks": "id string, project string, task_type string, dataset string, pending int, active int, finished int",
    "annotations": "id string, task string, owner string, state string, dataset string, modified long",
    "folders": "id string, parent string, name string",
    "logged_times": "user string, at timestamp, seconds double",
}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


def inserted(table: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """table and rows; a key that exists already is an error when it is run."""
    seen = table.select(key, F.lit(True).alias("_there")).distinct()
    clash = F.raise_error(F.concat(F.lit("exists already: "), F.col(key).cast("string"))).cast("boolean")
    new = rows.join(seen, key, "left").where(F.when(F.col("_there"), clash).otherwise(True)).drop("_there")
    return table.unionByName(new.select(table.columns))


def updated(table: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """table with the columns of changes put in where the key fits."""
    names = [c for c in changes.columns if c != key]
    marked = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in names], F.lit(True).alias("_changed"))
    both = table.join(marked, key, "left")
    pick = lambda c: F.when(F.col("_changed"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c)
    return both.select(*[pick(c) for c in table.columns])


def deleted(table: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def resolved(table: DataFrame, column: str, other: DataFrame, key: str = "id", take: str = "name") -> DataFrame:
    """table with the name that a foreign key stands for; unknown keys give null."""
    return table.join(other.select(F.col(key).alias(column), F.col(take).alias(f"{column}_{take}")), column, "left")


def project_progress(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("project").agg(*[F.sum(c).alias(c) for c in ("pending", "active", "finished")])
