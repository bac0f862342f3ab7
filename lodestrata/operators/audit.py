"""Constraint audits: the rows or keys that break a rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def repeated_keys(frame: DataFrame, keys: list[str]) -> DataFrame:
    return frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def several_defaults(assignments: DataFrame) -> DataFrame:
    """Departments with more than one default adapter."""
    return repeated_keys(assignments.where("is_default"), ["department_id"])


def wrong_dimensions(vectors: DataFrame, dimension: int) -> DataFrame:
    """Documents with a vector of another dimension: they fail as a whole."""
    return vectors.where((F.size("embedding") != dimension) | F.col("embedding").isNull()).select("doc_id").distinct()


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return children.join(parents.select(key), key, "left_anti")


def out_of_range(frame: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return frame.where(~F.col(column).between(low, high))
