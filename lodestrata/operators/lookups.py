"""Point lookups: none or one row, one that must exist, and the active model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def find(frame: DataFrame, condition: Column) -> DataFrame:
    """The row that meets the condition on a key, or none."""
    return frame.where(condition).limit(1)


def must_find(frame: DataFrame, condition: Column, what: str) -> DataFrame:
    """The row that meets the condition on a key; a LookupError if there is none."""
    row = find(frame, condition)
    if row.isEmpty():
        raise LookupError(f"no such {what}")
    return row


def active_model(models: DataFrame) -> DataFrame:
    """One active model, the first by name if there are several; a LookupError without one."""
    row = models.where(F.col("is_active")).orderBy("name").limit(1)
    if row.isEmpty():
        raise LookupError("no active embedding model")
    return row
