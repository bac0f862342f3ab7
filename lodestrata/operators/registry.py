"""Models, adapters and accounts: upserts, single-active switches, bootstrap rows.

Parquet has no MERGE, so an upsert is a full outer join that yields the new table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], updated: list[str]) -> DataFrame:
    """The table after ``incoming``: on a conflict only ``updated`` columns change.

    Raises where the plan runs if ``incoming`` has a key more than once.
    """
    once = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("a key comes in more than once"))).otherwise(F.first(F.struct(*(c for c in incoming.columns if c not in keys))))
    incoming = incoming.groupBy(*keys).agg(once.alias("_row")).select(*keys, "_row.*")
    new = incoming.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in existing.columns if c not in keys), F.lit(True).alias("_in"))
    both = existing.withColumn("_had", F.lit(True)).join(new, keys, "full_outer")
    took = lambda c: F.when(F.col("_had").isNull() | (F.col("_in") & F.lit(c in updated)), F.col(f"_new_{c}")).otherwise(F.col(c))
    return both.select(*((F.col(c) if c in keys else took(c)).alias(c) for c in existing.columns))


def insert_ignore(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """The table and the incoming rows whose key it lacks."""
    return existing.unionByName(incoming.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti").select(*existing.columns))


def activate_one(models: DataFrame, name: str, dimension: int) -> DataFrame:
    """(name, dimension, is_active) with exactly ``name`` active, added if it is missing."""
    new = models.sparkSession.range(1).select(F.lit(name).alias("name"), F.lit(dimension).alias("dimension"))
    known = models.select("name", "dimension").unionByName(new).groupBy("name").agg(F.min("dimension").alias("dimension"))
    known = known.withColumn("dimension", F.when(F.col("name") == name, F.lit(dimension)).otherwise(F.col("dimension")))
    return known.withColumn("is_active", F.col("name") == name)


def adapters_for(members: DataFrame, assignments: DataFrame, adapters: DataFrame, user) -> DataFrame:
    """The active adapters of all of a user's departments; one in two departments comes twice."""
    mine = members.where(F.col("user_id") == user).select("department_id")
    active = adapters.where("is_active").select("adapter_id", "file_path")
    return assignments.join(mine, "department_id").join(active, "adapter_id").select("assignment_id", "adapter_id", "department_id", "file_path", "scale")


def path_index(listing: DataFrame) -> DataFrame:
    """(file_path, loaded_id) of a model server's listing (position, file_path, loaded_id); the last wins."""
    return listing.groupBy("file_path").agg(F.max_by("loaded_id", "position").alias("loaded_id"))


def bootstrap(users: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(users, departments, members) that ``new`` (user_id, username) adds to ``users`` (user_id, is_admin).

    While no administrator exists, the first new user becomes one; with one, nobody does.
    """
    admins = users.where(F.col("is_admin").eqNullSafe(True)).agg(F.count(F.lit(1))).scalar()
    first = new.agg(F.min("user_id")).scalar()
    slug = F.concat(F.lower("username"), F.lit("-dept"))
    accounts = new.select("user_id", "username", ((admins == 0) & (F.col("user_id") == first)).alias("is_admin"), F.concat("username", F.lit("@local")).alias("email"))
    departments = new.select(slug.alias("department_id"), F.concat("username", F.lit("'s Department")).alias("name"), slug.alias("slug"))
    return accounts, departments, new.select("user_id", slug.alias("department_id"))


def dedup_uploads(uploads: DataFrame) -> DataFrame:
    """The uploads with ``accepted``: the first of each (department_id, file_hash)."""
    first = uploads.groupBy("department_id", "file_hash").agg(F.min("doc_id").alias("first"))
    return uploads.join(first, ["department_id", "file_hash"]).withColumn("accepted", F.col("doc_id") == F.col("first")).drop("first")


def cascade_delete(documents: DataFrame, gone: DataFrame, *children: DataFrame) -> list[DataFrame]:
    """The documents and the child tables (chunks, vectors, jobs) without the documents ``gone`` (doc_id)."""
    return [t.join(gone.select("doc_id"), "doc_id", "left_anti") for t in (documents, *children)]


def restricted(departments: DataFrame, gone: DataFrame, documents: DataFrame) -> DataFrame:
    """The departments of ``gone`` (department_id) that can't go: they have documents."""
    return departments.join(gone.select("department_id"), "department_id", "left_semi").join(documents.select("department_id"), "department_id", "left_semi")


def delete_departments(departments: DataFrame, gone: DataFrame, documents: DataFrame, *children: DataFrame) -> list[DataFrame]:
    """The departments and what goes with them (members, assignments) without ``gone``; an error if one has documents."""
    if not restricted(departments, gone, documents).isEmpty():
        raise ValueError("a department with documents can't be deleted")
    return [t.join(gone.select("department_id"), "department_id", "left_anti").select(t.columns) for t in (departments, *children)]


def evolve(frame: DataFrame, renames: dict[str, str], backfill: dict[str, object], drop: list[str]) -> DataFrame:
    """Guarded schema steps: each is applied only where the schema still needs it."""
    for old, new in renames.items():
        if old in frame.columns and new not in frame.columns:
            frame = frame.withColumnRenamed(old, new)
    for name, value in backfill.items():
        value = value if hasattr(value, "cast") else F.lit(value)
        frame = frame.withColumn(name, F.coalesce(F.col(name), value) if name in frame.columns else value)
    return frame.drop(*drop)
