"""Row-level policy: who may see and change which rows.

Spark has no row-level security, so tables are handed out by a catalog only. The scoped one wraps
each in the rule that ``POLICIES`` gives for a table and a verb; a verb without a rule is denied.
Without an identity, with one that isn't a user id, or with an unknown one, nothing is visible.
The identity is an argument: there is no state that a later caller could inherit. Administrators
and the ingestion have catalogs of their own that bypass the rules, and say so by their name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.versions import Versions

VERBS = ("select", "insert", "update", "delete")
#: Rules by table and verb: rows of the caller's departments, rows whose parent document is visible, the caller's own rows.
POLICIES: dict[str, dict[str, str]] = {
    "documents": dict.fromkeys(VERBS, "member"),
    "chunks": dict.fromkeys(VERBS, "member"),
    "vectors": dict.fromkeys(VERBS, "member"),
    "assignments": dict.fromkeys(VERBS, "member"),
    "jobs": dict.fromkeys(VERBS[:3], "parent"),
    "audit_log": dict.fromkeys(VERBS[:2], "own"),
    "departments": {"select": "member"},
    "members": {"select": "own"},
}


@dataclass(frozen=True)
class Identity:
    """A caller; ``user`` may be anything, and counts only if it reads as a user id."""

    user: object = None

    def column(self):
        value = None if self.user is None else str(self.user)
        return F.trim(F.lit(value).cast("string")).try_cast("long")


class PolicyError(Exception):
    """A read or write that the caller may not do."""


class ScopedCatalog:
    """Frames as one identity sees and may change them.

    ``documents`` (doc_id, department_id) are the parents of tables with rule ``parent``.
    """

    def __init__(self, members: DataFrame, identity: Identity, documents: DataFrame | None = None):
        self.identity, self.documents = identity, documents
        self.departments_of = members.where(F.col("user_id") == identity.column()).select("department_id").distinct()

    def by_department(self, frame: DataFrame) -> DataFrame:
        """Rows of the caller's departments."""
        return frame.join(self.departments_of, "department_id", "left_semi")

    def by_parent(self, frame: DataFrame, parents: DataFrame, key: str) -> DataFrame:
        """Rows whose parent row the caller sees."""
        return frame.join(self.by_department(parents).select(key), key, "left_semi")

    def own(self, frame: DataFrame) -> DataFrame:
        """Rows of the caller's own."""
        return frame.where(F.col("user_id") == self.identity.column())

    def rows(self, table: str, verb: str, frame: DataFrame) -> DataFrame:
        """The rows of ``frame`` that the caller may read or change by ``verb``; none if no rule says so."""
        rule = POLICIES[table].get(verb)
        if rule == "member":
            return self.by_department(frame)
        if rule == "parent":
            if self.documents is None:
                raise ValueError(f"{table} needs the parent documents")
            return self.by_parent(frame, self.documents, "doc_id")
        return self.own(frame) if rule == "own" else frame.where(F.lit(False))

    def denied(self, table: str, verb: str, frame: DataFrame) -> DataFrame:
        """The other rows of ``frame``: those that ``verb`` may not touch."""
        rule = POLICIES[table].get(verb)
        if rule == "member":
            return frame.join(self.departments_of, "department_id", "left_anti")
        if rule == "parent":
            if self.documents is None:
                raise ValueError(f"{table} needs the parent documents")
            return frame.join(self.by_department(self.documents).select("doc_id"), "doc_id", "left_anti")
        return frame.where(~F.coalesce(F.col("user_id") == self.identity.column(), F.lit(False))) if rule == "own" else frame

    def decided(self, table: str, verb: str, frame: DataFrame, key: list[str]) -> DataFrame:
        """The rows with ``allowed``: whether ``verb`` may touch each. ``key`` names a row."""
        may = self.rows(table, verb, frame).select(*key).distinct().withColumn("_may", F.lit(True))
        return frame.join(may, key, "left").withColumn("allowed", F.coalesce("_may", F.lit(False))).drop("_may")

    def checked(self, incoming: DataFrame) -> DataFrame:
        """The incoming rows with ``allowed``: whether the caller may write them."""
        return self.decided("documents", "insert", incoming, ["department_id"])

    def require(self, table: str, verb: str, frame: DataFrame) -> None:
        """An error if ``verb`` may not touch one of the rows, by the table's own rule."""
        if not self.denied(table, verb, frame).isEmpty():
            raise PolicyError(f"{verb} of rows of {table} that are not the caller's")

    def write(self, table: str, incoming: DataFrame, path: str) -> None:
        """Append the rows to the table's folder, or none of them and an error if one is not allowed."""
        self.require(table, "insert", incoming)
        incoming.write.mode("append").parquet(path)

    def insert(self, tables: Versions, table: str, incoming: DataFrame) -> int:
        """The same in versioned tables."""
        self.require(table, "insert", incoming)
        return tables.commit(lambda t: t.append(table, incoming))

    def update_outcomes(self, table: str, frame: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
        """The rows that ``changes`` (key and new values) name, with their new values and ``outcome``.

        ``ignored``: the old row is not the caller's to change; ``rejected``: the new row would not
        be; ``updated`` otherwise. Keys without a row give nothing.
        """
        new = [F.col(f"_new_{c}").alias(c) if c in changes.columns and c not in key else F.col(c) for c in frame.columns]
        named = changes.select(*key, *(F.col(c).alias(f"_new_{c}") for c in changes.columns if c not in key))
        touched = self.decided(table, "update", frame, key).join(named, key).select(*new, F.col("allowed").alias("_old"))
        return self.decided(table, "update", touched, key).withColumn("outcome", F.when(~F.col("_old"), "ignored").when(~F.col("allowed"), "rejected").otherwise("updated")).drop("_old", "allowed")

    def update(self, table: str, frame: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
        """The table after the changes; an error, and no change, if a new row is rejected."""
        outcomes = self.update_outcomes(table, frame, changes, key)
        if not outcomes.where("outcome = 'rejected'").isEmpty():
            raise PolicyError("the changed rows would not be the caller's")
        done = outcomes.where("outcome = 'updated'").drop("outcome")
        return frame.join(done.select(*key), key, "left_anti").unionByName(done)

    def delete(self, table: str, frame: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
        """The table without the rows ``gone`` (key) that the caller may delete; others stay without an error."""
        mine = self.rows(table, "delete", frame).join(gone.select(*key), key, "left_semi").select(*key)
        return frame.join(mine, key, "left_anti")


def require_admin(users: DataFrame, identity: Identity) -> None:
    """Raise unless the caller is a known user whose ``is_admin`` is true."""
    if users.where((F.col("user_id") == identity.column()) & F.col("is_admin").eqNullSafe(True)).isEmpty():
        raise PolicyError("an administrator is required")


def _known(table: str, verb: str, tables: dict[str, tuple[str, ...]]) -> None:
    if verb not in tables.get(table, ()):
        raise PolicyError(f"no {verb} of {table} here")


class AdminCatalog:
    """All rows of all tables, for administrators alone: others get an error when they ask for it."""

    TABLES = dict.fromkeys(POLICIES, VERBS)

    def __init__(self, users: DataFrame, identity: Identity):
        require_admin(users, identity)

    def rows(self, table: str, verb: str, frame: DataFrame) -> DataFrame:
        _known(table, verb, self.TABLES)
        return frame


class IngestCatalog:
    """What the ingestion does, in all departments: it reads and updates documents and jobs, and makes chunks and vectors anew."""

    TABLES = {"documents": ("select", "update"), "jobs": ("select", "update"), "chunks": ("select", "insert", "delete"), "vectors": ("select", "insert", "delete")}

    def rows(self, table: str, verb: str, frame: DataFrame) -> DataFrame:
        _known(table, verb, self.TABLES)
        return frame
