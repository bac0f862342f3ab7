"""The same policy for SQL: functions, a session variable, and views that carry each table's rule.

A catalog is a session of its own. In it ``documents``, ``chunks`` and the other tables of the
policy are views, each with its rule for reading; ``current_user_id()`` and ``is_member_of(...)``
are functions for queries and further views. Both go by the session variable ``identity``, which
is null unless a query is being built for somebody; then nothing is visible. A query keeps the
identity that it was built with.

The views are over the stored rows, which have names of their own in the session. Spark has no
rights for SQL, so a catalog protects from wrong queries, not from a caller who may run any SQL
and looks for those names or for the files.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from .policy import POLICIES, Identity, ScopedCatalog

_IDENTITY = "try_cast(trim(identity) AS BIGINT)"


class SqlCatalog:
    """``frames``: for a session, the rows of the policy's tables by name, members (user_id, department_id) among them.

    ``open_frames``: tables that everybody may read.
    """

    def __init__(self, spark: SparkSession, frames: Callable[[SparkSession], dict[str, DataFrame]], open_frames: Callable[[SparkSession], dict[str, DataFrame]] = lambda session: {}):
        self.session, self.lock = spark.newSession(), threading.Lock()
        for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
            self.session.conf.set(key, spark.conf.get(key))
        self.frames = frames(self.session)
        stored, run = f"rows_{uuid.uuid4().hex}", self.session.sql
        for name, frame in self.frames.items():
            frame.createOrReplaceTempView(f"{stored}_{name}")
        run("DECLARE VARIABLE identity STRING DEFAULT NULL")
        run(f"CREATE TEMPORARY FUNCTION current_user_id() RETURNS BIGINT RETURN {_IDENTITY}")
        mine = f"SELECT m.department_id FROM {stored}_members m WHERE m.user_id = {_IDENTITY}"
        run(f"CREATE TEMPORARY FUNCTION is_member_of(department STRING) RETURNS BOOLEAN RETURN EXISTS (SELECT 1 FROM {stored}_members m WHERE m.user_id = {_IDENTITY} AND m.department_id = department)")
        rules = {"member": f"department_id IN ({mine})", "parent": f"doc_id IN (SELECT d.doc_id FROM {stored}_documents d WHERE d.department_id IN ({mine}))", "own": f"user_id = {_IDENTITY}"}
        for name in self.frames:
            run(f"CREATE TEMPORARY VIEW {name} AS SELECT * FROM {stored}_{name} WHERE {rules.get(POLICIES[name].get('select'), 'false')}")
        for name, frame in open_frames(self.session).items():
            if name in self.frames:
                raise ValueError(f"{name} has a rule")
            frame.createOrReplaceTempView(name)

    @contextmanager
    def _as(self, user: object) -> Iterator[None]:
        text = None if user is None else str(user)
        with self.lock:
            self.session.sql("SET VARIABLE identity = " + ("NULL" if text is None else "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"))
            try:
                yield
            finally:
                self.session.sql("SET VARIABLE identity = NULL")

    def sql(self, query: str, user: object = None, **args) -> DataFrame:
        """A query as ``user`` sees the tables; ``args`` are values for its named parameters."""
        with self._as(user):
            return self.session.sql(query, args=args or None)

    def scoped(self, user: object) -> ScopedCatalog:
        """The same user's catalog of frames, for writing by each table's own rule."""
        return ScopedCatalog(self.frames["members"], Identity(user), self.frames.get("documents"))
