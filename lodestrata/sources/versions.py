"""Tables of Parquet folders that change together, version by version.

A version is one small file under ``_log`` that names each table's schema, rules and folders.
Writers put new folders beside the old ones and then the next version's file, which only one of
them gets; so all that a transaction wrote is seen at once, and what a killed writer left is never
seen. A reader keeps to the version that it began with. A transaction that loses the race goes on
behind the winner if the winner changed nothing that it read, else it is worked out again.

Rules are checked on what is written, before it is seen: NOT NULL and CHECK are counted by the
write itself, as it runs; UNIQUE looks at the keys alone, of the new rows and of stored rows that
may equal them (the keys have Bloom filters in the files, so few of a small batch's are read).

Columns are known by number. A rename or a drop changes the schema alone; files written before
are read with the names of now, and a new column is null there.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .shared import counted, names_in, put_if_absent, read_text, remove, shuffled

#: Keys of a batch that are looked up by value in the stored files; a larger batch is joined.
KEYS_LOOKED_UP = 1000
_ID = "parquet.field.id"


class Conflict(Exception):
    """A transaction lost the race too often."""


class RuleBroken(ValueError):
    """Rows that break a table's rules, by rule; nothing of them was committed."""

    def __init__(self, table: str, broken: dict[str, int]):
        super().__init__(f"{table}: {', '.join(f'{n} rows break {rule}' for rule, n in broken.items())}")
        self.broken = broken


@dataclass
class Table:
    """What a version says of a table. ``unique``: keys; ``checks``: name -> SQL condition, which null passes; ``parts``: columns that folders are divided by."""

    schema: dict
    folders: list[str] = field(default_factory=list)
    unique: list[list[str]] = field(default_factory=list)
    checks: dict[str, str] = field(default_factory=dict)
    parts: list[str] = field(default_factory=list)
    last_id: int = 0

    @property
    def type(self) -> StructType:
        return StructType.fromJson(self.schema)


@dataclass(frozen=True)
class Version:
    number: int
    tables: dict[str, Table]
    changed: frozenset[str]


def _numbered(schema: StructType, last: int) -> tuple[StructType, int]:
    """The schema with a number for each column that lacks one."""
    out = []
    for f in schema:
        if _ID not in f.metadata:
            last += 1
            f = StructField(f.name, f.dataType, f.nullable, {**f.metadata, _ID: last})
        out.append(f)
    return StructType(out), last


class Versions:
    """The tables under ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        spark.conf.set("spark.sql.parquet.fieldId.read.enabled", "true")  # files and schemas without numbers are read by name as before

    def _file(self, number: int) -> str:
        return f"{self.root}/_log/{number:020d}.json"

    def at(self, number: int) -> Version:
        if number == 0:
            return Version(0, {}, frozenset())
        said = json.loads(read_text(self.spark, self._file(number)))
        return Version(number, {name: Table(**t) for name, t in said["tables"].items()}, frozenset(said["changed"]))

    def newest(self) -> Version:
        return self.at(max((int(n[:20]) for n in names_in(self.spark, f"{self.root}/_log") if n.endswith(".json") and n[0] != "."), default=0))

    def read(self, name: str, version: Version | None = None) -> DataFrame:
        """A table's rows in a version, the newest unless one is given."""
        table = (version or self.newest()).tables[name]
        return self._folders(name, table, table.folders).drop("_commit")

    def _folders(self, name: str, table: Table, folders: list[str]) -> DataFrame:
        """The rows of some folders, with the folder as ``_commit``."""
        schema = StructType([*table.type, StructField("_commit", StringType())])
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}").parquet(*(f"{self.root}/{name}/_commit={f}" for f in folders))

    def commit(self, work: Callable[[Transaction], None], tries: int = 20) -> int:
        """The number of the version that ``work`` made; it may be called again if others were faster."""
        for _ in range(tries):
            base = self.newest()
            change = Transaction(self, base)
            try:
                work(change)
                while True:
                    number = base.number + 1
                    tables = change.applied(base.tables)
                    text = json.dumps({"tables": {k: vars(t) for k, t in tables.items()}, "changed": sorted(change.wrote)})
                    if put_if_absent(self.spark, self._file(number), text):
                        change.done = True
                        return number
                    newest = self.newest()
                    others = frozenset().union(*(self.at(n).changed for n in range(base.number + 1, newest.number + 1)))
                    base = newest
                    if others & change.needs:
                        break
            finally:
                if not change.done:
                    change.forget()
        raise Conflict(f"others were faster {tries} times")

    def create(self, name: str, schema: str | StructType, unique: Iterable[Iterable[str]] = (), checks: dict[str, str] | None = None, parts: Iterable[str] = ()) -> None:
        """A new table; nothing happens if it is there."""
        if name not in self.newest().tables:
            self.commit(lambda t: t.create(name, schema, unique, checks or {}, parts))

    def sweep(self, keep: int = 10) -> int:
        """Delete folders that none of the last ``keep`` versions names; to be called while nobody writes. Returns their number."""
        newest = self.newest()
        named: dict[str, set[str]] = {}
        for n in range(max(1, newest.number - keep + 1), newest.number + 1):
            for name, table in self.at(n).tables.items():
                named.setdefault(name, set()).update(f"_commit={f}" for f in table.folders)
        gone = [f"{self.root}/{name}/{f}" for name, folders in named.items() for f in names_in(self.spark, f"{self.root}/{name}") if f.startswith("_commit=") and f not in folders]
        for path in gone:
            remove(self.spark, path)
        return len(gone)


class Transaction:
    """Reads of one version, and what shall be in the next one."""

    def __init__(self, versions: Versions, base: Version):
        self.versions, self.base, self.spark = versions, base, versions.spark
        self.needs: set[str] = set()  # tables that must not have changed meanwhile
        self.wrote: set[str] = set()
        self.written: list[str] = []
        self.new: dict[str, Table] = {}
        self.added: dict[str, list[str]] = {}
        self.removed: dict[str, set[str]] = {}  # folders of the base that the next version lacks
        self.done = False

    def table(self, name: str) -> Table:
        return self.new.get(name) or self.base.tables[name]

    def read(self, name: str) -> DataFrame:
        """The table's rows when the transaction began."""
        self.needs.add(name)
        return self.versions.read(name, self.base)

    def create(self, name: str, schema: str | StructType, unique: Iterable[Iterable[str]] = (), checks: dict[str, str] | None = None, parts: Iterable[str] = ()) -> None:
        if isinstance(schema, str):
            schema = self.spark.createDataFrame([], schema).schema
        numbered, last = _numbered(schema, 0)
        self._set(name, Table(numbered.jsonValue(), [], [list(k) for k in unique], dict(checks or {}), list(parts), last))

    def _set(self, name: str, table: Table) -> None:
        self.new[name] = table
        self.needs.add(name)
        self.wrote.add(name)

    def alter(self, name: str, rename: dict[str, str] | None = None, drop: Iterable[str] = (), add: str | None = None) -> None:
        """Other columns from now on; no file is touched. Columns of rules and of folders stay as they are."""
        table, rename, drop = self.table(name), rename or {}, set(drop)
        if fixed := (drop | set(rename)) & {c for key in [*table.unique, table.parts] for c in key}:
            raise ValueError(f"{sorted(fixed)} can't be changed")
        fields = [StructField(rename.get(f.name, f.name), f.dataType, f.nullable, f.metadata) for f in table.type if f.name not in drop]
        more = list(self.spark.createDataFrame([], add).schema) if add else []
        schema, last = _numbered(StructType([*fields, *more]), table.last_id)
        if len(set(schema.names)) < len(schema.names):
            raise ValueError("two columns would have one name")
        self._set(name, Table(schema.jsonValue(), table.folders, table.unique, table.checks, table.parts, last))

    def append(self, name: str, rows: DataFrame) -> None:
        """Add rows: the table's columns by name, those that lack are null. Raises if they break a rule."""
        self._write(name, rows)

    def overwrite(self, name: str, rows: DataFrame) -> None:
        """The table's rows from now on."""
        self.needs.add(name)
        self.removed[name], self.added[name] = set(self.table(name).folders), []
        self._write(name, rows)

    def delete(self, name: str, keys: DataFrame) -> None:
        """Delete the rows whose key is among ``keys``; only folders that have such rows are written anew."""
        self.needs.add(name)
        table, left = self.table(name), self._left(name)
        rows, keys = self.versions._folders(name, table, left), counted(keys)
        touched = [r["_commit"] for r in rows.join(keys, keys.columns, "left_semi").select("_commit").distinct().collect()] if left else []  # folders
        if touched:
            kept = self.versions._folders(name, table, touched).drop("_commit").join(keys, keys.columns, "left_anti")
            self.removed.setdefault(name, set()).update(touched)
            self.added[name] = [f for f in self.added.get(name, []) if f not in touched]
            self._write(name, kept, fresh=False)

    def replace(self, name: str, rows: DataFrame, key: list[str]) -> None:
        """Insert rows, in place of those that have the same key."""
        new, n = self._put(name, rows)
        if new:
            keys = self.versions._folders(name, self.table(name), [new]).select(*key)
            self.delete(name, keys)
            self._check(name, new, n)
            self.added.setdefault(name, []).append(new)

    def _left(self, name: str) -> list[str]:
        """The folders that the table has now, in this transaction."""
        gone = self.removed.get(name, set())
        return [f for f in [*self.table(name).folders, *self.added.get(name, [])] if f not in gone]

    def merge_folders(self, name: str) -> None:
        """The same rows in one folder."""
        self.overwrite(name, self.read(name))

    def _write(self, name: str, rows: DataFrame, fresh: bool = True) -> None:
        new, n = self._put(name, rows)
        if new:
            if fresh:
                self._check(name, new, n)
            self.added.setdefault(name, []).append(new)

    def _put(self, name: str, rows: DataFrame) -> tuple[str | None, int]:
        """(a new folder with the rows, their number as they were written); no folder if there are none."""
        table = self.table(name)
        schema = table.type
        rows = rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name, metadata=f.metadata) for f in schema))
        rules = {f"{f.name} is not null": F.col(f.name).isNull() for f in schema if not f.nullable} | {k: ~F.coalesce(F.expr(v), F.lit(True)) for k, v in table.checks.items()}
        names = list(rules)
        seen = Observation()
        watched = rows.observe(seen, F.count(F.lit(1)).alias("rows"), *(F.count(F.when(rules[r], 1)).alias(f"r{i}") for i, r in enumerate(names)))
        folder = uuid.uuid4().hex
        path = f"{self.versions.root}/{name}/_commit={folder}"
        self.written.append(path)
        writer = watched.write.partitionBy(*table.parts) if table.parts else watched.write
        for key in table.unique:
            for c in key:
                writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        writer.parquet(path)
        told = seen.get
        if broken := {r: told[f"r{i}"] for i, r in enumerate(names) if told[f"r{i}"]}:
            raise RuleBroken(name, broken)
        self.wrote.add(name)
        return (folder if told["rows"] else None), told["rows"]

    def _check(self, name: str, new: str, n: int) -> None:
        """Raise if the ``n`` rows of a folder just written share a key with each other or with others of the table; a key with a null is like no other."""
        table = self.table(name)
        for key in table.unique:
            self.needs.add(name)
            only = lambda folders: self.versions._folders(name, table, folders).select(*key).dropna()  # noqa: E731, B023
            rows, earlier = only([new]), self._left(name)
            broken = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").count()
            if not broken and earlier:
                old = only(earlier)
                if n <= KEYS_LOOKED_UP:
                    for c in key:
                        old = old.where(F.col(c).isin([r[0] for r in rows.select(c).distinct().collect()]))  # bounded by KEYS_LOOKED_UP
                broken = rows.join(shuffled(old), key, "left_semi").count()
            if broken:
                raise RuleBroken(name, {f"unique ({', '.join(key)})": broken})

    def applied(self, tables: dict[str, Table]) -> dict[str, Table]:
        """The tables of the next version, behind those of the one before."""
        out = dict(tables)
        for name in self.wrote:
            t, gone = self.new.get(name) or out[name], self.removed.get(name, set())
            there = [f for f in (out[name].folders if name in out else []) if f not in gone]
            out[name] = Table(t.schema, [*there, *self.added.get(name, [])], t.unique, t.checks, t.parts, t.last_id)
        return out

    def forget(self) -> None:
        """Delete what was written for nothing."""
        for path in self.written:
            remove(self.spark, path)
