"""Blobs as files named by the SHA-256 of their bytes, read and written as a data source.

Format ``lodestrata_blobs``, option ``path``. A blob is ``ab/abcd...``, by the first characters of
its hash. Bytes are written aside and then given that name, so writers of one content keep one
copy, whoever comes first, and a file is whole once it has its name; that is all there is to
commit. Reading with conditions on ``file_hash`` (equality, ``IN``) opens those files alone; else
the folders are dealt to tasks.
"""

from __future__ import annotations

import hashlib
import threading
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

SCHEMA = "file_hash string, byte_size long, content binary"
#: Hashes that one task opens.
TASK_BLOBS = 256
_LOCK = threading.Lock()
_PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")


def blob_path(folder: str, file_hash: str) -> str:
    return f"{folder}/{file_hash[:2]}/{file_hash}"


@dataclass
class Hashes(InputPartition):
    names: list[str]


@dataclass
class Folder(InputPartition):
    prefix: str


class BlobSource(DataSource):
    """See the module; rows whose content is null aren't written."""

    @classmethod
    def name(cls) -> str:
        return "lodestrata_blobs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BlobReader:
        return BlobReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> BlobWriter:
        if overwrite:
            raise ValueError("blobs are added, never overwritten")
        return BlobWriter(self.options["path"], schema.names)


class BlobReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.wanted = path, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            values = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("file_hash",):
                self.wanted = set(values) if self.wanted is None else self.wanted & set(values)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        if self.wanted is not None:
            names = sorted(n for n in self.wanted if isinstance(n, str) and len(n) == 64 and n.isalnum())
            return [Hashes(names[i : i + TASK_BLOBS]) for i in range(0, len(names), TASK_BLOBS)] or [Hashes([])]
        files, folder = _place(self.path)
        there = files.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return [Folder(f.base_name) for f in there if f.type == fs.FileType.Directory] or [Hashes([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        files, folder = _place(self.path)
        if isinstance(partition, Hashes):
            names = partition.names
        else:
            names = [f.base_name for f in files.get_file_info(fs.FileSelector(f"{folder}/{partition.prefix}")) if f.is_file and not f.base_name.startswith(".")]
        for name in names:
            try:
                with files.open_input_stream(blob_path(folder, name)) as stream:
                    data = stream.read()
            except FileNotFoundError:
                continue
            yield name, len(data), data


@dataclass
class Kept(WriterCommitMessage):
    new: int
    there: int


class BlobWriter(DataSourceWriter):
    def __init__(self, path: str, names: list[str]):
        self.path, self.names = path, names

    def write(self, iterator: Iterator[Row]) -> Kept:
        files, folder = _place(self.path)
        new = there = 0
        for row in iterator:
            if (data := row["content"]) is None:
                continue
            name = hashlib.sha256(data).hexdigest()
            place = blob_path(folder, name)
            if files.get_file_info(place).type == fs.FileType.File:
                there += 1
                continue
            parent = place.rpartition("/")[0]
            files.create_dir(parent, recursive=True)
            aside = f"{parent}/.{uuid.uuid4().hex}"
            with files.open_output_stream(aside) as out:
                out.write(data)
            files.move(aside, place)  # of two writers both move the same bytes there
            new += 1
        return Kept(new, there)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        pass

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        pass  # whole blobs may stay: they are what their names say


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with conditions handed to the reader."""
    spark.createDataFrame([], "x int")  # makes the session this thread's, where formats are looked up
    with _LOCK:
        if not getattr(spark, "lodestrata_blobs", False):
            spark.dataSource.register(BlobSource)
            spark.conf.set(_PUSHDOWN, "true")
            spark.lodestrata_blobs = True


def write_blob_files(contents: DataFrame, root: str) -> None:
    """Keep each content once. ``contents``: a column ``content``."""
    register(contents.sparkSession)
    contents.select("content").write.format("lodestrata_blobs").option("path", root).mode("append").save()


def blob_files(spark: SparkSession, root: str) -> DataFrame:
    """file_hash, byte_size, content of the blobs."""
    register(spark)
    return spark.read.format("lodestrata_blobs").option("path", root).load()
