"""The folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of keys that are broadcast, once they have been counted.
KEYS_BROADCAST = 100_000
_LOCAL: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a temporary folder if driver and executors are one process, else an error."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="lodestrata-"))
    return _LOCAL[0]


def shuffled(frame: DataFrame) -> DataFrame:
    """The side of a join that may have any size. Spark would judge it by its compressed bytes, and broadcast millions of numbers through the driver."""
    return frame.hint("merge")


def counted(keys: DataFrame) -> DataFrame:
    """Keys for a join: broadcast if they are counted to be few, else shuffled."""
    few = keys.limit(KEYS_BROADCAST + 1).count() <= KEYS_BROADCAST
    return F.broadcast(keys) if few else shuffled(keys)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a file or folder, on any of Spark's file systems."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder and what is in it, on any of Spark's file systems."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def passing_folder(spark: SparkSession, name: str) -> str:
    """A new name in the shared folder; what is written there goes at the end of the program."""
    path = f"{shared_folder(spark)}/lodestrata/{name}-{uuid.uuid4().hex}"

    def close() -> None:
        with contextlib.suppress(Exception):  # the JVM may be gone
            remove(spark, path)

    atexit.register(close)
    return path


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder; none if there is no such folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in files.listStatus(where)] if files.exists(where) else []


def read_text(spark: SparkSession, path: str) -> str:
    """A small UTF-8 file."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def put_if_absent(spark: SparkSession, path: str, text: str, links: bool = True) -> bool:
    """Whether a small file came to be under a name that wasn't there; of several writers one gets it, and readers see all of it or nothing.

    The text is written aside and then given its name: by a link on a local file system, whose
    rename would overwrite, and elsewhere by a rename that doesn't.
    """
    jvm, where = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    aside = jvm.org.apache.hadoop.fs.Path(where.getParent(), f".{where.getName()}-{uuid.uuid4().hex}")
    stream = files.create(aside, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    try:
        if links and files.getUri().getScheme() == "file":
            local = lambda x: urlsplit(x.toUri().toString()).path
            try:
                os.link(local(aside), local(where))
            except FileExistsError:
                return False
            return True
        kind = jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        none = jvm.java.lang.reflect.Array.newInstance(kind, 1)
        jvm.java.lang.reflect.Array.set(none, 0, kind.getEnumConstants()[0])
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
        try:
            context.rename(aside, where, none)
        except Exception as error:  # the JVM's exceptions come as one kind
            if "FileAlreadyExists" in str(error):
                return False
            raise
        return True
    finally:
        files.delete(aside, False)
