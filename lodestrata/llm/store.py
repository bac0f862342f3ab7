"""Where operators put tables that must outlive a lost executor."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import shared_folder


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """One operator call's tables in the shared folder, written as Parquet and read again.

    A written table cuts the lineage: what reads it needs no executor that made it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/lodestrata/{name}-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(self._close)  # a result may be read for as long as the program runs

    def _close(self) -> None:
        with contextlib.suppress(Exception):  # the JVM may be gone
            _remove(self.spark, self.root)

    def keep(self, frame: DataFrame, name: str) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}-{name}"
        frame.write.parquet(path)
        kept = self.spark.read.schema(frame.schema).parquet(path)
        kept.scratch_path = path
        return kept

    def drop(self, kept: DataFrame) -> None:
        """Remove a table that nothing will read any more."""
        _remove(self.spark, kept.scratch_path)


#: Rows in an Arrow batch between the JVM and a Python worker; whole texts can be long.
ARROW_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small in this session; a lower setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for a task, whose worker then gives the memory that it freed back: workers wait for further tasks beside those of later stages."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # glibc alone has it
            ctypes.CDLL(None).malloc_trim(0)

    return task
