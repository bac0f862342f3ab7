"""Streamed answers whose bytes arrive in pieces: frames are put together across micro-batches.

A piece is some bytes of a stream with their number (from 0); the last one says so. Pieces may be
cut anywhere, also inside a character, and may come out of order, twice, and in any batch. State
keeps, for each stream, the bytes behind its last whole frame and the pieces that came too early.
States are a table of the open streams, written anew by each batch, beside the ids of those that
ended: a batch's pieces meet them by one shuffle, and Python joins frames over Arrow batches of
streams, as calls for each stream or piece would take far longer than the work.
Each frame that counts (by the rules of ``operators.frames``) is a token; behind a token that says
stop nothing counts, and the stream's state is dropped but for that.

Tokens go to a sink of files by the data source API: a task writes a file of its own, and the
batch's commit names the files in one small manifest. Files that no manifest names aren't read,
and a batch that comes again after a crash finds its manifest and leaves it as it is.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery

from ..sources.shared import names_in, read_text, remove

PIECE = "stream_id string, piece long, data binary, last boolean"
TOKEN = "stream_id string, token long, content string, stop boolean"
_MARK, _END = "data: ", b"\n\n"
_STATE = "stream_id string, wanted long, tokens long, ended boolean, rest binary, early binary, first long, found array<struct<content: string, stop: boolean>>"
_STREAMS = 500  # whose pieces are Python objects at a time
_HEAD = struct.Struct("<qq?")


def token_of(frame: bytes) -> tuple[str, bool] | None:
    """(content, stop) of a frame that counts."""
    text = frame.decode("utf-8", "replace").lstrip(" ")
    if not text.startswith(_MARK):
        return None
    try:
        said = json.loads(text[len(_MARK) :])
    except ValueError:
        return None
    if not isinstance(said, dict) or said.get("content") is None:
        return None
    content = said["content"]
    return content if isinstance(content, str) else json.dumps(content, ensure_ascii=False, separators=(",", ":")), said.get("stop") is True


def _packed(pieces: dict[int, tuple[bytes, bool]]) -> bytes:
    return b"".join(part for piece, (data, last) in pieces.items() for part in (_HEAD.pack(piece, len(data), last), data))


def _unpacked(early: bytes) -> dict[int, tuple[bytes, bool]]:
    found, at = {}, 0
    while at < len(early):
        piece, size, last = _HEAD.unpack_from(early, at)
        found[piece] = early[at + _HEAD.size : at + _HEAD.size + size], last
        at += _HEAD.size + size
    return found


def _step(came: list[tuple], wanted: int, tokens: int, rest: bytes, early: bytes) -> tuple:
    """One stream's state behind a batch and the tokens found; before it: the next piece wanted, the tokens so far, the bytes of an open frame, the early pieces."""
    here = _unpacked(early) | {piece: (data or b"", bool(last)) for piece, data, last in came if piece >= wanted}
    joined, last = [rest], False
    while not last and wanted in here:
        data, last = here.pop(wanted)
        joined.append(data)
        wanted += 1
    frames, found = b"".join(joined).split(_END), []
    rest = b"" if last else frames.pop()
    for frame in frames:
        if (token := token_of(frame)) is not None:
            found.append({"content": token[0], "stop": token[1]})
            if token[1]:
                last = True
                break
    return wanted, tokens + len(found), last, b"" if last else rest, b"" if last else _packed(here), tokens, found


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("stream_id", pa.string()), ("wanted", pa.int64()), ("tokens", pa.int64()), ("ended", pa.bool_()), ("rest", pa.binary()), ("early", pa.binary()), ("first", pa.int64()), ("found", pa.list_(pa.struct([("content", pa.string()), ("stop", pa.bool_())])))])
    for batch in (whole.slice(at, _STREAMS) for whole in batches for at in range(0, whole.num_rows, _STREAMS)):
        came = batch.column("came")
        rows = list(zip(*(c.to_pylist() for c in came.flatten().flatten()), strict=True))
        sizes, at, made = came.value_lengths().to_pylist(), 0, []
        states = zip(*(batch.column(c).to_pylist() for c in ("stream_id", "wanted", "tokens", "rest", "early")), strict=True)
        for size, (stream, wanted, tokens, rest, early) in zip(sizes, states, strict=True):
            made.append((stream, *_step(rows[at : at + size], wanted or 0, tokens or 0, rest or b"", early or b"")))
            at += size
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), schema, strict=True)], schema=schema)


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    rows: int


class TokenSink(DataSource):
    """Format ``lodestrata_tokens``: option ``path``, a folder of files and manifests."""

    @classmethod
    def name(cls) -> str:
        return "lodestrata_tokens"

    def streamWriter(self, schema, overwrite: bool) -> TokenWriter:
        return TokenWriter(self.options["path"])

    def writer(self, schema, overwrite: bool) -> TokenBatchWriter:
        """The same for a batch of a stream that is handed over as a frame; option ``batch``: its number."""
        return TokenBatchWriter(self.options["path"], int(self.options["batch"]))


class TokenWriter(DataSourceStreamWriter):
    def __init__(self, path: str):
        self.path = path

    def _place(self, name: str) -> tuple[fs.FileSystem, str]:
        files, folder = fs.FileSystem.from_uri(self.path if ":" in self.path else f"file://{self.path}")
        return files, f"{folder}/{name}"

    def write(self, iterator: Iterator[Row]) -> Written:
        """A file with the task's tokens, in blocks; none if there are no tokens."""
        schema = pa.schema([("stream_id", pa.string()), ("token", pa.int64()), ("content", pa.string()), ("stop", pa.bool_())])
        name, rows, block, out = f"tokens/{uuid.uuid4().hex}.parquet", 0, [], None
        files, place = self._place(name)

        def put() -> None:
            nonlocal out, block
            if out is None:
                files.create_dir(place.rpartition("/")[0], recursive=True)
                out = pq.ParquetWriter(place, schema, filesystem=files)
            out.write_table(pa.Table.from_pylist(block, schema))
            block = []

        for row in iterator:
            block.append({c: row[c] for c in schema.names})
            rows += 1
            if len(block) == 10_000:
                put()
        if block:
            put()
        if out is not None:
            out.close()
        return Written(name if rows else None, rows)

    def commit(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        files, place = self._place(f"commits/{batchId:020d}.json")
        if files.get_file_info(place).type != fs.FileType.NotFound:
            return self.abort(messages, batchId)  # the batch was committed before
        files.create_dir(place.rpartition("/")[0], recursive=True)
        aside = f"{place.rpartition('/')[0]}/.{uuid.uuid4().hex}"
        with files.open_output_stream(aside) as out:
            out.write(json.dumps({"files": [m.file for m in messages if m and m.file], "rows": sum(m.rows for m in messages if m)}).encode())
        files.move(aside, place)

    def abort(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        for m in messages:
            if m and m.file:
                files, place = self._place(m.file)
                files.delete_file(place)


class TokenBatchWriter(DataSourceWriter):
    def __init__(self, path: str, number: int):
        self.out, self.number = TokenWriter(path), number

    def write(self, iterator: Iterator[Row]) -> Written:
        return self.out.write(iterator)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        self.out.commit(messages, self.number)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self.out.abort(messages, self.number)


def start_joining(spark: SparkSession, pieces: DataFrame, target: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start the query from a stream of pieces to the sink's folder; it ends by itself with ``availableNow=True``."""
    spark.dataSource.register(TokenSink)
    states, ids = f"{checkpoint}/streams", f"{checkpoint}/ended"

    def put(batch: DataFrame, number: int) -> None:
        earlier = lambda folder: sorted(n for n in (int(x.partition("=")[2]) for x in names_in(spark, folder) if x.startswith("batch=")) if n < number)
        known, gone = earlier(states), earlier(ids)
        met = batch.select("stream_id", F.struct("piece", "data", "last").alias("p"))
        if known:
            before = spark.read.schema(_STATE).parquet(f"{states}/batch={known[-1]}").where("not ended")
            met = met.unionByName(before.select("stream_id", "wanted", "tokens", "rest", "early"), allowMissingColumns=True)
        if gone:
            met = met.unionByName(spark.read.schema("stream_id string").parquet(*(f"{ids}/batch={n}" for n in gone)).withColumn("ended", F.lit(True)), allowMissingColumns=True)
        met = met.withColumns({c: F.lit(None).cast(t) for c, t in (("wanted", "long"), ("tokens", "long"), ("rest", "binary"), ("early", "binary"), ("ended", "boolean")) if c not in met.columns})
        streams = met.groupBy("stream_id").agg(F.collect_list("p").alias("came"), *(F.max(c).alias(c) for c in ("wanted", "tokens", "rest", "early", "ended"))).where("ended is null").drop("ended")
        streams.mapInArrow(_join, _STATE).write.mode("overwrite").parquet(f"{states}/batch={number}")
        after = spark.read.schema(_STATE).parquet(f"{states}/batch={number}")
        after.where("ended").select("stream_id").write.mode("overwrite").parquet(f"{ids}/batch={number}")
        found = after.select("stream_id", "first", F.posexplode("found").alias("at", "t")).select("stream_id", (F.col("first") + F.col("at")).alias("token"), "t.content", "t.stop")
        found.write.format(TokenSink.name()).option("path", target).option("batch", number).mode("append").save()
        for n in known[:-1]:  # if this batch is repeated it needs the last table, none needs an older one
            remove(spark, f"{states}/batch={n}")

    rows = pieces.select("stream_id", "piece", "data", "last")
    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def tokens(spark: SparkSession, target: str) -> DataFrame:
    """The tokens of committed batches."""
    names = [n for n in names_in(spark, f"{target}/commits") if n.endswith(".json") and n[0] != "."]
    files = [f"{target}/{f}" for n in names for f in json.loads(read_text(spark, f"{target}/commits/{n}"))["files"]]
    return spark.read.schema(TOKEN).parquet(*files) if files else spark.createDataFrame([], TOKEN)


def answers(found: DataFrame) -> DataFrame:
    """stream_id, answer: the contents of each stream's tokens, in order (an answer is one row)."""
    parts = F.sort_array(F.collect_list(F.struct("token", "content")))
    return found.groupBy("stream_id").agg(F.array_join(F.transform(parts, lambda p: p["content"]), "").alias("answer"))
