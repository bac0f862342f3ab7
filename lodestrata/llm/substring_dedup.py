"""Substring dedup: words covered by repeated windows go, with a count-min prefilter.

A window is ``WINDOW`` words. Its anchor is its smallest-hashed run of ``ANCHOR`` words, so
equal windows have equal anchors at equal places, and about one word in ten is an anchor.

1. Each task counts its anchors in a count-min sketch (counters stop at two); the partition
   sketches are merged segment by segment, and of each cell one bit stays: two or more. A sketch
   overestimates, so an anchor that occurs twice is never taken for single. All cells of an anchor
   lie in one segment. Up to ``MOST_CELLS`` cells the bits are broadcast. A larger sketch stays a
   table of segments: anchors are sent to their segment, and what is left of them to their text.
2. Windows whose anchor is estimated repeated are grouped exactly, by a 96-bit hash: counts
   are aggregated before the shuffle, and a semi-join finds the places of those of two or more.
   Windows that occur very often (at most ``MOST_HOT`` of them) are dealt out over ``SALTS``
   parts of the join. All other windows are single.
3. Each document gets its repeated windows and drops the words they cover. Texts of documents
   without a candidate window are finished where they are read and are not shuffled.

The sketch's width follows the number of text bytes, so its error doesn't grow with the input.

A row is named by 128 bits of its doc_id and text, which equal rows share.

Defined results: a null, empty or wordless text has no words and the digest of the empty text;
documents under ``WINDOW`` words lose nothing; repeated rows repeat each other's windows; null
doc_ids are handled like others; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .store import Scratch, small_batches

WINDOW, ANCHOR = 35, 18
#: Rows of the sketch, cells in a segment (as a power of two), and most cells in a row of a sketch that is broadcast (24 MB of bits).
ROWS, SEGMENT_BITS, MOST_CELLS = 3, 16, 1 << 26
#: Cells of a row for each anchor, at least; the next power of two is taken.
CELLS_PER_ANCHOR = 3
#: Windows of so many occurrences are hot, and parts that a hot one is dealt out over.
HOT, MOST_HOT, SALTS = 1000, 1 << 16, 64
#: Anchors that a task holds before it hands on its sketch.
HELD_ANCHORS = 1 << 21

_U = np.uint64


def anchors(block: words.Block, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, place of the anchor, anchor hash) of each window of the block; leftmost on ties."""
    start = words.run_starts(block.first, window)
    value = words.run_hashes(block.hash, anchor)
    if not len(start):
        return start, start, value[:0]
    have, place, size, span = value, np.arange(len(value)), 1, window - anchor + 1

    def smaller(h, p, shift, n):
        later = h[shift : shift + n] < h[:n]
        return np.where(later, h[shift : shift + n], h[:n]), np.where(later, p[shift : shift + n], p[:n])

    while 2 * size <= span:
        have, place = smaller(have, place, size, len(have) - size)
        size *= 2
    have, place = smaller(have, place, span - size, len(have) - (span - size))
    return start, place[start], have[start]


def segments_of(value: np.ndarray, width: int) -> np.ndarray:
    return (words.mix(value + words.salted(ROWS + 1)) & _U((width >> SEGMENT_BITS) - 1)).astype(np.int64)


def cells_inside(value: np.ndarray, row: int) -> np.ndarray:
    return (words.mix(value + words.salted(row + 1)) >> _U(64 - SEGMENT_BITS)).astype(np.int64)


def cells(value: np.ndarray, row: int, width: int) -> np.ndarray:
    return segments_of(value, width) << SEGMENT_BITS | cells_inside(value, row)


def sketch_width(text_bytes: int) -> int:
    """Cells in a row: some for each anchor, about one anchor being in 60 bytes of text.

    With three cells an anchor and three rows, one anchor in 45 is taken for repeated by chance.
    """
    return max(1 << SEGMENT_BITS, 1 << int(text_bytes / 60 * CELLS_PER_ANCHOR).bit_length())


def sketch_table(docs: DataFrame, window: int, anchor: int, width: int) -> DataFrame:
    """(segment, twice): the cells of two or more of all partitions' sketches, as compressed bits; row r's segment s has number r * segments + s."""
    segments = width >> SEGMENT_BITS

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def hand_on():
            value = np.concatenate(held)
            for row in range(ROWS):
                cell = np.sort(cells(value, row, width))
                first = np.ones(len(cell), bool)
                first[1:] = cell[1:] != cell[:-1]
                again = ~first
                one, two = cell[first], np.unique(cell[again])
                border = np.arange(segments + 1) << SEGMENT_BITS
                a, b = np.searchsorted(one, border), np.searchsorted(two, border)
                low = lambda x: (x & ((1 << SEGMENT_BITS) - 1)).astype(np.uint16).tobytes()
                used = np.flatnonzero(np.diff(a))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(used + row * segments, pa.int64()), pa.array([low(one[a[i] : a[i + 1]]) for i in used], pa.binary()), pa.array([low(two[b[i] : b[i + 1]]) for i in used], pa.binary())],
                    ["segment", "once", "twice"],
                )

        for batch in batches:
            for block in words.blocks(batch.column(0)):
                _, place, value = anchors(block, window, anchor)
                new = np.ones(len(place), bool)
                new[1:] = place[1:] != place[:-1]
                held.append(value[new])
                n += len(held[-1])
                if n > HELD_ANCHORS:
                    yield from hand_on()
                    held, n = [], 0
        if n:
            yield from hand_on()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, once, twice = None, None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([zlib.compress(np.packbits(twice).tobytes(), 1)], pa.binary())], ["segment", "twice"])

        for batch in batches:
            for segment, one, two in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if segment != at:
                    if at is not None:
                        yield done()
                    at, once, twice = segment, np.zeros(1 << SEGMENT_BITS, bool), np.zeros(1 << SEGMENT_BITS, bool)
                one = np.frombuffer(one, np.uint16)
                twice[one[once[one]]] = True
                twice[np.frombuffer(two, np.uint16)] = True
                once[one] = True
        if at is not None:
            yield done()

    parts = docs.select(F.col("text").cast("string")).mapInArrow(sketch, "segment long, once binary, twice binary")
    return parts.repartition("segment").sortWithinPartitions("segment").mapInArrow(merge, "segment long, twice binary")


def _bits(column: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(zlib.decompress(x), np.uint8) for x in column]


def merged_sketch(docs: DataFrame, window: int, anchor: int, width: int) -> np.ndarray:
    """The whole sketch as ROWS x width bits, packed; for widths up to ``MOST_CELLS``."""
    bits = np.zeros((ROWS * (width >> SEGMENT_BITS), (1 << SEGMENT_BITS) // 8), np.uint8)
    for row in sketch_table(docs, window, anchor, width).collect():  # at most ROWS * MOST_CELLS bits, compressed
        bits[row["segment"]] = _bits([row["twice"]])[0]
    return bits.reshape(ROWS, -1)


def surviving_anchors(docs: DataFrame, window: int, anchor: int, width: int, scratch: Scratch) -> DataFrame:
    """(doc_key, text_key, alive): each row's anchors that a sketch of any width estimates at two or more.

    ``docs``: text, doc_key, text_key. The sketch is never in one place: a segment's bits come first
    in its partition and the anchors that ask for them behind. Anchors that a block of texts has
    twice needn't ask, so a very common one doesn't fill its segment.
    """
    segments = width >> SEGMENT_BITS
    keys = "anchor long, doc_key long, text_key long"

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_key = batch.column(1).to_numpy().view(np.uint64)
            for block in words.blocks(batch.column(0)):
                start, place, value = anchors(block, window, anchor)
                if not len(start):
                    continue
                document = block.document()[start]
                order = np.lexsort((place, document, value))
                value, document, place = value[order], document[order], place[order]
                first = np.ones(len(value), bool)  # of each place of an anchor
                first[1:] = (value[1:] != value[:-1]) | (document[1:] != document[:-1]) | (place[1:] != place[:-1])
                value, document = value[first], document[first]
                same = value[1:] == value[:-1]
                twice = np.append(same, False) | np.append(False, same)
                first = np.ones(len(value), bool)  # of each document of an anchor
                first[1:] = (value[1:] != value[:-1]) | (document[1:] != document[:-1])
                value, document, twice = value[first], document[first], twice[first]
                rows = block.rows[document]
                segment = np.where(twice, (doc_key[rows] % _U(segments)).astype(np.int64), segments_of(value, width))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(segment), pa.array(twice.astype(np.int32) + 1), pa.array(value.view(np.int64)), batch.column(1).take(pa.array(rows)), batch.column(2).take(pa.array(rows))],
                    ["segment", "kind", "anchor", "doc_key", "text_key"],
                )

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, bits = None, {}
        for batch in batches:
            segment, kind, row, value = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("segment", "kind", "row", "anchor"))
            alive = kind == 2
            for s in np.unique(segment):
                if s != at:
                    at, bits = s, {}
                mine = segment == s
                for i in np.flatnonzero(mine & (kind == 0)):
                    bits[int(row[i])] = _bits([batch.column("twice")[int(i)].as_py()])[0]
                asked = np.flatnonzero(mine & (kind == 1))
                ok = np.full(len(asked), len(bits) == ROWS)
                for r, packed in bits.items():
                    cell = cells_inside(value[asked].astype(np.int64).view(np.uint64), r)
                    ok &= (packed[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
                alive[asked] = ok
            yield batch.filter(pa.array(alive)).select(["anchor", "doc_key", "text_key"])

    table = sketch_table(docs.select("text"), window, anchor, width)
    table = table.select((F.col("segment") % segments).alias("segment"), F.lit(0).alias("kind"), F.floor(F.col("segment") / segments).cast("int").alias("row"), "twice", *(F.lit(0).cast("long").alias(c) for c in ("anchor", "doc_key", "text_key")))
    asking = docs.select("text", "doc_key", "text_key").mapInArrow(ask, "segment long, kind int, " + keys)
    asking = asking.select("segment", "kind", F.lit(0).alias("row"), F.lit(None).cast("binary").alias("twice"), "anchor", "doc_key", "text_key")
    told = table.unionByName(asking).repartition("segment").sortWithinPartitions("segment", "kind").mapInArrow(answer, keys)
    return scratch.keep(told.groupBy("doc_key", "text_key").agg(F.collect_set("anchor").alias("alive")), "anchors")


def maybe_repeated(value: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """Whether the sketch estimates each anchor at two or more."""
    out = np.ones(len(value), bool)
    for row in range(ROWS):
        cell = cells(value, row, 8 * sketch.shape[1])
        out &= (sketch[row][cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
    return out


def candidate_windows(block: words.Block, window: int, anchor: int, sketch: np.ndarray | None, alive: pa.Array | None) -> np.ndarray:
    """First words of the windows that may be repeated: by the sketch, or by the anchors told to be alive for each document."""
    start, _, value = anchors(block, window, anchor)
    if sketch is not None:
        return start[maybe_repeated(value, sketch)]
    lists = alive.take(pa.array(block.rows))
    counts = np.diff(np.asarray(lists.offsets)) * lists.is_valid().to_numpy(zero_copy_only=False)
    known = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    named = lambda v, d: words.mix(v + (d.astype(np.uint64) + _U(1)) * words.salted(1))
    return start[np.isin(named(value, block.document()[start]), named(known, np.repeat(np.arange(len(counts)), counts)))]


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, with_text: bool = False) -> DataFrame:
    """For each row doc_id, n_words, n_removed, kept_sha256 and, if asked for, the kept text."""
    spark = docs.sparkSession
    small_batches(spark)
    # 128 bits name a row, and rows that are equal anyway, however often a doc_id or null occurs
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("doc_key", F.xxhash64(F.lit("row"), "doc_id", F.lit("of"), "text")).withColumn("text_key", F.xxhash64("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    scratch, width = Scratch(spark, "substring-dedup"), sketch_width(size)
    if width <= MOST_CELLS:
        shared = spark.sparkContext.broadcast(merged_sketch(docs, window, anchor, width))
        docs = docs.withColumn("alive", F.lit(None).cast("array<long>"))
    else:
        shared = None
        docs = docs.join(surviving_anchors(docs, window, anchor, width, scratch), ["doc_key", "text_key"], "left").select("doc_id", "text", "doc_key", "text_key", "alive")

    def may_repeat(block: words.Block, batch: pa.RecordBatch) -> np.ndarray:
        return candidate_windows(block, window, anchor, shared.value if shared else None, batch.column("alive"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in words.blocks(batch.column(0)):
                start = may_repeat(block, batch)
                if len(start):
                    row = block.document()[start]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(words.run_hashes(block.hash, window)[start].view(np.int64)),
                            pa.array((words.run_hashes(block.hash, window, 1)[start] >> _U(32)).astype(np.uint32).view(np.int32)),
                            batch.column(1).take(pa.array(block.rows[row])),
                            batch.column(2).take(pa.array(block.rows[row])),
                            pa.array(start - block.first[row], pa.int32()),
                        ],
                        ["h1", "h2", "doc_key", "text_key", "start"],
                    )

    found = docs.select("text", "doc_key", "text_key", "alive").mapInArrow(windows, "h1 long, h2 int, doc_key long, text_key long, start int")
    # from a table: the hot windows are looked at before the join
    repeated = scratch.keep(found.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated")
    least = max(HOT, (repeated.agg(F.sum("n")).first()[0] or 0) // MOST_HOT + 1)
    hot = F.broadcast(repeated.where(F.col("n") >= least).select("h1", "h2", F.lit(SALTS).alias("parts")))  # at most MOST_HOT rows
    salted = found.join(hot, ["h1", "h2"], "left").withColumn("salt", F.when(F.col("parts").isNotNull(), F.pmod("text_key", "parts")).otherwise(0).cast("int")).drop("parts")
    targets = repeated.select("h1", "h2", F.explode(F.sequence(F.lit(0), F.when(F.col("n") >= least, SALTS - 1).otherwise(0))).alias("salt"))
    hits = salted.join(targets, ["h1", "h2", "salt"], "left_semi")
    # one row's windows: as many as it has words, once each for rows that are equal
    hits = hits.groupBy("doc_key", "text_key").agg(F.collect_set("start").alias("starts"))

    names = ["doc_id", "n_words", "n_removed", "kept_sha256", *(["text"] if with_text else [])]
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text

    def finished(texts: list[bytes], starts: list) -> list[list]:
        """The result columns but doc_id: windows at ``starts`` go."""
        out: list[list] = [[] for _ in names[1:]]
        for text, at in zip(texts, starts, strict=True):
            all_words = text.split()
            kept = all_words
            if at:
                kept, done, at = [], 0, np.unique(np.array(at, np.int64))
                first = np.flatnonzero(np.diff(at, prepend=at[0] - window - 1) > window)  # of each covered stretch
                for a, b in zip(at[first].tolist(), (at[np.append(first[1:], len(at)) - 1] + window).tolist(), strict=True):
                    kept += all_words[done:a]
                    done = b
                kept += all_words[done:]
            joined = b" ".join(kept)
            row = [len(all_words), len(all_words) - len(kept), hashlib.sha256(joined).hexdigest(), *([joined.decode("utf-8", "replace")] if with_text else [])]
            for column, x in zip(out, row, strict=True):
                column.append(x)
        return out

    def binary(column: pa.Array) -> list[bytes]:
        return column.cast(pa.binary()).to_pylist()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows without a candidate window are finished; the others keep their text for the join."""
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            may = np.zeros(batch.num_rows, bool)
            for block in words.blocks(batch.column(1)):
                may[block.rows[np.unique(block.document()[may_repeat(block, batch)])]] = True
            for rows, candidate in ((np.flatnonzero(~may), False), (np.flatnonzero(may), True)):
                if len(rows):
                    part = batch.take(pa.array(rows))
                    if candidate:
                        result = [pa.nulls(len(rows), k) for k in kinds[: len(names) - 1]]
                        text = part.column(1)
                    else:
                        result = [pa.array(x, k) for x, k in zip(finished(binary(part.column(1)), [None] * len(rows)), kinds, strict=False)]
                        text = pa.nulls(len(rows), pa.string())
                    yield pa.RecordBatch.from_arrays([part.column(0), text, part.column(2), part.column(3), *result], ["doc_id", "whole", "doc_key", "text_key", *names[1:]])

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            todo = batch.column("whole").is_valid()
            yield batch.filter(pc.invert(todo)).select(names)
            if (part := batch.filter(todo)).num_rows:
                result = finished(binary(part.column("whole")), part.column("starts").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x, part.schema.field(n).type) for n, x in zip(names[1:], result, strict=True))], names)

    told = docs.mapInArrow(split, "doc_id long, whole string, doc_key long, text_key long, " + schema.partition(", ")[2])
    return told.join(hits, ["doc_key", "text_key"], "left").select("doc_id", "whole", "starts", *names[1:]).mapInArrow(removed, schema)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
