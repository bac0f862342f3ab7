"""Maximal periodic runs of words, and documents with each run cut down to its first period.

A run is a stretch of words with smallest period q (words q apart are equal), at least ``LEAST``
words and two periods long, that no neighbouring word extends. Both of two adjacent multiples of a
period, jp and (j+1)p, lie in any stretch of two periods. So for each p the grid's neighbours are
asked how far the words before and from them agree; where both together reach p, a stretch of
period p is found with its borders. The questions are longest common extensions: forward ones by
the suffix array of the words with range minima over its common prefixes, backward ones by the
same of the reversed words. Of the periods found for one stretch the smallest is its period.

A run of 12 words or more has six words that stand again one period later, and those passages
cover all of it. So arrays are built for the stretches of a document that its repeated six-word
passages cover; no run reaches beyond one, and documents without such have no run. All of it is
done on whole blocks of documents at once; words are compared by 64-bit hashes.

Defined results: null, empty and wordless texts have no runs and an empty collapsed text;
documents are judged row by row, so repeated rows and null doc_ids are documents like others;
texts of any length are taken whole (about 200 bytes for each word of repeated passages); runs
may overlap, and a word goes if any run has it behind its first period; other columns are passed
through; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from . import words
from .store import small_batches

#: Fewest words of a run, and words of a passage that each run repeats.
LEAST, PASSAGE = 12, 6
#: Neighbours on the grid asked at once.
ASKED = 1 << 19
#: Places in a block of the range minima.
_CELL = 16


class RangeMinimum:
    """The least of values[l..r]: minima within cells from both sides, and of 2**k cells from each cell."""

    def __init__(self, values: np.ndarray):
        n = -(-max(len(values), 1) // _CELL) * _CELL
        self.values = np.full(n, np.iinfo(np.int32).max, np.int32)
        self.values[: len(values)] = values
        cells = self.values.reshape(-1, _CELL)
        self.up = np.minimum.accumulate(cells, 1).ravel()
        self.down = np.minimum.accumulate(cells[:, ::-1], 1)[:, ::-1].ravel()
        self.levels = [cells.min(1)]
        while len(self.levels[-1]) > 1 << (len(self.levels) - 1):
            last, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-step], last[step:]))

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For left <= right, place by place."""
        a, b = left // _CELL, right // _CELL
        out = np.minimum(self.down[left], self.up[right])
        between = b - a - 1
        for k, level in enumerate(self.levels):
            which = np.flatnonzero((between >= 1 << k) & (between < 2 << k))
            if len(which):
                first, last = a[which] + 1, b[which] - (1 << k)
                out[which] = np.minimum(out[which], np.minimum(level[first], level[last]))
        inside = np.flatnonzero(a == b)
        if len(inside):
            least, at, till = self.values[left[inside]].copy(), left[inside].copy(), right[inside]
            for _ in range(_CELL - 1):
                np.minimum(at + 1, till, out=at)
                np.minimum(least, self.values[at], out=least)
            out[inside] = least
        return out


def suffix_array(symbols: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, rank of each); a suffix ends at ``end`` of its place.

    Prefixes double; only suffixes that are still equal to another one are sorted again.
    """
    n = len(symbols)
    _, rank, count = np.unique(symbols, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - count)[rank].astype(np.int64)  # the first place of its group
    order = np.argsort(rank, kind="stable")
    sorted_rank = rank[order]
    same = sorted_rank[1:] == sorted_rank[:-1]
    open_ = np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same])) if n else np.zeros(0, np.int64)
    k = 1
    while len(open_):
        at = order[open_]
        behind = at + k
        key = rank[at] * (n + 1) + np.where(behind < end[at], rank[np.minimum(behind, n - 1)] + 1, 0)
        o = np.argsort(key, kind="stable")
        order[open_], key = at[o], key[o]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        group = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        rank[at[o]] = open_[group]
        alone = new & np.concatenate([new[1:], [True]])
        open_ = open_[~alone]
        k *= 2
    return order, rank


def common_prefixes(symbols: np.ndarray, end: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each rank, how many symbols its suffix shares with the one before; from a place to the next at most one is lost."""
    n, out = len(symbols), np.zeros(len(symbols), np.int32)
    before = np.concatenate([[-1], order[:-1]])[rank] if n else order
    s, e, b, got, h = symbols.tolist(), end.tolist(), before.tolist(), [0] * n, 0
    for i in range(n):
        j = b[i]
        if j < 0:
            h = 0
            continue
        most = min(e[i] - i, e[j] - j)
        while h < most and s[i + h] == s[j + h]:
            h += 1
        got[i] = h
        if h:
            h -= 1
    out[rank] = got
    return out


class Extension:
    """How many symbols agree from two places on, within their ends."""

    def __init__(self, symbols: np.ndarray, end: np.ndarray):
        order, self.rank = suffix_array(symbols, end)
        self.least = RangeMinimum(common_prefixes(symbols, end, order, self.rank))

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """For x != y."""
        a, b = self.rank[x], self.rank[y]
        return self.least(np.minimum(a, b) + 1, np.maximum(a, b))


def grid(size: np.ndarray, asked: int = ASKED) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(stretch, period, jp) for all periods up to half of a stretch, in pieces of about ``asked``."""
    half = size // 2
    stretch = np.repeat(np.arange(len(size)), half)
    period = np.arange(len(stretch)) - np.repeat(np.cumsum(half) - half, half) + 1
    pairs = (size[stretch] - 1) // period
    total = np.cumsum(pairs)
    a = 0
    while a < len(pairs):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + asked, "right")))
        n = pairs[a:b]
        j = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        p = np.repeat(period[a:b], n)
        yield np.repeat(stretch[a:b], n), p, j * p
        a = b


def runs_of(symbols: np.ndarray, first: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of the runs inside each stretch first[i] .. first[i + 1] - 1, by start, then end."""
    n, size = len(symbols), np.diff(first)
    begin, end = np.repeat(first[:-1], size), np.repeat(first[1:], size)
    forward = Extension(symbols, end)
    backward = Extension(symbols[::-1], n - begin[::-1])
    found = []
    for stretch, p, at in grid(size):
        x = first[stretch] + at
        y = x + p
        ahead = forward(x, y)
        back = np.zeros(len(x), np.int64)
        some = np.flatnonzero(at > 0)
        back[some] = backward(n - x[some], n - y[some])
        good = (ahead + back >= p) & (ahead + back + p >= least)
        if good.any():
            found.append(np.stack([x[good] - back[good], y[good] + ahead[good], p[good]]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, till, period = np.unique(np.concatenate(found, 1), axis=1)  # sorted by start, end, period
    smallest = np.concatenate([[True], (start[1:] != start[:-1]) | (till[1:] != till[:-1])])
    return start[smallest], till[smallest], period[smallest]


def covered(start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in any [start, end)."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, end, -1)
    return np.cumsum(change)[:n] > 0


def repeated_stretches(block: words.Block, least: int = LEAST, passage: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the stretches of at least ``least`` words that passages covering them stand twice in their document."""
    at = words.run_starts(block.first, passage)
    n = int(block.first[-1])
    if not len(at):
        return at, at
    doc = block.document()
    key = words.mix(words.run_hashes(block.hash, passage)[at] + words.mix(doc[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    at = at[order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]]
    inside = covered(at, at + passage, n)
    change = inside & (np.concatenate([[True], ~inside[:-1]]) | np.concatenate([[True], doc[1:] != doc[:-1]]))
    first = np.flatnonzero(change)
    ends = inside & (np.concatenate([~inside[1:], [True]]) | np.concatenate([doc[1:] != doc[:-1], [True]]))
    end = np.flatnonzero(ends) + 1
    long = end - first >= least
    return first[long], end[long]


def block_runs(block: words.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of the block, by places of its words."""
    first, end = repeated_stretches(block)
    if not len(first):
        return (np.zeros(0, np.int64),) * 3
    size = end - first
    border = np.concatenate([[0], np.cumsum(size)])
    shift = np.repeat(first - border[:-1], size)
    place = np.arange(len(shift)) + shift
    _, symbols = np.unique(words.mix(block.hash[place] + words.mix(np.repeat(np.arange(1, len(size) + 1), size).astype(np.uint64))), return_inverse=True)
    start, till, period = runs_of(symbols, border)
    return place[start], place[till - 1] + 1, period


def collapsed(block: words.Block, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, border of each document) of the kept words, joined by one space."""
    start, end, doc = block.start[keep], block.end[keep], block.document()[keep]
    last = np.concatenate([doc[1:] != doc[:-1], [True]]) if len(doc) else np.zeros(0, bool)
    data = block.data
    data[block.end] = 32  # a separator stands there
    size = end - start + ~last
    place = np.repeat(start - (np.cumsum(size) - size), size)
    total = np.zeros(len(block.rows) + 1, np.int64)
    np.add.at(total, doc + 1, size)
    return data[place + np.arange(len(place))], np.cumsum(total)


RUNS = ArrayType(StructType([StructField(c, LongType()) for c in ("start", "length", "period")]))
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with ``runs`` (start, length, period; by start, then period) and ``collapsed``, the text without what repeats in them."""
    small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c not in (text, "runs", "collapsed")]
    docs = docs.select(*rest, F.col(text).cast("string").alias(text))
    schema = StructType([*docs.drop(text).schema, StructField("runs", RUNS), StructField("collapsed", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, texts = [], []
            for block in words.blocks(batch.column(len(rest))):
                n = int(block.first[-1])
                start, end, period = block_runs(block)
                keep = ~covered(start + period, end, n) if len(start) else np.ones(n, bool)
                data, border = collapsed(block, keep)
                texts.append(pa.LargeStringArray.from_buffers(len(block.rows), pa.py_buffer(border.astype(np.int64)), pa.py_buffer(data)).cast(pa.string()))
                doc = np.searchsorted(block.first, start, "right") - 1
                order = np.lexsort((period, start, doc))
                start, end, period, doc = start[order], end[order], period[order], doc[order]
                values = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start - block.first[doc], end - start, period)], fields=list(_RUN))
                lists.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(block.rows) + 1)), pa.int32()), values))
            if lists:
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.concat_arrays(lists), pa.concat_arrays(texts)], [*rest, "runs", "collapsed"])

    return docs.mapInArrow(run, schema)


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text; by a rule on doc_id the words of a tenth of the texts repeat from some place on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    word = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, word).alias("w"), g.alias("g"))
    n = F.size("w")
    a = F.col("g") % n
    rows = rows.withColumn("a", F.when(n > 0, a).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    left = n - F.col("a")
    again = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil(left / F.col("p")).cast("int")))
    new = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), F.slice(again, F.lit(1), left)), " ")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), new).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, a tenth of them with planted repeats: their runs and what is left without them."""
    out = periodic_runs(planted(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))
    out = out.withColumn("best", best)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).cast("long").alias("exponent_milli"), F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
