"""Benchmark decontamination: training suffix arrays searched with every test suffix.

A shard is a block of documents. Only words that the benchmark has can match, so a shard's
suffix array is built, by prefix doubling, over its runs of such words. Every suffix of every
benchmark item is searched in it by binary search, one word deeper at a time, all suffixes at
once; that gives the longest verbatim match and all its places. Documents are never cut and
each lies in one shard, so a document's result is complete where it is made: no shuffle.

The benchmark is broadcast if its texts have at most ``BENCHMARK_BYTES``. A larger one is handled
in blocks of that size: the driver reads one, broadcasts it, the documents it hits are written to a
table, and it is destroyed before the next, so driver and workers hold one block at a time. The
tables' covered words and items are then united by a 128-bit hash of the text.

Equal items are searched once. Defined results: null, empty and wordless documents and items have no words and hit nothing; an
item with a null id counts under the empty id; rows are handled each on its own, so repeated
rows and null doc_ids are kept as they are; other columns don't matter; an empty benchmark hits
nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .store import Scratch, lean, small_batches

WINDOW = 10
#: Benchmark text that is broadcast at once.
BENCHMARK_BYTES = 16 << 20
#: Bytes of text in a shard.
SHARD_BYTES = 2 << 20


class TestSuffixes:
    """Every suffix of the items, as ids of a sorted vocabulary of word hashes."""

    __test__ = False

    def __init__(self, item_ids: list[str], texts: list[str | None], window: int):
        equal: dict[str, set[str]] = {}
        for i, text in zip(item_ids, texts, strict=True):
            equal.setdefault(text or "", set()).add(i)
        found = list(words.blocks(pa.array(list(equal), pa.string()), words.NOT_ALNUM, True))
        hashes = np.concatenate([b.hash for b in found] or [np.zeros(0, np.uint64)])
        sizes = np.concatenate([np.diff(b.first) for b in found] or [np.zeros(0, np.int64)])
        self.vocabulary, self.word = np.unique(hashes, return_inverse=True)
        self.item = np.repeat(np.arange(len(sizes)), sizes)  # of each suffix
        end = np.repeat(np.cumsum(sizes), sizes)
        self.length = end - np.arange(len(hashes))
        # words that a match must have: a whole window, or all of a shorter item; 0 where none begins
        size = sizes[self.item] if len(hashes) else self.length
        at_start = self.length == size
        self.need = np.where(self.length >= window, window, np.where(at_start, size, 0))
        self.least = int(self.need[self.need > 0].min()) if (self.need > 0).any() else 0
        self.ids = [sorted(x) for x in equal.values()]  # of each different text


def suffix_array(word: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of ``word`` (ids from 1; 0 ends a run) in the order of their first ``depth`` words."""
    n, rank, k = len(word), word.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while k < depth:
        behind = np.zeros(n, np.int64)
        behind[:-k] = rank[k:] if k < n else behind[:0]
        behind[word == 0] = 0
        key = rank * (int(rank.max()) + 1) + behind
        order = np.argsort(key, kind="stable")
        in_order = key[order]
        new = np.zeros(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[0], (in_order[1:] != in_order[:-1]).astype(np.int64)]))
        rank, k = new, 2 * k
        if rank.max() == n - 1:
            break
    return order


def search(word: np.ndarray, order: np.ndarray, tests: TestSuffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each test suffix: longest match, its range in the suffix array, and the range at ``need`` words."""
    n, m = len(word), len(tests.word)
    lo, hi = np.zeros(m, np.int64), np.full(m, n, np.int64)
    longest, at_need = np.zeros(m, np.int64), np.zeros((2, m), np.int64)
    active, depth = np.arange(m), 0
    padded = np.concatenate([word, np.zeros(int(tests.length.max(initial=0)) + 1, word.dtype)])

    def border(a: np.ndarray, b: np.ndarray, want: np.ndarray) -> np.ndarray:
        """The first place in a..b whose suffix has at ``depth`` a word of at least ``want``."""
        a, b = a.copy(), b.copy()
        while (on := np.flatnonzero(a < b)).size:
            mid = (a[on] + b[on]) >> 1
            less = padded[order[mid] + depth] < want[on]
            a[on[less]] = mid[less] + 1
            b[on[~less]] = mid[~less]
        return a

    while len(active):
        want = tests.word[active + depth] + 1
        a = border(lo[active], hi[active], want)
        b = border(a, hi[active], want + 1)
        on = b > a
        active, a, b = active[on], a[on], b[on]
        lo[active], hi[active] = a, b
        depth += 1
        longest[active] = depth
        whole = tests.need[active] == depth
        at_need[:, active[whole]] = a[whole], b[whole]
        active = active[tests.length[active] > depth]
    return longest, lo, hi, at_need[0], at_need[1]


def shard_matches(block: words.Block, tests: TestSuffixes):
    """(words, places, suffix array, result of ``search``) of a shard's runs of benchmark words.

    ``places``: index of each kept word in the block.
    """
    at = np.searchsorted(tests.vocabulary, block.hash)
    at[at == len(tests.vocabulary)] = 0
    known = tests.vocabulary[at] == block.hash if len(tests.vocabulary) else np.zeros(len(at), bool)
    edge = np.ones(len(known) + 1, bool)
    edge[1:-1] = known[1:] != known[:-1]
    edge[block.first] = True
    start = np.flatnonzero(edge)
    size = np.diff(start)
    keep = known[start[:-1]] & (size >= tests.least) if len(size) else np.zeros(0, bool)
    run, size = start[:-1][keep], size[keep]
    # a 0 behind each run
    upto = np.cumsum(size + 1)
    word, places = np.zeros(int(upto[-1]) if len(upto) else 0, np.int64), np.full(int(upto[-1]) if len(upto) else 0, -1, np.int64)
    into = np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)
    places[into] = np.repeat(run - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    word[into] = at[places[into]] + 1
    if not len(word):
        return None
    order = suffix_array(word, int(tests.length.max()))
    return word, places, order, search(word, order, tests)


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, value) of all values lo[i] .. hi[i] - 1."""
    n = hi - lo
    index = np.repeat(np.arange(len(lo)), n)
    return index, np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


#: Expanded rows that are held at once where repeats in texts and items meet.
EXPANDED = 1 << 18


def _pieces(size: np.ndarray, most: int = EXPANDED) -> Iterator[slice]:
    """Slices of rows that expand to ``size`` others each, about ``most`` in all (one row may have more)."""
    total, a = np.cumsum(size), 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, "right")))
        yield slice(a, b)
        a = b


def document_hits(block: words.Block, tests: TestSuffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(is each word of the block hit, document of each hit pair, item of each hit pair); pairs are distinct.

    Equal windows have one range in the suffix array, so each is expanded once, however often items
    have it: a place has one window of a length at most. Documents and items meet by way of distinct
    windows, some at a time.
    """
    none = np.zeros(len(block.hash), bool), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not tests.least or (found := shard_matches(block, tests)) is None:
        return none
    _, places, order, (_, _, _, lo, hi) = found
    at = np.flatnonzero(hi > lo)
    if not len(at):
        return none
    (lo, hi, need), window = np.unique(np.stack([lo[at], hi[at], tests.need[at]]), axis=1, return_inverse=True)
    item_pairs = np.unique(window * len(tests.ids) + tests.item[at])  # (window, item)
    item_window, item_of = item_pairs // len(tests.ids), item_pairs % len(tests.ids)
    first_item = np.searchsorted(item_window, np.arange(len(lo) + 1))
    change, document, pairs = np.zeros(len(block.hash) + 1, np.int64), block.document(), np.zeros(0, np.int64)
    for size in np.unique(need):
        those = np.flatnonzero(need == size)
        index, place = _ranges(lo[those], hi[those])  # places at most
        first = places[order[place]]
        change += np.bincount(first, minlength=len(change)) - np.bincount(first + size, minlength=len(change))
        met = np.unique(those[index] * len(block.rows) + document[first])  # (window, document)
        which, of = met // len(block.rows), met % len(block.rows)
        for part in _pieces(first_item[which + 1] - first_item[which]):
            row, entry = _ranges(first_item[which[part]], first_item[which[part] + 1])
            pairs = np.union1d(pairs, of[part][row] * len(tests.ids) + item_of[entry])
    return np.cumsum(change)[:-1] > 0, pairs // len(tests.ids), pairs % len(tests.ids)


def benchmark_blocks(benchmark: DataFrame, window: int, most_bytes: int) -> Iterator[TestSuffixes]:
    """The benchmark's suffixes, one object for each ``most_bytes`` of its texts, made when it is asked for."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    ids, texts, size, n = [], [], 0, 0
    for row in rows.toLocalIterator():  # a partition at a time
        ids.append(row["item_id"] or "")
        texts.append(row["text"])
        size += len((row["text"] or "").encode())
        if size >= most_bytes:
            yield TestSuffixes(ids, texts, window)
            ids, texts, size, n = [], [], 0, n + 1
    if ids or not n:
        yield TestSuffixes(ids, texts, window)


RESULT = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
_RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _result(doc_id: pa.Array, n_words: np.ndarray, n_hit: np.ndarray, items: list) -> pa.RecordBatch:
    digest = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]
    return pa.RecordBatch.from_arrays([doc_id, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(digest, pa.string()), pa.array(n_hit > 0)], RESULT)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_bytes: int = BENCHMARK_BYTES, keep_clean: bool = False) -> DataFrame:
    """For each row doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    ``keep_clean``: instead the uncontaminated rows of ``docs`` with all their columns.
    """
    spark = docs.sparkSession
    small_batches(spark)
    if (benchmark.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0) > most_bytes:
        return _contamination_in_blocks(docs, benchmark, window, most_bytes, keep_clean)
    shared = spark.sparkContext.broadcast(next(benchmark_blocks(benchmark, window, most_bytes + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = shared.value
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            for block in words.blocks(batch.column(batch.schema.get_field_index("text")), words.NOT_ALNUM, True, SHARD_BYTES):
                hit, document, item = document_hits(block, tests)
                n_hit = np.diff(np.concatenate([[0], np.cumsum(hit)])[block.first])
                clean[block.rows] = n_hit == 0
                if not keep_clean:
                    items: list[set] = [set() for _ in block.rows]
                    for d, i in zip(document.tolist(), item.tolist(), strict=True):
                        items[d].update(tests.ids[i])
                    yield _result(batch.column(0).take(pa.array(block.rows)), np.diff(block.first), n_hit, items)
            if keep_clean:
                yield batch.filter(pa.array(clean))

    if keep_clean:
        return docs.mapInArrow(lean(run), docs.schema)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), _RESULT)


def _text_key() -> list:
    """128 bits of the text, as two columns."""
    text = F.col("text").cast("string")
    return [F.xxhash64(text).alias("_k1"), F.xxhash64(F.lit("again"), text).alias("_k2")]


def _contamination_in_blocks(docs: DataFrame, benchmark: DataFrame, window: int, most_bytes: int, keep_clean: bool) -> DataFrame:
    """As ``contamination``, one pass over the texts for each block of the benchmark."""
    spark = docs.sparkSession
    scratch, found = Scratch(spark, "decontamination"), None
    keyed = docs.select(F.col("text").cast("string").alias("text"), *_text_key())
    for tests in benchmark_blocks(benchmark, window, most_bytes):
        shared = spark.sparkContext.broadcast(tests)
        del tests

        def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tests = shared.value  # noqa: B023
            for batch in batches:
                for block in words.blocks(batch.column(0), words.NOT_ALNUM, True, SHARD_BYTES):
                    hit, document, item = document_hits(block, tests)
                    if not hit.any():
                        continue
                    edge = np.zeros(len(hit) + 1, bool)
                    edge[block.first] = True
                    padded = np.concatenate([[False], hit, [False]])
                    first = np.flatnonzero(hit & (edge[:-1] | ~padded[:-2]))
                    last = np.flatnonzero(hit & (edge[1:] | ~padded[2:])) + 1
                    of = block.document()[first]
                    rows = np.unique(of)
                    border = np.append(np.searchsorted(of, rows), len(of)).astype(np.int32)
                    start = block.first[of]
                    ids: list[list[str]] = [[] for _ in block.rows]
                    for d, i in zip(document.tolist(), item.tolist(), strict=True):
                        ids[d] += tests.ids[i]
                    at = pa.array(block.rows[rows])
                    lists = [pa.ListArray.from_arrays(pa.array(border), pa.array((x - start).astype(np.int32))) for x in (first, last)]
                    yield pa.RecordBatch.from_arrays([batch.column(1).take(at), batch.column(2).take(at), *lists, pa.array([ids[d] for d in rows], pa.list_(pa.string()))], ["_k1", "_k2", "first", "last", "ids"])

        part = keyed.mapInArrow(lean(hits), "_k1 long, _k2 long, first array<int>, last array<int>, ids array<string>").dropDuplicates(["_k1", "_k2"])
        part = scratch.keep(part, "hits")
        shared.destroy()
        found = part if found is None else found.unionByName(part)
    # a row for each block at most
    joined = lambda c: F.flatten(F.collect_list(c)).alias(c)
    found = scratch.keep(found.groupBy("_k1", "_k2").agg(joined("first"), joined("last"), F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids")), "all-hits")
    if keep_clean:
        return docs.select("*", *_text_key()).join(found, ["_k1", "_k2"], "left_anti").select(docs.columns)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in words.blocks(batch.column(0), words.NOT_ALNUM, True):
                rows = pa.array(block.rows)
                yield pa.RecordBatch.from_arrays([batch.column(1).take(rows), batch.column(2).take(rows), batch.column(3).take(rows), pa.array(np.diff(block.first), pa.int64())], ["doc_id", "_k1", "_k2", "n_words"])

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_hit, items = [], []
            for first, last, ids in zip(*(batch.column(c).to_pylist() for c in ("first", "last", "ids")), strict=True):
                upto = covered = 0
                for a, b in sorted(zip(first or (), last or (), strict=True)):
                    covered += max(0, b - max(a, upto))
                    upto = max(upto, b)
                n_hit.append(covered)
                items.append(ids or [])
            yield _result(batch.column("doc_id"), batch.column("n_words").to_numpy(), np.array(n_hit, np.int64), items)

    counted = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), *_text_key()).mapInArrow(lean(count), "doc_id long, _k1 long, _k2 long, n_words long")
    return counted.join(found, ["_k1", "_k2"], "left").select("doc_id", "n_words", "first", "last", "ids").mapInArrow(lean(unite), _RESULT)


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, item_id, item_word, doc_word, length: where each test suffix's longest match of its shard lies.

    Only matches of a whole window, or of a whole shorter item, are told; of equal items one.
    The benchmark's blocks are handled one after the other, each in a table of its own.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch, out = Scratch(spark, "longest-matches"), None
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    for tests in benchmark_blocks(benchmark, window, BENCHMARK_BYTES):
        shared = spark.sparkContext.broadcast(tests)
        del tests

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tests = shared.value  # noqa: B023
            for batch in batches:
                for block in words.blocks(batch.column(1), words.NOT_ALNUM, True, SHARD_BYTES):
                    if not tests.least or (found := shard_matches(block, tests)) is None:
                        continue
                    _, places, order, (longest, lo, hi, _, _) = found
                    told = np.flatnonzero((tests.need > 0) & (longest >= tests.need))
                    of_word = block.document()
                    for part in _pieces(hi[told] - lo[told]):
                        index, place = _ranges(lo[told[part]], hi[told[part]])
                        suffix, first = told[part][index], places[order[place]]
                        document = of_word[first]
                        begin = np.searchsorted(tests.item, tests.item[suffix])
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(pa.array(block.rows[document])), pa.array([tests.ids[i][0] for i in tests.item[suffix]], pa.string()), pa.array(suffix - begin, pa.int64()), pa.array(first - block.first[document], pa.int64()), pa.array(longest[suffix], pa.int64())],
                            ["doc_id", "item_id", "item_word", "doc_word", "length"],
                        )

        part = scratch.keep(texts.mapInArrow(lean(run), "doc_id long, item_id string, item_word long, doc_word long, length long"), "matches")
        shared.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
