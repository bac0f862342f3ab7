"""Decontamination where texts and items repeat themselves: brute force on few distinct words, and memory."""

from __future__ import annotations

import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import decontamination, words

from . import brute


@pytest.mark.parametrize("expanded", [3, 1 << 18])
def test_few_distinct_words(monkeypatch, expanded):
    monkeypatch.setattr(decontamination, "EXPANDED", expanded)
    rng = random.Random(expanded)
    for _ in range(30):
        say = lambda n: " ".join(rng.choice("ab" if rng.random() < 0.9 else "c") for _ in range(n))  # noqa: E731, B023
        texts = [say(rng.randint(0, 60)) for _ in range(rng.randint(1, 12))]
        items = [(i, say(rng.randint(0, 30))) for i in range(rng.randint(0, 12))]
        tests = decontamination.TestSuffixes([str(i) for i, _ in items], [t for _, t in items], 10)
        got = []
        for block in words.blocks(pa.array(texts), words.NOT_ALNUM, True):
            hit, document, item = decontamination.document_hits(block, tests)
            assert len(set(zip(document.tolist(), item.tolist(), strict=True))) == len(document)
            for row in range(len(block.rows)):
                ids = {x for d, i in zip(document.tolist(), item.tolist(), strict=True) if d == row for x in tests.ids[i]}
                got.append((int(block.rows[row]), int(hit[block.first[row] : block.first[row + 1]].sum()), ids))
        want = {r[0]: r for r in brute.contamination(list(enumerate(texts)), items, 10)}
        assert [(i, n) for i, n, _ in got] == [(i, want[i][2]) for i in range(len(texts))]
        assert [len(ids) for _, _, ids in got] == [want[i][3] for i in range(len(texts))]


def test_memory_follows_the_text(spark):
    """A text of many equal words and items of many equal words don't multiply."""
    tests = decontamination.TestSuffixes([str(i) for i in range(40)], ["x " * 500 + "y " * i for i in range(40)], 10)
    text = pa.array(["x " * 300_000])
    tracemalloc.start()
    for block in words.blocks(text, words.NOT_ALNUM, True, decontamination.SHARD_BYTES):
        hit, document, item = decontamination.document_hits(block, tests)
        assert hit.all() and len(item) == 40 and not document.any()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6
    docs = spark.createDataFrame([(1, "x " * 30_000), (2, "z")], "doc_id long, text string")
    benchmark = spark.createDataFrame([("a", "x " * 200), ("b", "x " * 200 + "q")], "item_id string, text string")
    rows = {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in decontamination.contamination(docs, benchmark).collect()}
    assert rows == {1: (30_000, 2), 2: (0, 0)}
    long = decontamination.longest_matches(docs, benchmark.where("item_id = 'a'"))
    # the first suffix lies at every place that has 200 words behind it
    assert long.where("item_word = 0").agg(F.count(F.lit(1)), F.max("length")).first()[:] == (30_000 - 199, 200)
