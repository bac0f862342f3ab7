"""The index of words against a search of all chunks, through changes, and the blocks that it reads."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lodestrata.operators import retrieval
from lodestrata.operators.text_index import TextIndex
from lodestrata.sources.versions import Versions

SCHEMA = "chunk_id long, doc_id long, status string, content string"
WORDS = ["running", "runs", "tests", "tested", "index", "indexes", "happy", "the", "of", "cat"]


def chunks(spark, rng, docs, first=0):
    rows = []
    for doc in range(first, first + docs):
        for i in range(rng.randint(0, 3)):
            rows.append((doc * 10 + i, doc, "ready" if rng.random() < 0.9 else "pending", " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 30)))))
    return spark.createDataFrame(rows, SCHEMA)


def scan(frame, query, analyzer, limit=10):
    return [(r["chunk_id"], r["score"]) for r in retrieval.lexical_leg(frame, query, limit, analyzer).orderBy("rank").collect()]


def hits(index, query, limit=10):
    return [(r["chunk_id"], r["score"]) for r in index.search(query, limit).orderBy("rank").collect()]


def test_changes_equal_a_rebuild(spark, tmp_path):
    rng = random.Random(1)
    for analyzer, queries in (("simple", ("running index", "the", "cat of", "absent cat", "")), ("english", ("run index", "the of", "tests happy"))):
        index = TextIndex(Versions(spark, str(tmp_path / analyzer)), analyzer)
        first, more = chunks(spark, rng, 60), chunks(spark, rng, 60, 60)
        index.add(first)
        index.add(more)
        changed = chunks(spark, rng, 20, 50)
        docs = spark.range(50, 70).withColumnRenamed("id", "doc_id")
        index.update(docs, changed)
        gone = spark.range(0, 200, 7).withColumnRenamed("id", "doc_id")
        index.delete(gone)
        now = first.unionByName(more).join(docs, "doc_id", "left_anti").select(first.columns).unionByName(changed).join(gone, "doc_id", "left_anti").select(first.columns).cache()
        want = {q: scan(now, q, analyzer) for q in queries}
        assert {q: hits(index, q) for q in queries} == want and any(want.values())
        every = {q: sorted(map(tuple, index.matches(q).collect())) for q in queries}
        assert every == {q: sorted(map(tuple, retrieval.lexical_matches(now, q, analyzer).collect())) for q in queries}
        index.merge()
        assert {q: hits(index, q) for q in queries} == want and index.tables.read("dead").count() == 0
        index.delete(spark.range(3, 4).withColumnRenamed("id", "doc_id"))
        assert hits(index, queries[0]) == scan(now.where("doc_id <> 3"), queries[0], analyzer)


def test_blocks_that_cannot_win_are_not_read(spark, tmp_path):
    # words that are rare in most chunks, and many in a few
    rng = random.Random(3)
    rows = [(i, i, "ready", " ".join(["alpha", "beta"] + ["x"] * 20 if rng.random() < 0.99 else ["alpha", "beta"] * 8)) for i in range(8000)]
    frame = spark.createDataFrame(rows, SCHEMA)
    index = TextIndex(Versions(spark, str(tmp_path / "i")))
    index.add(frame)
    assert hits(index, "alpha beta") == scan(frame, "alpha beta", "simple")
    assert index.blocks == 125 and index.blocks_read <= index.blocks * 0.6
    # ties at the border are all looked at
    even = frame.withColumn("content", F.lit("alpha beta gamma"))
    tied = TextIndex(Versions(spark, str(tmp_path / "t")))
    tied.add(even)
    assert hits(tied, "alpha beta") == [(i, 1.0) for i in range(10)]


def test_no_python_in_a_search(spark, tmp_path):
    index = TextIndex(Versions(spark, str(tmp_path / "i")), "english")
    index.add(spark.createDataFrame([(1, 1, "ready", "Tests were running")], SCHEMA))
    plan = index.matches("test running")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "PartitionFilters" in plan
    empty = TextIndex(Versions(spark, str(tmp_path / "e")))
    assert hits(empty, "anything") == []
    empty.add(spark.createDataFrame([], SCHEMA))
    empty.merge()
    assert hits(empty, "anything") == []
