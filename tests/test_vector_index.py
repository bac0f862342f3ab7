"""The vector index against exact search: equal results, lists and vectors that a search reads."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import retrieval
from lodestrata.operators.vector_index import VectorIndex
from lodestrata.sources.versions import Versions

SCHEMA = "chunk_id long, doc_id long, department_id string, status string, embedding array<float>"


def clustered(n, clusters, size=24, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, size))
    return centres[rng.integers(0, clusters, n)] + 0.15 * rng.normal(size=(n, size))


def frame(spark, vectors, first=0):
    rows = [(first + i, (first + i) // 4, f"d{i % 3}", "pending" if i % 17 == 0 else "ready", [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA)


def exact(vectors, asked, limit=10):
    return {(r["query_id"], r["rank"]): (r["chunk_id"], r["distance"]) for r in retrieval.dense_leg_batch(vectors, asked, limit).collect()}


def queries(spark, vectors):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "query_id long, vector array<double>")


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    vectors = frame(spark, clustered(6000, 60)).cache()
    index = VectorIndex(Versions(spark, str(tmp_path_factory.mktemp("index"))))
    index.build(vectors)
    return vectors, index


def test_exact_search_reads_few_lists(spark, indexed):
    vectors, index = indexed
    asked = queries(spark, clustered(6020, 60)[6000:])  # of the same clusters, not in the index
    got = {(r["query_id"], r["rank"]): (r["chunk_id"], r["distance"]) for r in index.search_batch(asked).collect()}
    assert got == exact(vectors, asked)
    assert index.scored < 20 * 6000 / 10  # under a tenth of the vectors for each query
    one = asked.where("query_id = 3").first()["vector"]
    assert {r["rank"]: (r["chunk_id"], r["distance"]) for r in index.search(one).collect()} == {k[1]: v for k, v in got.items() if k[0] == 3}
    assert 0 < index.lists_read < len(index.lists().sizes) / 4


def test_recall_with_few_probes(spark, indexed):
    vectors, index = indexed
    asked = queries(spark, clustered(6100, 60)[6000:])
    want = exact(vectors, asked)
    found = {(r["query_id"], r["chunk_id"]) for r in index.search_batch(asked, probes=3).collect()}
    hits = sum((q, chunk) in found for (q, _), (chunk, _) in want.items())
    assert hits >= 0.9 * len(want) and index.scored < 100 * 6000 / 10


def test_folders_of_other_lists_are_not_opened(spark, indexed):
    _, index = indexed
    plan = index.tables.read("lists").where("list in (1, 2)")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "list" in plan.split("PartitionFilters")[1].split("]")[0]
    files = index.tables.read("lists").where("list in (1, 2)").select(F.input_file_name().alias("f")).distinct().collect()
    assert files and all("list=1/" in r["f"] or "list=2/" in r["f"] for r in files)


def test_added_and_deleted_vectors(spark, tmp_path):
    index = VectorIndex(Versions(spark, str(tmp_path / "i")))
    first, more = frame(spark, clustered(800, 8)), frame(spark, clustered(400, 11, seed=9), 800)
    index.build(first)
    index.add(more)
    every, asked = first.unionByName(more), queries(spark, clustered(6, 11, seed=9))
    rows = lambda: {(r["query_id"], r["rank"]): (r["chunk_id"], r["distance"]) for r in index.search_batch(asked).collect()}
    assert rows() == exact(every, asked)
    index.delete(every.where("chunk_id % 3 = 0"))
    assert rows() == exact(every.where("chunk_id % 3 <> 0"), asked)
    only = {r["chunk_id"] for r in index.search_batch(asked, where="department_id = 'd1'").collect()}
    assert only and only <= {r["chunk_id"] for r in every.where("department_id = 'd1'").collect()}


def test_awkward_vectors(spark, tmp_path):
    rows = [(1, 1, "d", "ready", [1.0, 0.0]), (2, 1, "d", "ready", [0.0, 0.0]), (3, 1, "d", "ready", None), (4, 1, "d", "ready", [1.0, None]), (5, 1, "d", "ready", [float("nan"), 1.0]), (6, 1, "d", "ready", [2.0]), (7, 1, "d", "ready", [1.0, 0.0]), (8, 1, "d", "pending", [1.0, 0.0])]
    vectors = spark.createDataFrame(rows, SCHEMA)
    index = VectorIndex(Versions(spark, str(tmp_path / "i")))
    index.build(vectors)
    assert [(r["chunk_id"], r["distance"]) for r in index.search([2.0, 0.0]).orderBy("rank").collect()] == [(1, 0.0), (7, 0.0)]
    assert index.search([0.0, 0.0]).count() == 0 and index.search([1.0]).count() == 0
    assert {(r["query_id"], r["chunk_id"]) for r in retrieval.dense_leg_batch(vectors, queries(spark, [[2.0, 0.0], [1.0]])).collect()} == {(0, 1), (0, 7), (1, 6)}
    empty = VectorIndex(Versions(spark, str(tmp_path / "e")))
    empty.build(vectors.limit(0))
    assert empty.search([1.0, 0.0]).count() == 0


def test_blocks_of_queries(spark, monkeypatch):
    vectors = frame(spark, clustered(500, 5))
    asked = queries(spark, clustered(40, 5))
    want = exact(vectors, asked)
    monkeypatch.setattr(retrieval, "BLOCK_NUMBERS", 24 * 7)
    assert exact(vectors, asked) == want and len(want) == 400
