"""Memory and shuffles that don't follow the size of a table, a batch or a block of queries."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestrata.operators import ingestion, retrieval, text_index, vector_index
from lodestrata.sources import shared, versions


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_uncounted_sides_are_not_broadcast(spark, monkeypatch):
    docs = spark.range(7).withColumnRenamed("id", "doc_id")
    keys = spark.range(5).withColumnRenamed("id", "doc_id")
    assert "BroadcastHashJoin" in plan_of(docs.join(shared.counted(keys), "doc_id", "left_semi"))
    monkeypatch.setattr(shared, "KEYS_BROADCAST", 3)
    assert "Broadcast" not in plan_of(docs.join(shared.counted(keys), "doc_id", "left_semi"))


def test_ingestion_broadcasts_no_side(spark):
    jobs = spark.range(30).select(F.col("id").alias("job_id"), (F.col("id") % 9).alias("doc_id"), F.lit("queued").alias("status"), F.lit(0).alias("attempts"), *(F.lit(None).cast("timestamp_ntz").alias(c) for c in ("created_at", "started_at", "finished_at")), F.lit(None).cast("string").alias("error"))
    docs = spark.range(7).select(F.col("id").alias("doc_id"), F.lit("a").alias("department_id"), F.lit("pending").alias("status"))
    content = docs.select("doc_id", F.when(F.col("doc_id") != 1, F.encode(F.lit("some text"), "UTF-8")).alias("content"))
    embed = lambda c: c.withColumn("embedding", F.when(c.doc_id == 2, F.array(F.lit(1.0), F.lit(2.0))).when(c.doc_id != 3, F.array(F.lit(1.0))))
    out = ingestion.process(jobs, docs, content, embed, 1, F.lit("2024-01-01").cast("timestamp_ntz"))
    for frame in (out.jobs, out.documents, out.chunks, out.vectors):
        assert "Broadcast" not in plan_of(frame)
    errors = {1: ingestion.NO_BLOB, 2: "embedding dimension 2, expected 1", 3: "embedding dimension none, expected 1", 7: "no such document", 8: "no such document"}
    assert sorted((r["job_id"], r["error"]) for r in out.jobs.collect()) == [(i, errors.get(i % 9)) for i in range(30)]
    assert {r["doc_id"]: r["status"] for r in out.documents.collect()} == {i: "failed" if i in errors else "ready" for i in range(7)}
    assert sorted(r["doc_id"] for r in out.vectors.collect()) == sorted(r["doc_id"] for r in out.chunks.collect()) == [0, 4, 5, 6]


def test_keys_of_a_large_replacement_are_not_looked_up_by_value(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versions, "KEYS_LOOKED_UP", 3)
    tables = versions.Versions(spark, str(tmp_path))
    tables.create("t", "id long, v string", [["id"]])
    tables.commit(lambda t: t.append("t", spark.range(8).select("id", F.lit("a").alias("v"))))
    asked = []
    isin = type(F.col("id")).isin
    monkeypatch.setattr(type(F.col("id")), "isin", lambda self, *values: asked.append(values) or isin(self, *values))
    # two rows stay, so the folder written last has fewer rows than are looked up
    tables.commit(lambda t: t.replace("t", spark.range(6).select("id", F.lit("b").alias("v")), ["id"]))
    assert not asked
    tables.commit(lambda t: t.replace("t", spark.range(2).select("id", F.lit("c").alias("v")), ["id"]))
    assert len(asked) == 1
    assert sorted((r["id"], r["v"]) for r in tables.read("t").collect()) == list(enumerate("ccbbbbaa"))


def peak_of(work):
    tracemalloc.start()
    work()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak / 1e6


def test_distances_are_worked_out_in_slices():
    rng = np.random.default_rng(1)
    queries, vectors, ids = rng.normal(size=(2000, 8)), rng.normal(size=(5000, 8)), np.arange(5000)
    nearest = retrieval.Nearest(queries, 3, 9)
    assert peak_of(lambda: nearest.see(ids, vectors)) < 150  # all pairs at once: over 400 MB
    q, chunk, _ = nearest.close()
    cosine = (queries / np.linalg.norm(queries, axis=1)[:, None]) @ (vectors / np.linalg.norm(vectors, axis=1)[:, None]).T
    want = np.argsort(-cosine, axis=1, kind="stable")[:, :3]
    assert len(q) == 6000 and (chunk.reshape(-1, 3) == want).all() and nearest.scored == 10_000_000


def test_centroids_are_compared_in_slices(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, i, "a", "ready", [float(x) for x in rng.normal(size=4)]) for i in range(50)]
    frame = spark.createDataFrame(rows, "chunk_id long, doc_id long, department_id string, status string, embedding array<float>")
    centroids = rng.normal(size=(6, 4))
    centroids /= np.linalg.norm(centroids, axis=1)[:, None]
    given, asked = [], []
    monkeypatch.setattr(type(frame), "mapInArrow", lambda self, run, schema: given.append(run))
    vector_index._placed(frame, centroids)
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)] + [pa.array([r[4] for r in rows])], [*frame.columns, "v"])
    monkeypatch.setattr(retrieval, "slice_rows", lambda columns: asked.append(columns) or 7)
    (found,) = given[0](iter([batch]))
    cosine = np.array([r[4] for r in rows]) @ centroids.T / np.linalg.norm([r[4] for r in rows], axis=1)[:, None]
    assert asked == [6] and found.column("list").to_pylist() == cosine.argmax(1).tolist()
    assert np.allclose(found.column("angle"), np.arccos(cosine.max(1)))


def test_words_of_a_segment_are_not_shuffled(spark):
    chunks = spark.range(100).select(F.col("id").alias("chunk_id"), F.col("id").alias("doc_id"), F.lit("a b a").alias("content"))
    dealt = text_index._dealt(chunks, 100)
    words = dealt.select("chunk_id", "doc_id", "block", F.posexplode(F.split("content", " ")).alias("at", "term"))
    made = text_index._segment(words, "s")
    plan = plan_of(made)
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")  # the chunks, below the words
    rows = {(r["term"], r["block"]): (r["best"], len(r["hits"])) for r in made.collect()}
    assert {b for _, b in rows} == {0, 1} and rows["a", 0][0] == 2 and rows["a", 0][1] + rows["a", 1][1] == 200 and rows["b", 0][1] + rows["b", 1][1] == 100


def test_postings_of_batches_equal_a_dictionary(monkeypatch):
    monkeypatch.setattr(text_index, "WORDS", 60)
    rng = np.random.default_rng(3)
    rows = [(b * 100 + int(c), b, b, at, str(rng.choice(list("abcd")))) for b in range(12) for c in rng.permutation(7) for at in range(rng.integers(0, 9))]
    names = ["chunk_id", "doc_id", "block", "at", "term"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 25], strict=True), kinds, strict=True)], names) for i in range(0, len(rows), 25)]
    made = [r for batch in text_index._postings(iter(batches)) for r in batch.to_pylist()]
    want = {}
    for chunk, doc, block, at, term in rows:
        want.setdefault((term, block), []).append({"chunk_id": chunk, "doc_id": doc, "at": at})
    assert len(made) == len(want)
    for r in made:
        hits = sorted(want[r["term"], r["block"]], key=lambda h: (h["chunk_id"], h["at"]))
        counts = [sum(h["chunk_id"] == x["chunk_id"] for h in hits) for x in hits]
        assert r["hits"] == hits and r["best"] == max(counts)


def captured_segments(monkeypatch):
    made, real = [], text_index._segment
    monkeypatch.setattr(text_index, "_segment", lambda words, segment: made.append(real(words, segment)) or made[-1])
    return made


def test_stems_are_not_shuffled_again(spark, tmp_path, monkeypatch):
    made = captured_segments(monkeypatch)
    index = text_index.TextIndex(versions.Versions(spark, str(tmp_path)), "english")
    index.add(spark.createDataFrame([(1, 1, "ready", "Tests were running, the test ran")], "chunk_id long, doc_id long, status string, content string"))
    assert plan_of(made[0]).count("Exchange") == 1
    assert {(r["term"], tuple(h["at"] for h in r["hits"])) for r in made[0].collect()} == {("test", (0, 4)), ("run", (2,)), ("ran", (5,))}


def test_a_merge_moves_only_what_it_must(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "WHOLE", 150)
    monkeypatch.setattr(shared, "KEYS_BROADCAST", 3)
    schema = "chunk_id long, doc_id long, status string, content string"
    rows = lambda docs, word: spark.createDataFrame([(i, i, "ready", f"{word} words {i % 7}") for i in docs], schema)
    ids = lambda *docs: spark.createDataFrame([(i,) for i in docs], "doc_id long")
    index = text_index.TextIndex(versions.Versions(spark, str(tmp_path)))
    index.add(rows(range(200), "old"))
    index.add(rows(range(200, 400), "other"))
    index.add(rows(range(400, 420), "small"))
    index.update(ids(*range(200)), rows(range(200), "new"))
    index.delete(ids(405))
    made = captured_segments(monkeypatch)
    index.merge()
    # two segments are taken over, one of ten dead documents and more isn't looked at, the small one is dealt anew
    assert "SortMergeJoin" not in plan_of(made[0])
    stored = index.tables.read("postings")
    assert stored.select("segment").distinct().count() == 1 and stored.groupBy("term", "block").count().where("count > 1").count() == 0
    assert stored.where("term = 'words'").select("block").distinct().count() == 9  # of 200, 200 and 19 chunks
    want = [i for i in range(420) if i != 405]
    assert sorted(r["chunk_id"] for r in index.matches("words").collect()) == want
    assert index.matches("old").count() == 0 and index.matches("new").count() == 200 and index.matches("other").count() == 200
    assert [r["chunk_id"] for r in index.search("words 3", 500).orderBy("rank").collect()] == [i for i in want if i % 7 == 3]
    index.delete(ids(0, 250))
    index.merge()
    assert len(made) == 2 and sorted(r["chunk_id"] for r in index.matches("words").collect()) == [i for i in want if i not in (0, 250)]
