"""Tables that change together: commits, races, killed writers, rules, schemas."""

from __future__ import annotations

import threading

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import policy
from lodestrata.operators.store import DocumentStore
from lodestrata.sources import shared
from lodestrata.sources.versions import Conflict, RuleBroken, Versions


@pytest.fixture
def tables(spark, tmp_path):
    made = Versions(spark, str(tmp_path / "tables"))
    made.create("chunks", "doc_id long, content string")
    made.create("jobs", "job_id long, status string")
    return made


def rows(spark, table, values):
    schema = {"chunks": "doc_id long, content string", "jobs": "job_id long, status string"}[table]
    return spark.createDataFrame(values, schema)


def test_tables_change_together(spark, tables):
    before = tables.newest()

    def work(t):
        t.append("chunks", rows(spark, "chunks", [(1, "a"), (2, "b")]))
        assert tables.read("chunks").count() == 0  # nothing is seen before the commit
        t.append("jobs", rows(spark, "jobs", [(7, "succeeded")]))

    number = tables.commit(work)
    assert number == before.number + 1
    assert tables.read("chunks").count() == 2 and tables.read("jobs").count() == 1
    assert tables.read("chunks", before).count() == 0  # a reader keeps to its version
    tables.commit(lambda t: t.overwrite("chunks", t.read("chunks").where("doc_id = 2")))
    assert [tuple(r) for r in tables.read("chunks").collect()] == [(2, "b")] and tables.read("chunks", tables.at(number)).count() == 2


def test_a_killed_writer_leaves_nothing_visible(spark, tables):
    before = tables.newest()

    def killed(t):
        t.append("chunks", rows(spark, "chunks", [(1, "a")]))
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        tables.commit(killed)
    assert tables.newest() == before
    # one that could not even clean up: its folder is there and isn't read
    rows(spark, "chunks", [(9, "z")]).write.parquet(f"{tables.root}/chunks/_commit=left")
    tables.commit(lambda t: t.append("chunks", rows(spark, "chunks", [(2, "b")])))
    assert [r["doc_id"] for r in tables.read("chunks").collect()] == [2]
    assert tables.sweep() == 1 and tables.read("chunks").count() == 1


def test_two_writers(spark, tables):
    """Appends go on behind each other; a change of what was read is worked out again."""
    begin, calls, errors = threading.Barrier(2), [], []

    def claim(name):
        def work(t):
            calls.append(name)
            mine = t.read("jobs").where("status = 'queued'").orderBy("job_id").limit(1).collect()
            if calls.count(name) == 1:
                begin.wait(60)  # both have read the same version
            t.overwrite("jobs", t.read("jobs").withColumn("status", F.when(F.col("job_id").isin([r["job_id"] for r in mine]), name).otherwise(F.col("status"))))

        try:
            tables.commit(work)
        except Exception as error:  # noqa: BLE001
            errors.append(error)

    tables.commit(lambda t: t.append("jobs", rows(spark, "jobs", [(i, "queued") for i in range(4)])))
    writers = [threading.Thread(target=claim, args=(n,)) for n in ("ann", "bob")]
    for w in writers:
        w.start()
    for w in writers:
        w.join(120)
    assert not errors and sorted(calls) in (["ann", "ann", "bob"], ["ann", "bob", "bob"])
    taken = sorted(r["status"] for r in tables.read("jobs").collect())
    assert taken == ["ann", "bob", "queued", "queued"]

    def other(t):
        t.append("chunks", rows(spark, "chunks", [(1, "a")]))
        if len(calls) < 5:
            calls.extend(["x"] * 5)
            tables.commit(lambda u: u.append("chunks", rows(spark, "chunks", [(2, "b")])))  # a faster one

    before = tables.newest().number
    assert tables.commit(other) == before + 2
    assert {r["doc_id"] for r in tables.read("chunks").collect()} == {1, 2}


def test_giving_up(spark, tables):
    def always_late(t):
        t.read("jobs")
        tables.commit(lambda u: u.append("jobs", rows(spark, "jobs", [(1, "queued")])))
        t.append("jobs", rows(spark, "jobs", [(2, "queued")]))

    with pytest.raises(Conflict):
        tables.commit(always_late, tries=2)
    assert {r["job_id"] for r in tables.read("jobs").collect()} == {1}


@pytest.mark.parametrize("links", [True, False])
def test_one_gets_the_name(spark, tmp_path, links):
    path, got = str(tmp_path / "log" / "1.json"), []
    assert shared.put_if_absent(spark, path, "first", links) and not shared.put_if_absent(spark, path, "second", links)
    assert shared.read_text(spark, path) == "first"
    if links:
        writers = [threading.Thread(target=lambda i=i: got.append((i, shared.put_if_absent(spark, str(tmp_path / "log" / "2.json"), str(i))))) for i in range(8)]
        for w in writers:
            w.start()
        for w in writers:
            w.join(60)
        winners = [i for i, ok in got if ok]
        assert len(winners) == 1 and shared.read_text(spark, str(tmp_path / "log" / "2.json")) == str(winners[0])
    assert [n for n in shared.names_in(spark, str(tmp_path / "log")) if not n.endswith(".crc")] == (["1.json", "2.json"] if links else ["1.json"]) or set(n for n in shared.names_in(spark, str(tmp_path / "log"))) >= {"1.json"}


def test_rules(spark, tmp_path):
    tables = Versions(spark, str(tmp_path / "t"))
    schema = spark.createDataFrame([], "dept string, hash string, scale float, n long").schema
    schema["dept"].nullable = False
    tables.create("adapters", schema, unique=[["dept", "hash"]], checks={"scale from 0 to 2": "scale between 0 and 2"})
    put = lambda *values: tables.commit(lambda t: t.append("adapters", spark.createDataFrame(values, "dept string, hash string, scale float, n long")))
    put(("a", "h1", 1.0, 1), ("a", "h2", None, 2), ("b", "h1", 2.0, 3), ("a", None, 0.0, 4), ("a", None, 0.0, 5))
    before = tables.newest()
    for bad, rule in (
        ([("c", "x", 2.5, 1)], "scale from 0 to 2"), ([(None, "x", 1.0, 1)], "dept is not null"), ([("c", "x", 1.0, 1), ("c", "x", 1.0, 2)], "unique (dept, hash)"),
        ([("c", "x", 1.0, 1), ("a", "h1", 1.0, 2)], "unique (dept, hash)"),
    ):
        with pytest.raises(RuleBroken) as error:
            put(*bad)
        assert set(error.value.broken) == {rule}
    assert tables.newest() == before and tables.read("adapters").count() == 5
    assert len([n for n in shared.names_in(spark, f"{tables.root}/adapters") if n.startswith("_commit")]) == 1  # nothing is left of bad batches
    many = spark.range(1500).select(F.lit("m").alias("dept"), F.col("id").cast("string").alias("hash"))
    tables.commit(lambda t: t.append("adapters", many))
    with pytest.raises(RuleBroken):
        tables.commit(lambda t: t.append("adapters", many.where("id >= 1499 or id < 1200")))
    with pytest.raises(RuleBroken):  # within one transaction too
        tables.commit(lambda t: [t.append("adapters", many.withColumn("dept", F.lit(d))) for d in ("x", "x")])
    assert tables.read("adapters").count() == 1505


def test_columns_by_number(spark, tmp_path):
    tables = Versions(spark, str(tmp_path / "t"))
    tables.create("documents", "doc_id long, filename string, lang string", unique=[["doc_id"]])
    put = lambda sql: tables.commit(lambda t: t.append("documents", spark.sql(sql)))
    put("select 1L as doc_id, 'a.txt' as filename, 'en' as lang")
    tables.commit(lambda t: t.alter("documents", rename={"filename": "title"}, drop=["lang"]))
    put("select 2L as doc_id, 'b.txt' as title")
    # a new column with a dropped one's name is another column
    tables.commit(lambda t: t.alter("documents", add="lang int, file_hash string"))
    put("select 3L as doc_id, 'c.txt' as title, 7 as lang, 'h' as file_hash")
    assert sorted(map(tuple, tables.read("documents").collect())) == [(1, "a.txt", None, None), (2, "b.txt", None, None), (3, "c.txt", 7, "h")]
    assert tables.read("documents", tables.at(2)).columns == ["doc_id", "filename", "lang"]
    assert [r["doc_id"] for r in tables.read("documents").where("title > 'a.txt'").orderBy("doc_id").collect()] == [2, 3]
    with pytest.raises(ValueError):
        tables.commit(lambda t: t.alter("documents", drop=["doc_id"]))
    tables.commit(lambda t: t.merge_folders("documents"))
    assert len(tables.newest().tables["documents"].folders) == 1 and tables.read("documents").count() == 3


def test_rows_replaced_and_deleted(spark, tmp_path):
    tables = Versions(spark, str(tmp_path / "t"))
    tables.create("jobs", "job_id long, status string", unique=[["job_id"]])
    for a in (0, 10, 20):
        tables.commit(lambda t, a=a: t.append("jobs", rows(spark, "jobs", [(a + i, "queued") for i in range(3)])))
    before = tables.newest().tables["jobs"].folders
    tables.commit(lambda t: t.replace("jobs", rows(spark, "jobs", [(11, "running"), (50, "queued")]), ["job_id"]))
    after = tables.newest().tables["jobs"].folders
    assert before[0] in after and before[2] in after and before[1] not in after  # only what was touched is written anew
    state = {r["job_id"]: r["status"] for r in tables.read("jobs").collect()}
    assert state == {**{a + i: "queued" for a in (0, 10, 20) for i in range(3)}, 11: "running", 50: "queued"}
    with pytest.raises(RuleBroken):
        tables.commit(lambda t: t.replace("jobs", rows(spark, "jobs", [(1, "a"), (1, "b")]), ["job_id"]))
    gone = spark.createDataFrame([(0,), (1,), (2,), (21,), (99,)], "job_id long")

    def work(t):
        t.append("jobs", rows(spark, "jobs", [(99, "new"), (98, "new")]))
        t.delete("jobs", gone)

    tables.commit(work)
    assert sorted(r["job_id"] for r in tables.read("jobs").collect()) == [10, 11, 12, 20, 22, 50, 98]
    none = rows(spark, "jobs", [])
    number = tables.commit(lambda t: [t.delete("jobs", none.select("job_id")), t.replace("jobs", none, ["job_id"])])
    assert tables.read("jobs", tables.at(number)).count() == 7


def test_document_store(spark, tmp_path):
    members = spark.createDataFrame([(1, "hr")], "user_id long, department_id string")
    catalog, now = policy.ScopedCatalog(members, policy.Identity(1)), F.lit("2024-01-01").cast("timestamp_ntz")
    files = lambda *rows: spark.createDataFrame(rows, "upload_id long, department_id string, filename string, mime_type string, content binary")
    store, root = DocumentStore(spark, str(tmp_path / "store")), str(tmp_path / "blobs")
    told = {r["upload_id"]: (r["outcome"], r["doc_id"]) for r in store.upload(files((1, "hr", "a", "", b"x" * 600), (2, "hr", "b", "", b"x" * 600), (3, "hr", "c", "", b"yy")), catalog, root, now).collect()}
    assert [told[i][0] for i in (1, 2, 3)] == ["queued", "duplicate", "queued"]
    assert {r["doc_id"] for r in store.read("documents").collect()} == {told[1][1], told[3][1]} and store.read("jobs").where("status = 'queued'").count() == 2
    before = store.tables.newest()
    with pytest.raises(policy.PolicyError):
        store.upload(files((4, "hr", "d", "", b"new"), (5, "eng", "e", "", b"other")), catalog, root, now)
    assert store.tables.newest() == before
    assert [r["outcome"] for r in store.upload(files((6, "hr", "f", "", b"yy")), catalog, root, now).collect()] == ["duplicate"]
    content = spark.createDataFrame([(told[1][1], b"x" * 600), (told[3][1], None)], "doc_id long, content binary")
    embed = lambda chunks: chunks.withColumn("embedding", F.array(F.lit(1.0), F.lit(2.0)))
    number = store.tables.newest().number
    assert store.ingest(content, embed, 2, now) == number + 1  # one version has all of it
    assert store.read("chunks").count() == store.read("vectors").count() == 2
    assert {r["doc_id"]: r["status"] for r in store.read("documents").collect()} == {told[1][1]: "ready", told[3][1]: "failed"}
    # ingested again after a retry, the chunks are not doubled
    store.tables.commit(lambda t: t.replace("jobs", t.read("jobs").withColumn("status", F.lit("running")), ["job_id"]))
    store.ingest(content, embed, 2, now)
    assert store.read("chunks").count() == 2 and {r["attempts"] for r in store.read("jobs").collect()} == {2}
    store.delete(spark.createDataFrame([(told[1][1],)], "doc_id long"))
    assert [store.read(n).count() for n in ("documents", "jobs", "chunks", "vectors")] == [1, 1, 0, 0]
    again = DocumentStore(spark, str(tmp_path / "store"))
    assert again.read("documents").count() == 1
