"""Rules that the queries over stored tables don't show: isolation, edge cases, streams, blobs."""

from __future__ import annotations

import hashlib
import math
import random
import threading

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.functions import lexical, sql, text
from lodestrata.functions.vectors import cosine_distance
from lodestrata.operators import frames, ingestion, jobs, lookups, policy, registry, retrieval, uploads
from lodestrata.operators.policy import Identity, PolicyError, ScopedCatalog, require_admin
from lodestrata.operators.policy_sql import SqlCatalog
from lodestrata.sources import blob_files, blobs
from lodestrata.sources.tables import Tables
from lodestrata.sources.versions import Versions
from lodestrata.streaming import ingest


def fused(spark, dense, lexical_ids):
    leg = lambda ids: spark.createDataFrame([(x, i + 1) for i, x in enumerate(ids)], "chunk_id string, rank long")
    return {r["chunk_id"]: r["score"] for r in retrieval.fuse(leg(dense), leg(lexical_ids)).collect()}


def test_fusion(spark):
    assert fused(spark, [], []) == {}
    one = fused(spark, ["x", "y", "z"], [])
    assert len(one) == 3 and one["x"] > one["y"] > one["z"]
    assert fused(spark, ["a", "b"], ["a", "b"])["a"] > fused(spark, ["a", "b"], ["a", "b"])["b"]
    assert math.isclose(fused(spark, ["a"], ["a"])["a"], 2 / 61, abs_tol=1e-9)
    tied = fused(spark, ["a", "b"], ["b", "a"])
    assert tied["a"] == tied["b"]


@pytest.fixture(scope="module")
def offices(spark):
    members = spark.createDataFrame([(1, "hr"), (2, "eng")], "user_id long, department_id string")
    documents = spark.createDataFrame([(1, "hr", "hr_secrets.pdf"), (2, "eng", "eng_blueprint.pdf")], "doc_id long, department_id string, filename string")
    return members, documents


def test_isolation(spark, offices, tmp_path):
    members, documents = offices
    seen = lambda user: [r["filename"] for r in ScopedCatalog(members, Identity(user)).by_department(documents).collect()]
    assert seen(1) == ["hr_secrets.pdf"] and seen("2") == ["eng_blueprint.pdf"]
    for nobody in (None, "", " ", "x", "1 or 1=1", 99):
        assert seen(nobody) == []
    child = spark.createDataFrame([(10, 1), (20, 2)], "job_id long, doc_id long")
    assert [r["job_id"] for r in ScopedCatalog(members, Identity(1)).by_parent(child, documents, "doc_id").collect()] == [10]
    with pytest.raises(PolicyError):
        ScopedCatalog(members, Identity(1)).write("documents", documents, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()
    ScopedCatalog(members, Identity(1)).write("documents", documents.where("department_id = 'hr'"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_every_user_sees_only_own_departments(spark, sf_dir):
    t = Tables(spark, sf_dir)
    members = {(r["user_id"], r["department_id"]) for r in t.members().collect()}
    for user in sorted({u for u, _ in members})[:5]:
        rows = ScopedCatalog(t.members(), Identity(user)).by_department(t.documents().drop("text")).collect()
        assert rows and all((user, r["department_id"]) in members for r in rows)


def test_admin(spark):
    users = spark.createDataFrame([(1, True), (2, False), (3, None)], "user_id long, is_admin boolean")
    require_admin(users, Identity(1))
    for other in (2, 3, 4, None, "x"):
        with pytest.raises(PolicyError):
            require_admin(users, Identity(other))


def windows(s, size=512, overlap=64):
    out, at = [], 0
    while s:
        out.append(s[at : at + size])
        if at + size >= len(s):
            return out
        at += size - overlap
    return out


def test_chunks(spark):
    texts = ["", *("a😀é"[i % 3] * n for i, n in enumerate((1, 64, 65, 512, 513, 960, 961, 3000))), None]
    rows = text.chunks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "text").orderBy("doc_id", "chunk_index").collect()
    got: dict = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append(r["content"])
    assert got == {i: windows(t) for i, t in enumerate(texts) if t}
    with pytest.raises(ValueError):
        text.chunk_count(F.col("text"), 10, 10)


def brute_covers(tokens, terms):
    score, last, before = 0.0, {}, -1
    for e, t in enumerate(tokens):
        if t in terms:
            last[t] = e
            if len(last) == len(terms) and min(last.values()) > before:
                before = min(last.values())
                score += 1 / (1 + (e - before + 1) - len(terms))
    return round(score, 9)


def test_cover_density(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice("abcdx") for _ in range(rng.randrange(40))]) for i in range(60)]
    frame = spark.createDataFrame(rows, "id long, tokens array<string>")
    for terms in (["a"], ["a", "b"], ["c", "a", "d"]):
        got = {r[0]: r[1] for r in frame.select("id", lexical.cover_density(F.col("tokens"), terms)).collect()}
        assert got == {i: brute_covers(t, terms) for i, t in rows}
    assert lexical.query_terms("The of AND", "english") == []
    assert frame.where(lexical.matches(F.col("tokens"), [])).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="abcdefgilnorstuy", min_size=1, max_size=14))
def test_a_stem_but_for_its_last_letter_begins_the_word(word):
    stem = lexical.stem(word)
    assert 0 < len(stem) <= len(word) and word.startswith(stem[:-1])


def test_english_analyzer(spark):
    rows = spark.createDataFrame([("The indexes of running tests",)], "content string").select(lexical.english_tokens(F.col("content"))).first()[0]
    assert rows[0] == "" and rows[2] == "" and rows[3] == lexical.stem("runs") and rows[4] == lexical.stem("test")


def test_cosine(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([1.0, 0.0], [0.0, 3.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [r[0] for r in rows.select(cosine_distance(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0, None, None]


def test_lossy_text(spark):
    rows = [(bytes.fromhex(h),) for h in ("41E28242", "41FF42", "F0908041", "C0AF", "EDA080", "68C3A9")]
    got = [r[0] for r in spark.createDataFrame(rows, "b binary").select(blobs.lossy_text(F.col("b"))).collect()]
    assert got == [b.decode("utf-8", "replace") for (b,) in rows]


def test_blobs(spark, tmp_path):
    root = str(tmp_path / "blobs")
    rows = spark.createDataFrame([(b"one",), (b"two",), (b"one",)], "content binary")
    assert {r["byte_size"] for r in blobs.write_blobs(rows, root).collect()} == {3}
    blobs.write_blobs(rows, root).collect()
    assert spark.read.parquet(root).count() == 2
    wanted = spark.createDataFrame([(1, b"two"), (2, b"three")], "id long, c binary").select("id", F.sha2("c", 256).alias("file_hash"))
    assert {r["id"]: r["content"] and bytes(r["content"]) for r in blobs.read_blobs(spark, root, wanted).collect()} == {1: b"two", 2: None}
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "a.gguf").write_bytes(b"abc")
    assert blobs.read_files(spark, str(tmp_path / "files")).first()["byte_size"] == 3
    named = spark.createDataFrame([(None, "p")], "content binary, path string").select(blobs.file_hash(F.col("content"), F.col("path"))).first()[0]
    assert named.startswith("path:")


def test_blob_files(spark, tmp_path):
    root = str(tmp_path / "blobs")
    rows = spark.createDataFrame([(f"blob {i % 40}".encode(),) for i in range(100)] + [(None,), (b"",)], "content binary").repartition(4)
    writers = [threading.Thread(target=blob_files.write_blob_files, args=(rows, root)) for _ in range(2)]
    for w in writers:
        w.start()
    for w in writers:
        w.join(60)
    names = [p.name for p in (tmp_path / "blobs").glob("*/*") if not p.name.endswith(".crc")]
    assert len(names) == 41 and not any(n.startswith(".") for n in names)  # one copy of each
    wanted = sorted(names)[:10]
    for p in (tmp_path / "blobs").glob("*/*"):
        if p.name not in wanted:
            p.chmod(0)
            p.unlink()  # the others' files aren't needed
            p.with_name(p.name).mkdir()  # and would fail if they were opened
    got = blob_files.blob_files(spark, root).where(F.col("file_hash").isin([*wanted, "no such hash"])).collect()
    assert sorted(r["file_hash"] for r in got) == wanted and all(hashlib.sha256(r["content"]).hexdigest() == r["file_hash"] and r["byte_size"] == len(r["content"]) for r in got)
    assert blob_files.blob_files(spark, root).where(F.col("file_hash") == wanted[3]).where("byte_size > 100").count() == 0
    assert blob_files.blob_files(spark, root).where("byte_size >= 0").count() == 10
    assert blob_files.blob_files(spark, str(tmp_path / "none")).count() == 0


def test_functions_for_sql(spark):
    sql.register(spark)
    texts = ["", *("a😀é"[i % 3] * n for i, n in enumerate((1, 64, 65, 512, 513, 960, 961, 3000))), None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = spark.sql("SELECT doc_id, chunk_index, content FROM {docs}, LATERAL split_into_chunks(text, 512, 64)", docs=docs)
    assert sorted(map(tuple, rows.collect())) == sorted((i, k, c) for i, t in enumerate(texts) if t for k, c in enumerate(windows(t)))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Join" not in plan
    assert [tuple(r) for r in spark.sql("SELECT chunk_count(961, 512, 64), token_count('abc'), mime_or_default(''), safe_identity(' 7'), safe_identity('x')").collect()] == [(3, 1, "application/octet-stream", 7, None)]
    with pytest.raises(Exception, match="overlap"):
        spark.sql("SELECT * FROM split_into_chunks('abc', 10, 10)").collect()


def test_names(spark):
    row = spark.createDataFrame([("a/b\\x.gguf.gguf", "0123456789", "  Ünï Team--7 ", "3", "A.PDF")], "p string, h string, n string, i string, f string")
    got = row.select(text.adapter_name(F.col("p"), F.col("h")), text.slugify(F.col("n"), F.col("h")), text.safe_identity(F.col("i")), text.icon_class(F.col("f"))).first()
    assert tuple(got) == ("x-01234567", "n-team-7-01234567", 3, "pdf")


def test_frames(spark):
    stream = 'data: {"content":"a","stop":false}\n\nevent: x\n\ndata: {bad\n\n\n\ndata: {"content":"b"}\n\ndata: {"content":"!","stop":true}\n\ndata: {"content":"late"}\n\n'
    rows = spark.createDataFrame([(stream,), ("",), ('data: {"content":"c"}\n\n',)], "s string")
    assert [r[0] for r in rows.select(frames.answer(F.col("s"))).collect()] == ["ab!", "", "c"]


def test_upsert_and_routing(spark):
    old = spark.createDataFrame([("h1", "p1", "n1"), ("h2", "p2", "n2")], "h string, path string, name string")
    new = spark.createDataFrame([("h2", "q2", "m2"), ("h3", "q3", "m3")], "h string, path string, name string")
    assert sorted(map(tuple, registry.upsert(old, new, ["h"], ["path"]).collect())) == [("h1", "p1", "n1"), ("h2", "q2", "n2"), ("h3", "q3", "m3")]
    with pytest.raises(Exception, match="more than once"):
        registry.upsert(old, new.unionByName(new), ["h"], ["path"]).collect()
    results = spark.createDataFrame([(1, 1, None), (2, 2, "bad"), (3, 2, None)], "job_id long, doc_id long, error string")
    job_rows, docs = jobs.route(results)
    assert {r["job_id"]: r["status"] for r in job_rows.collect()} == {1: "succeeded", 2: "failed", 3: "succeeded"}
    assert {r["doc_id"]: r["status"] for r in docs.collect()} == {1: "ready", 2: "ready"}
    none = spark.createDataFrame([], "job_id long, doc_id long, status string, attempts int, created_at timestamp")
    assert jobs.claim_oldest(none, F.lit(None).cast("timestamp")).count() == 0


def test_stream_replay(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    landing, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    spark.createDataFrame([(1, "x" * 600, "en", "s", 600), (2, None, "en", "s", 0)], schema).write.mode("append").parquet(landing)
    for _ in range(2):  # a second run finds nothing new
        ingest.start_ingest(spark, landing, target, state).awaitTermination()
        assert ingest.ingested(spark, target).where("doc_id = 1").count() == 2
    spark.createDataFrame([(1, "y", "en", "s", 1), (3, "z", "en", "s", 1)], schema).write.mode("append").parquet(landing)
    ingest.start_ingest(spark, landing, target, state).awaitTermination()
    assert {(r["doc_id"], r["content"]) for r in ingest.ingested(spark, target).collect()} == {(1, "y"), (3, "z")}
    # the state is lost: everything is done again and nothing is doubled
    ingest.start_ingest(spark, landing, target, str(tmp_path / "state2")).awaitTermination()
    rows = ingest.ingested(spark, target).select("doc_id", "chunk_index").collect()
    assert len(rows) == len(set(rows))


def test_stream_ingest_of_vectors_and_repeats(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    landing, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    rows = [(1, "x" * 600, "en", "s", 600), (1, "a", "en", "s", 1), (2, "y" * 600, "en", "s", 600), (3, "z", "en", "t", 1), (None, "q", "en", "s", 1)]
    spark.createDataFrame(rows, schema).write.parquet(landing)
    # the second chunk of document 2 gets a short vector
    embed = lambda c: c.withColumn("embedding", F.when((F.col("doc_id") == 2) & (F.col("chunk_index") == 1), F.array(F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(2.0))))
    ingest.start_ingest(spark, landing, target, state, embed, 2).awaitTermination()
    states = {r["doc_id"]: (r["department_id"], r["status"], r["error"]) for r in ingest.ingested(spark, target, "states").collect()}
    assert states == {1: ("s", "ready", None), 2: ("s", "failed", "embedding dimension 1, expected 2"), 3: ("t", "ready", None)}
    for name in ("chunks", "vectors"):
        assert sorted((r["doc_id"], r["chunk_index"]) for r in ingest.ingested(spark, target, name).collect()) == [(1, 0), (1, 1), (3, 0)]


# Examples of Porter's paper.
STEMS = (
    "caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop falling fall "
    "hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration digitizer digit vietnamization vietnam operator oper feudalism feudal "
    "decisiveness decis hopefulness hope callousness callous triplicate triplic formalize formal electrical electr goodness good revival reviv allowance allow airliner airlin adjustable adjust "
    "replacement replac dependent depend adoption adopt homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll"
).split()


def test_porter_stems():
    assert [lexical.stem(w) for w in STEMS[::2]] == STEMS[1::2]


def test_update_and_delete_policies(spark):
    members = spark.createDataFrame([(1, "hr"), (2, "eng")], "user_id long, department_id string")
    docs = spark.createDataFrame([(1, "hr", "a"), (2, "hr", "b"), (3, "eng", "c")], "doc_id long, department_id string, title string")
    catalog = policy.ScopedCatalog(members, policy.Identity(1), docs)
    renamed = spark.createDataFrame([(1, "new"), (3, "new"), (9, "new")], "doc_id long, title string")
    assert sorted(map(tuple, catalog.update("documents", docs, renamed, ["doc_id"]).collect())) == [(1, "hr", "new"), (2, "hr", "b"), (3, "eng", "c")]
    moved = spark.createDataFrame([(1, "eng")], "doc_id long, department_id string")
    with pytest.raises(policy.PolicyError):
        catalog.update("documents", docs, moved, ["doc_id"])
    assert sorted(r["doc_id"] for r in catalog.delete("documents", docs, docs, ["doc_id"]).collect()) == [3]
    jobs_ = spark.createDataFrame([(7, 1), (8, 3)], "job_id long, doc_id long")
    assert [r["job_id"] for r in catalog.rows("jobs", "update", jobs_).collect()] == [7] and catalog.rows("jobs", "delete", jobs_).isEmpty()
    assert catalog.delete("jobs", jobs_, jobs_, ["job_id"]).count() == 2
    log = spark.createDataFrame([(1, 1), (2, 2)], "event_id long, user_id long")
    assert [r["event_id"] for r in catalog.rows("audit_log", "insert", log).collect()] == [1] and catalog.rows("audit_log", "update", log).isEmpty()
    nobody = policy.ScopedCatalog(members, policy.Identity(" "), docs)
    assert all(nobody.rows(t, v, f).isEmpty() for t, v, f in (("documents", "select", docs), ("jobs", "select", jobs_), ("audit_log", "select", log), ("members", "select", members)))


def test_admin_and_ingest_catalogs(spark):
    users = spark.createDataFrame([(1, True), (2, False), (3, None)], "user_id long, is_admin boolean")
    assert policy.AdminCatalog(users, policy.Identity(1)).rows("departments", "insert", users).count() == 3
    for user in (2, 3, 4, None, "x"):
        with pytest.raises(policy.PolicyError):
            policy.AdminCatalog(users, policy.Identity(user))
    assert policy.IngestCatalog().rows("chunks", "insert", users).count() == 3
    for table, verb in (("members", "select"), ("documents", "insert"), ("jobs", "delete"), ("chunks", "upsert")):
        with pytest.raises(policy.PolicyError):
            policy.IngestCatalog().rows(table, verb, users)
    with pytest.raises(policy.PolicyError):
        policy.AdminCatalog(users, policy.Identity(1)).rows("departments", "truncate", users)


def test_writes_go_by_the_table(spark, tmp_path):
    members = spark.createDataFrame([(1, "hr")], "user_id long, department_id string")
    docs = spark.createDataFrame([(10, "hr"), (20, "eng")], "doc_id long, department_id string")
    catalog = policy.ScopedCatalog(members, policy.Identity(1), docs)
    hr = spark.createDataFrame([(1, "hr", 10)], "user_id long, department_id string, doc_id long")
    tables = Versions(spark, str(tmp_path / "t"))
    for table in policy.POLICIES:
        tables.create(table, "user_id long, department_id string, doc_id long")
    for table, rules in policy.POLICIES.items():
        if "insert" in rules:
            catalog.write(table, hr, str(tmp_path / table))
            catalog.insert(tables, table, hr)
            assert tables.read(table).count() == spark.read.parquet(str(tmp_path / table)).count() == 1
            assert catalog.denied(table, "insert", hr).isEmpty()
        for bad in (hr.select(F.lit(2).cast("long").alias("user_id"), F.lit("eng").alias("department_id"), F.lit(20).cast("long").alias("doc_id")), hr.select(*(F.lit(None).cast(d).alias(c) for c, d in hr.dtypes)), *([] if "insert" in rules else [hr])):
            before = tables.newest().number
            with pytest.raises(policy.PolicyError):
                catalog.write(table, hr.unionByName(bad), str(tmp_path / f"bad-{table}"))
            with pytest.raises(policy.PolicyError):
                catalog.insert(tables, table, bad)
            assert not (tmp_path / f"bad-{table}").exists() and tables.newest().number == before


def test_sql_catalog(spark, offices):
    members, documents = offices
    jobs_ = [(7, 1), (8, 2), (9, None)]

    def frames_of(session):
        again = lambda frame: session.createDataFrame(frame.collect(), frame.schema)
        return {"members": again(members), "documents": again(documents), "jobs": session.createDataFrame(jobs_, "job_id long, doc_id long"), "departments": session.createDataFrame([("hr",), ("eng",)], "department_id string")}

    catalog = SqlCatalog(spark, frames_of)
    names = lambda user: [r["filename"] for r in catalog.sql("SELECT filename FROM documents", user).collect()]
    assert names(1) == ["hr_secrets.pdf"] and names(" 2 ") == ["eng_blueprint.pdf"]
    for nobody in (None, "", " ", "x", "1' OR '1' = '1", "\\", 99):
        assert names(nobody) == []
    assert catalog.session.sql("SELECT * FROM documents").count() == 0  # nobody's unless asked for somebody
    alice = catalog.sql("SELECT job_id, current_user_id() AS me, is_member_of('hr') AS hr, is_member_of('eng') AS eng FROM jobs WHERE doc_id >= :low", 1, low=0)
    assert names(2) == ["eng_blueprint.pdf"] and [tuple(r) for r in alice.collect()] == [(7, 1, True, False)]  # a query keeps its identity
    assert [r["department_id"] for r in catalog.sql("SELECT * FROM departments", 2).collect()] == ["eng"]
    joined = "SELECT d.filename, m.user_id FROM documents d JOIN members m USING (department_id) WHERE is_member_of(d.department_id) OR current_user_id() IS NULL"
    assert [tuple(r) for r in catalog.sql(joined, 1).collect()] == [("hr_secrets.pdf", 1)]
    with pytest.raises(PolicyError):
        catalog.scoped(1).require("departments", "insert", catalog.frames["departments"])
    with pytest.raises(ValueError):
        SqlCatalog(spark, frames_of, frames_of)
    assert "documents" not in [t.name for t in spark.catalog.listTables()]
    plan = catalog.sql("SELECT doc_id FROM documents", 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan


def test_bootstrap_looks_at_existing_administrators(spark):
    new = spark.createDataFrame([(7, "Ann"), (8, "Bob")], "user_id long, username string")
    for existing, want in (([], {7: True, 8: False}), ([(1, False)], {7: True, 8: False}), ([(1, True)], {7: False, 8: False}), ([(1, None)], {7: True, 8: False})):
        users, departments, members = registry.bootstrap(spark.createDataFrame(existing, "user_id long, is_admin boolean"), new)
        assert {r["user_id"]: r["is_admin"] for r in users.collect()} == want
    assert {tuple(r) for r in departments.collect()} == {("ann-dept", "Ann's Department", "ann-dept"), ("bob-dept", "Bob's Department", "bob-dept")}
    assert {tuple(r) for r in members.collect()} == {(7, "ann-dept"), (8, "bob-dept")}


def test_lookups(spark):
    models = spark.createDataFrame([("b", True), ("a", True), ("c", False)], "name string, is_active boolean")
    assert lookups.find(models, F.col("name") == "z").count() == 0 and lookups.active_model(models).first()["name"] == "a"
    with pytest.raises(LookupError):
        lookups.must_find(models, F.col("name") == "z", "model")
    with pytest.raises(LookupError):
        lookups.active_model(models.where("not is_active"))


def test_departments_with_documents_stay(spark):
    departments = spark.createDataFrame([("a",), ("b",)], "department_id string")
    docs = spark.createDataFrame([(1, "a")], "doc_id long, department_id string")
    members = spark.createDataFrame([(1, "a"), (1, "b")], "user_id long, department_id string")
    with pytest.raises(ValueError):
        registry.delete_departments(departments, departments, docs, members)
    left = registry.delete_departments(departments, departments.where("department_id = 'b'"), docs, members)
    assert [[tuple(r) for r in t.collect()] for t in left] == [[("a",)], [(1, "a")]]


def test_upload_to_ingested(spark, tmp_path):
    members = spark.createDataFrame([(1, "hr")], "user_id long, department_id string")
    there = spark.createDataFrame([], "department_id string, file_hash string")
    rows = [(1, "hr", "a.txt", "", b"caf\\xe9 " * 200), (2, "hr", "b.txt", None, b"caf\\xe9 " * 200), (3, "eng", "c.txt", "text/plain", b"x"), (4, "hr", "d.txt", "text/plain", b"yy")]
    incoming = spark.createDataFrame(rows, "upload_id long, department_id string, filename string, mime_type string, content binary")
    catalog, root, now = policy.ScopedCatalog(members, policy.Identity(1)), str(tmp_path / "blobs"), F.lit("2024-01-01").cast("timestamp_ntz")
    assert {r["upload_id"]: r["outcome"] for r in uploads.outcomes(incoming, there, catalog).collect()} == {1: "queued", 2: "duplicate", 3: "denied", 4: "queued"}
    docs, queue = uploads.upload(incoming, there, catalog, root, now)
    docs, queue = docs.withColumnRenamed("document_id", "doc_id"), queue.withColumnRenamed("document_id", "doc_id")
    assert spark.read.parquet(root).count() == 2 and {r["mime_type"] for r in docs.collect()} == {"application/octet-stream", "text/plain"}
    content = blobs.read_blobs(spark, root, docs.select("doc_id", "file_hash")).select("doc_id", "content")
    # the second chunk of the long document gets a short vector
    embed = lambda chunks: chunks.withColumn("embedding", F.when(F.col("chunk_index") == 1, F.array(F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(2.0))))
    out = ingestion.process(queue, docs, content, embed, 2, now)
    states = {r["filename"]: r["status"] for r in out.documents.collect()}
    assert states == {"a.txt": "failed", "d.txt": "ready"}
    assert {(r["status"], r["attempts"], r["error"]) for r in out.jobs.collect()} == {("failed", 1, "embedding dimension 1, expected 2"), ("succeeded", 1, None)}
    assert [r["content"] for r in out.chunks.collect()] == ["yy"] and out.vectors.count() == 1
    lost = ingestion.process(queue, docs, content.where("false"), embed, 2, now)
    assert {r["error"] for r in lost.jobs.collect()} == {ingestion.NO_BLOB} and lost.chunks.isEmpty()
    fine = ingestion.process(queue, docs, content, embed, 1, now)
    assert {r["status"] for r in fine.documents.collect()} == {"failed"}  # the first chunks are too long now


def test_job_log(spark):
    log = [(1, 1, "queued", None), (1, 2, "running", None), (1, 3, "queued", None), (1, 4, "running", None), (1, 5, "failed", "bad"), (2, 1, "queued", None), (2, 2, "running", None), (2, 3, "queued", None)]
    rows = {r["job_id"]: r for r in jobs.state_of(spark.createDataFrame(log, "job_id long, at long, status string, error string")).collect()}
    assert tuple(rows[1])[1:] == ("failed", "bad", 2, 4, 5) and tuple(rows[2])[1:] == ("queued", None, 1, None, None)


def test_batch_search_equals_single_searches(spark):
    vectors = spark.createDataFrame([(i, "ready" if i % 7 else "pending", [float(i % 5), float(i % 3), 1.0] if i % 11 else None) for i in range(300)] + [(999, "ready", [1.0])], "chunk_id long, status string, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [0.0, 0.0, 0.0]), (3, [4.0, 0.0, 1.0]), (4, None)], "query_id long, vector array<double>")
    got = {}
    for r in retrieval.dense_leg_batch(vectors, asked).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["chunk_id"], r["distance"])
    for query, vector in ((1, [1.0, 2.0, 3.0]), (3, [4.0, 0.0, 1.0])):
        assert got[query] == {r["rank"]: (r["chunk_id"], r["distance"]) for r in retrieval.dense_leg(vectors, vector).collect()}
    assert set(got) == {1, 3}
