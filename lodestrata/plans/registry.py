"""Every query of the engine by name, with the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sql
from ..functions import text as T
from ..operators import audit, frames, ingestion, jobs, lookups, registry, retrieval, uploads
from ..operators.policy import POLICIES, VERBS, AdminCatalog, Identity, ScopedCatalog
from ..operators.policy_sql import SqlCatalog
from ..operators.store import DocumentStore
from ..operators.text_index import TextIndex
from ..operators.vector_index import VectorIndex
from ..sources import blob_files, blobs
from ..sources.shared import passing_folder, shuffled
from ..sources.tables import Tables
from ..sources.versions import RuleBroken, Versions
from ..streaming import consumer, ingest, tokens
from .oracles import ADMIN, ORACLES, TERMS, USER, VECTOR_ID

__all__ = ["ORACLES", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
QUESTION = " ".join(TERMS)


def now():
    return F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")


def query(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    QUERIES[build.__name__] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
    return build


def scoped(t: Tables, user=USER) -> ScopedCatalog:
    return ScopedCatalog(t.members(), Identity(user), t.documents().select("doc_id", "department_id"))


def query_vector(t: Tables) -> list[float]:
    return t.raw("embeddings").where(F.col("vec_id") == VECTOR_ID).select("embedding").first()[0]


# --- chunks and documents


@query
def chunk_split(t: Tables) -> DataFrame:
    return t.chunks().select("chunk_id", "doc_id", "department_id", "chunk_index", "content")


@query
def chunk_split_sql(t: Tables) -> DataFrame:
    sql.register(t.spark)
    chunks = "SELECT doc_id, source AS department_id, chunk_index, content, token_count(content) AS token_count FROM {docs}, LATERAL split_into_chunks(text, 512, 64)"
    return t.spark.sql(chunks, docs=t.raw("documents"))


@query
def chunk_token_count(t: Tables) -> DataFrame:
    # no row for each chunk: a document's counts follow from its length
    text = F.col("text")
    n = T.chunk_count(F.length(text))
    size = lambda i: F.least(F.lit(T.CHUNK), F.length(text) - i * (T.CHUNK - T.OVERLAP))
    total = F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.greatest(F.floor(size(i) / 4), F.lit(1))), F.lit(0).cast("long"), lambda s, x: s + x)
    return t.raw("documents").where(n > 0).select("doc_id", n.cast("long").alias("n_chunks"), total.alias("n_tokens"))


@query
def doc_content_hash(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", F.sha2("text", 256).alias("file_hash"), F.octet_length("text").cast("long").alias("byte_size"))


@query
def doc_dedup_per_dept(t: Tables) -> DataFrame:
    return registry.dedup_uploads(t.documents().select("doc_id", "department_id", F.sha2("text", 256).alias("file_hash")))


@query
def doc_icon(t: Tables) -> DataFrame:
    return t.documents().select("doc_id", "filename", T.icon_class(F.col("filename")).alias("icon"))


@query
def mime_default(t: Tables) -> DataFrame:
    mime = F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 1, "text/plain")
    return t.raw("events").select("event_id", T.mime_or_default(mime).alias("mime"))


@query
def legacy_hash(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", T.legacy_hash(F.col("doc_id").cast("string")).alias("file_hash"))


@query
def slugify(t: Tables) -> DataFrame:
    return t.raw("part").select("p_partkey", T.slugify(F.col("p_name"), F.md5(F.col("p_partkey").cast("string").cast("binary"))).alias("slug"))


@query
def schema_evolution(t: Tables) -> DataFrame:
    group = F.when(F.col("lang") == "en", "english").otherwise("other")
    return registry.evolve(t.raw("documents"), {"text": "content", "missing": "unused"}, {"language_group": group, "lang": "en"}, ["source", "n_chars"])


@query
def document_lookup(t: Tables) -> DataFrame:
    return lookups.find(t.documents(), F.col("doc_id") == 5).select("doc_id", "filename", "status")


@query
def document_must_exist(t: Tables) -> DataFrame:
    return lookups.must_find(t.documents(), F.col("doc_id") == 6, "document").select("doc_id", "department_id", "filename")


@query
def active_model(t: Tables) -> DataFrame:
    return lookups.active_model(t.models()).select("name", "dimension")


@query
def insert_returning(t: Tables) -> DataFrame:
    new = t.documents().select("doc_id", "department_id", F.sha2("text", 256).alias("file_hash"))
    return uploads.inserted(new, ["department_id", "file_hash"], "document_id").select("doc_id", "document_id")


# --- uploads and blobs


def _uploads(t: Tables) -> DataFrame:
    """Odd documents as uploads; the even ones are there already."""
    mime = F.when(F.col("doc_id") % 4 == 1, "text/plain").when(F.col("doc_id") % 8 == 3, "")
    return t.documents().where("doc_id % 2 = 1").select(F.col("doc_id").alias("upload_id"), "department_id", "filename", mime.alias("mime_type"), F.encode("text", "UTF-8").alias("content"))


@query
def upload_outcomes(t: Tables) -> DataFrame:
    there = t.documents().where("doc_id % 2 = 0").select("department_id", F.sha2("text", 256).alias("file_hash"))
    return uploads.outcomes(_uploads(t), there, scoped(t))


@query
def blob_round_trip(t: Tables) -> DataFrame:
    root = passing_folder(t.spark, "blobs")
    content = t.documents().select("doc_id", F.encode("text", "UTF-8").alias("content"))
    blobs.write_blobs(content, root)
    back = blobs.read_blobs(t.spark, root, content.select("doc_id", F.sha2("content", 256).alias("file_hash")))
    return back.select("doc_id", F.octet_length("content").cast("long").alias("byte_size"), blobs.lossy_text(F.col("content")).alias("text"))


@query
def blob_files_round_trip(t: Tables) -> DataFrame:
    root = passing_folder(t.spark, "blobs")
    content = t.documents().select("doc_id", F.encode("text", "UTF-8").alias("content"))
    blob_files.write_blob_files(content, root)
    back = content.select("doc_id", F.sha2("content", 256).alias("file_hash")).join(blob_files.blob_files(t.spark, root), "file_hash")
    return back.select("doc_id", "byte_size", blobs.lossy_text(F.col("content")).alias("text"))


@query
def lossy_decode(t: Tables) -> DataFrame:
    # a cut sequence before every text and a stray byte behind it
    data = F.concat(F.unhex(F.lit("E282")), F.encode("text", "UTF-8"), F.unhex(F.lit("FF")))
    return t.raw("conversations").select("conv_id", "turn", blobs.lossy_text(data).alias("text"))


@query
def adapter_file_hash(t: Tables) -> DataFrame:
    data = F.when(F.col("adapter_id") % 3 != 0, F.encode("file_path", "UTF-8"))
    return t.adapters().select("adapter_id", blobs.file_hash(data, F.col("file_path")).alias("file_hash"))


# --- policy


@query
def policy_matrix(t: Tables) -> DataFrame:
    frames_ = {"documents": t.documents(), "chunks": t.chunk_keys(), "vectors": t.chunk_vectors(), "assignments": t.assignments(), "jobs": t.jobs(), "audit_log": t.audit_log(), "departments": t.departments(), "members": t.members()}
    catalog, out = scoped(t), None
    for table, frame in frames_.items():
        # one count for each rule that the table has
        for rule in dict.fromkeys(POLICIES[table].values()):
            verbs = [v for v in VERBS if POLICIES[table].get(v) == rule]
            n = catalog.rows(table, verbs[0], frame).agg(F.count(F.lit(1)).alias("n"))
            row = n.select(F.lit(table).alias("table_name"), F.explode(F.array(*map(F.lit, VERBS))).alias("verb"), "n")
            row = row.select("table_name", "verb", F.when(F.col("verb").isin(verbs), F.col("n")).otherwise(0).alias("n"))
            out = row if out is None else out.unionByName(row)
    return out


@query
def policy_update(t: Tables) -> DataFrame:
    changes = t.documents().where("doc_id % 3 = 0").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "src3").otherwise("src5").alias("department_id"))
    return scoped(t).update_outcomes("documents", t.documents().select("doc_id", "department_id", "status"), changes, ["doc_id"])


@query
def policy_delete(t: Tables) -> DataFrame:
    docs = t.documents().select("doc_id", "department_id")
    return scoped(t).delete("documents", docs, docs.where("doc_id % 3 = 0"), ["doc_id"])


@query
def policy_denied_delete(t: Tables) -> DataFrame:
    log = t.audit_log()
    return scoped(t).delete("audit_log", log, log, ["event_id"]).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query
def own_audit_rows(t: Tables) -> DataFrame:
    return scoped(t).rows("audit_log", "select", t.audit_log())


@query
def own_memberships(t: Tables) -> DataFrame:
    return scoped(t).rows("members", "select", t.members())


@query
def admin_departments(t: Tables) -> DataFrame:
    return AdminCatalog(t.accounts(), Identity(ADMIN)).rows("departments", "select", t.departments()).orderBy("name")


@query
def visible_documents(t: Tables) -> DataFrame:
    return scoped(t).by_department(t.documents().drop("text")).select("doc_id", "department_id", "filename", "status").orderBy(F.desc("doc_id"))


@query
def visible_departments(t: Tables) -> DataFrame:
    return scoped(t).by_department(t.departments()).select("department_id", "name").orderBy("name")


@query
def visible_chunks(t: Tables) -> DataFrame:
    # the policy filters documents before they are cut into chunks
    docs = scoped(t).by_department(t.documents())
    return T.document_chunks(docs).select("chunk_id", "department_id", "content")


@query
def fail_closed(t: Tables) -> DataFrame:
    return scoped(t, " ").by_department(t.documents().drop("text")).select("doc_id", "department_id", "filename", "status")


@query
def write_check_rejects(t: Tables) -> DataFrame:
    return scoped(t).checked(t.documents().select("doc_id", "department_id")).where("not allowed").select("doc_id", "department_id")


@query
def member_counts(t: Tables) -> DataFrame:
    return t.members().groupBy("department_id").agg(F.count(F.lit(1)).alias("n"))


@query
def safe_identity(t: Tables) -> DataFrame:
    given = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" "), F.col("user_id").cast("string"))).when(F.col("event_id") % 3 == 1, "not-an-id")
    return t.raw("events").select("event_id", T.safe_identity(given).alias("identity"))


def _sql_catalog(t: Tables) -> SqlCatalog:
    def frames_of(session: SparkSession) -> dict[str, DataFrame]:
        u = Tables(session, t.sf_dir)
        return {"documents": u.documents(), "chunks": u.chunk_keys(), "vectors": u.chunk_vectors(), "assignments": u.assignments(), "jobs": u.jobs(), "audit_log": u.audit_log(), "departments": u.departments(), "members": u.members()}

    return SqlCatalog(t.spark, frames_of, lambda session: {"adapters": Tables(session, t.sf_dir).adapters()})


@query
def policy_sql_documents(t: Tables) -> DataFrame:
    return _sql_catalog(t).sql("SELECT doc_id, department_id, filename, status FROM documents", USER)


@query
def policy_sql_tables(t: Tables) -> DataFrame:
    counts = " UNION ALL ".join(f"SELECT '{name}' AS table_name, count(*) AS n FROM {name}" for name in POLICIES)
    return _sql_catalog(t).sql(counts, USER)


@query
def policy_sql_functions(t: Tables) -> DataFrame:
    return _sql_catalog(t).sql("SELECT adapter_id, current_user_id() AS me, is_member_of(concat('src', adapter_id % 20)) AS mine FROM adapters", f" {USER} ")


@query
def policy_sql_nobody(t: Tables) -> DataFrame:
    return _sql_catalog(t).sql("SELECT j.job_id, d.doc_id, current_user_id() AS me FROM jobs j JOIN documents d USING (doc_id)", "x' OR '1' = '1")


# --- retrieval


@query
def dense_topk(t: Tables) -> DataFrame:
    return retrieval.dense_leg(t.chunk_vectors(), query_vector(t))


@query
def dense_topk_batch(t: Tables) -> DataFrame:
    asked = t.raw("embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return retrieval.dense_leg_batch(t.chunk_vectors(), asked)


def _vector_index(t: Tables) -> VectorIndex:
    index = VectorIndex(Versions(t.spark, passing_folder(t.spark, "vectors")))
    index.build(t.chunk_vectors())
    return index


@query
def dense_topk_indexed(t: Tables) -> DataFrame:
    return _vector_index(t).search(query_vector(t))


@query
def dense_topk_batch_indexed(t: Tables) -> DataFrame:
    asked = t.raw("embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return _vector_index(t).search_batch(asked)


@query
def lexical_match(t: Tables) -> DataFrame:
    return retrieval.lexical_matches(t.chunks(), QUESTION)


@query
def lexical_topk(t: Tables) -> DataFrame:
    return retrieval.lexical_leg(t.chunks(), QUESTION)


def _text_index(t: Tables, analyzer: str = "simple") -> TextIndex:
    index = TextIndex(Versions(t.spark, passing_folder(t.spark, "words")), analyzer)
    index.add(t.chunks())
    return index


@query
def lexical_topk_indexed(t: Tables) -> DataFrame:
    return _text_index(t).search(QUESTION)


@query
def lexical_match_changed(t: Tables) -> DataFrame:
    # an index that went through uploads, updates, deletions and a merge has the hits of one made at once
    chunks, docs = t.chunks(), t.raw("documents").select("doc_id")
    index = TextIndex(Versions(t.spark, passing_folder(t.spark, "words")))
    index.add(chunks.where("doc_id % 2 = 0").withColumn("content", F.lower("content")))
    index.add(chunks.where("doc_id % 2 = 1").withColumn("content", F.concat("content", F.lit(" the of and"))))
    index.update(docs.where("doc_id % 2 = 1"), chunks.where("doc_id % 2 = 1"))
    index.merge()
    index.delete(docs.where("doc_id % 5 = 0"))
    return index.matches(QUESTION)


@query
def lexical_english_indexed(t: Tables) -> DataFrame:
    return _text_index(t, "english").search("the thing thing")


@query
def lexical_english(t: Tables) -> DataFrame:
    return retrieval.lexical_leg(t.chunks(), "the thing thing", analyzer="english")


@query
def rrf_fuse(t: Tables) -> DataFrame:
    return retrieval.fuse(retrieval.dense_leg(t.chunk_vectors(), query_vector(t)), retrieval.lexical_leg(t.chunks(), QUESTION))


@query
def rrf_fuse_multi_model(t: Tables) -> DataFrame:
    # a chunk with vectors of two models comes twice in the dense leg, and its shares add
    dense = retrieval.dense_leg(t.chunk_vectors(), query_vector(t))
    return retrieval.fuse(dense, dense, retrieval.lexical_leg(t.chunks(), QUESTION))


@query
def hybrid_retrieve(t: Tables) -> DataFrame:
    return retrieval.retrieve(t.chunk_vectors(), t.documents(), query_vector(t), QUESTION)


@query
def hybrid_retrieve_scoped(t: Tables) -> DataFrame:
    catalog = scoped(t)
    return retrieval.retrieve(catalog.by_department(t.chunk_vectors()), catalog.by_department(t.documents()), query_vector(t), QUESTION)


@query
def hybrid_sources(t: Tables) -> DataFrame:
    return retrieval.sources(hybrid_retrieve_scoped(t))


@query
def hybrid_context(t: Tables) -> DataFrame:
    return retrieval.context(hybrid_retrieve(t))


@query
def prompt_template(t: Tables) -> DataFrame:
    return retrieval.prompt(hybrid_context(t), QUESTION)


@query
def retrieval_provenance(t: Tables) -> DataFrame:
    dense, lexical = retrieval.dense_leg(t.chunk_vectors(), query_vector(t)), retrieval.lexical_leg(t.chunks(), QUESTION)
    best = retrieval.ranked(retrieval.fuse(dense, lexical, names=("dense", "lexical")), [F.desc("score"), "chunk_id"], retrieval.K)
    return best.select("rank", "chunk_id", "score", "dense_rank", "lexical_rank")


# --- jobs


@query
def job_claim_oldest(t: Tables) -> DataFrame:
    return jobs.claim_oldest(t.jobs().select("job_id", "doc_id", "status", "attempts", "created_at"), now())


@query
def job_claim_update(t: Tables) -> DataFrame:
    return jobs.after_claim(t.jobs(), now()).select("job_id", "status", "attempts", "started_at")


@query
def job_reap(t: Tables) -> DataFrame:
    return jobs.reap(t.jobs()).select("job_id", "doc_id", "status", "attempts", "started_at")


@query
def job_status_counts(t: Tables) -> DataFrame:
    return jobs.status_counts(t.jobs())


@query
def job_visibility(t: Tables) -> DataFrame:
    return scoped(t).by_parent(t.jobs(), t.documents().select("doc_id", "department_id"), "doc_id").select("job_id", "doc_id", "status")


@query
def job_routing(t: Tables) -> DataFrame:
    results = t.jobs().select("job_id", "doc_id", F.when(F.col("job_id") % 3 == 0, "unreadable").alias("error"))
    return jobs.route(results)[1]


@query
def job_routing_jobs(t: Tables) -> DataFrame:
    results = t.jobs().select("job_id", "doc_id", F.when(F.col("job_id") % 3 == 0, "unreadable").alias("error"))
    return jobs.route(results)[0]


@query
def job_log_state(t: Tables) -> DataFrame:
    # two events of a user are a run of that user's job: the log of changes, folded
    status = F.coalesce(*(F.when(F.col("event_type") == k, F.lit(v)) for k, v in {"view": "running", "purchase": "succeeded", "error": "failed"}.items()), F.lit("queued"))
    log = t.raw("events").select((F.col("event_id") % 1000).alias("job_id"), F.col("ts").alias("at"), status.alias("status"), F.when(F.col("event_type") == "error", F.concat(F.lit("event "), F.col("event_id").cast("string"))).alias("error"))
    return jobs.state_of(log)


# --- ingestion


def _content(t: Tables) -> DataFrame:
    return t.documents().select("doc_id", F.when(F.col("doc_id") % 11 != 0, F.encode("text", "UTF-8")).alias("content"))


def _embed(t: Tables, chunks: DataFrame) -> DataFrame:
    short = (F.col("doc_id") % 13 == 0) & (F.col("chunk_index") == 1)
    return t.embedded(chunks).withColumn("embedding", F.when(short, F.slice("embedding", 1, 63)).otherwise(F.col("embedding")))


def _ingested(t: Tables) -> ingestion.Outcome:
    """All queued jobs; every eleventh document has no bytes, the second chunk of every thirteenth a short vector."""
    return ingestion.process(t.jobs(), t.documents().select("doc_id", "department_id", "status"), _content(t), lambda chunks: _embed(t, chunks), 64, now())


@query
def ingest_jobs(t: Tables) -> DataFrame:
    return _ingested(t).jobs.select("job_id", "doc_id", "status", "attempts", "started_at", "finished_at", "error")


@query
def ingest_documents(t: Tables) -> DataFrame:
    return _ingested(t).documents.select("doc_id", "status")


@query
def ingest_chunks(t: Tables) -> DataFrame:
    return _ingested(t).chunks.select("doc_id", "department_id", "chunk_index", "content", "token_count")


@query
def ingest_vectors(t: Tables) -> DataFrame:
    return _ingested(t).vectors.select("doc_id", "chunk_index", F.size("embedding").alias("dimension"))


def _committed(t: Tables) -> DocumentStore:
    """A store with all documents and jobs, ingested as ``_ingested`` does, in one commit."""
    store = DocumentStore(t.spark, passing_folder(t.spark, "store"))
    docs = t.documents()
    store.enter(docs.select("doc_id", "department_id", "filename", T.legacy_hash(F.col("doc_id").cast("string")).alias("file_hash"), F.octet_length("text").alias("byte_size"), "status"), t.jobs())
    store.ingest(_content(t), lambda chunks: _embed(t, chunks), 64, now())
    return store


@query
def committed_jobs(t: Tables) -> DataFrame:
    return _committed(t).read("jobs").select("job_id", "doc_id", "status", "attempts", "started_at", "finished_at", "error")


@query
def committed_documents(t: Tables) -> DataFrame:
    # every tenth document is deleted again, with all that belongs to it
    store = _committed(t)
    store.delete(t.raw("documents").where("doc_id % 10 = 0").select("doc_id"))
    count = lambda name: shuffled(store.read(name).groupBy("doc_id").agg(F.count(F.lit(1)).alias(f"n_{name}")))
    rows = store.read("documents").join(count("chunks"), "doc_id", "left").join(count("vectors"), "doc_id", "left").join(count("jobs"), "doc_id", "left")
    return rows.select("doc_id", "status", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_chunks", "n_vectors", "n_jobs")))


@query
def stream_jobs(t: Tables) -> DataFrame:
    # the events' files as a stream of jobs; outcomes come back as a second stream
    root = passing_folder(t.spark, "consumer")
    stream = t.spark.readStream.schema(t.raw("events").schema).parquet(f"{t.sf_dir}/events.parque[t]")
    work = consumer.ingesting(t.documents().select("doc_id", "department_id", "status"), _content(t), lambda chunks: _embed(t, chunks), 64, now())
    consumer.run_until_settled(consumer.start_consumer(t.spark, t.jobs(stream), root, work, clock="2024-01-01 00:00:00"), t.spark, root)
    return consumer.jobs(t.spark, root).select("job_id", "doc_id", "status", "attempts", "started_at", "finished_at", "error")


@query
def latest_status(t: Tables) -> DataFrame:
    return jobs.newest_status(t.documents().select("doc_id", "status"), t.jobs())


@query
def status_label(t: Tables) -> DataFrame:
    return latest_status(t).select("doc_id", T.status_label(F.col("job_status"), F.col("status")).alias("label"))


# --- models, adapters, accounts


@query
def adapter_name(t: Tables) -> DataFrame:
    return t.adapters().select("adapter_id", T.adapter_name(F.col("file_path"), F.col("file_hash")).alias("name"))


@query
def adapters_for_user(t: Tables) -> DataFrame:
    return registry.adapters_for(t.members(), t.assignments(), t.adapters(), USER).orderBy("adapter_id", "assignment_id")


@query
def adapters_distinct_active(t: Tables) -> DataFrame:
    return t.adapters().where("is_active").select("file_path").distinct()


@query
def adapter_catalog(t: Tables) -> DataFrame:
    return t.assignments().join(t.adapters(), "adapter_id").select("assignment_id", "department_id", F.col("file_path").alias("adapter_path"), "scale", "is_active")


@query
def adapter_upsert(t: Tables) -> DataFrame:
    every = t.adapters()
    incoming = every.where("adapter_id % 3 = 0").select("adapter_id", F.concat(F.lit("v2/"), "file_path").alias("file_path"), "file_hash", F.lit("base").alias("base_model"), F.lit(8).alias("rank"), F.lit(True).alias("is_active"))
    return registry.upsert(every.where("adapter_id % 2 = 0"), incoming, ["file_hash"], ["file_path"])


@query
def assignment_upsert(t: Tables) -> DataFrame:
    existing = t.assignments().select("department_id", "adapter_id", "scale")
    return registry.upsert(existing, existing.where("adapter_id % 5 = 0").withColumn("scale", F.lit(2.0)), ["department_id", "adapter_id"], ["scale"])


def _listing(t: Tables) -> DataFrame:
    """A model server's listing: three of four adapters, each listed twice, the second entry valid."""
    loaded = t.adapters().where("adapter_id % 4 <> 0")
    return loaded.select("file_path", F.explode(F.array(F.lit(0), F.lit(1))).alias("position"), F.col("adapter_id").alias("n")).select("file_path", "position", (F.col("n") + F.col("position") * 1_000_000).alias("loaded_id"))


@query
def adapter_index_join(t: Tables) -> DataFrame:
    return t.adapters().where("is_active").join(registry.path_index(_listing(t)), "file_path").select("adapter_id", "file_path", "loaded_id")


@query
def adapter_index_skipped(t: Tables) -> DataFrame:
    return t.adapters().where("is_active").join(registry.path_index(_listing(t)), "file_path", "left_anti").select("adapter_id", "file_path")


def _new_users(t: Tables) -> DataFrame:
    return t.users().select("user_id", F.concat(F.lit("User"), F.col("user_id").cast("string")).alias("username"))


@query
def admin_bootstrap(t: Tables) -> DataFrame:
    return registry.bootstrap(t.accounts().where("not is_admin"), _new_users(t))[0]


@query
def admin_bootstrap_taken(t: Tables) -> DataFrame:
    return registry.bootstrap(t.accounts(), _new_users(t))[0]


@query
def bootstrap_departments(t: Tables) -> DataFrame:
    return registry.bootstrap(t.accounts(), _new_users(t))[1]


@query
def bootstrap_members(t: Tables) -> DataFrame:
    return registry.bootstrap(t.accounts(), _new_users(t))[2]


@query
def default_department(t: Tables) -> DataFrame:
    name = F.col("c_name")
    return t.raw("customer").select("c_custkey", F.concat(F.lower(name), F.lit("-dept")).alias("slug"), F.concat(name, F.lit("'s Department")).alias("name"), F.concat(name, F.lit("@local")).alias("email"))


@query
def department_label(t: Tables) -> DataFrame:
    named = t.departments().where("department_id <> 'src4'")
    return t.assignments().join(named, "department_id", "left").select("assignment_id", F.coalesce("name", F.lit("Unknown dept")).alias("department"))


@query
def single_active_model(t: Tables) -> DataFrame:
    return registry.activate_one(t.raw("part").select(F.col("p_brand").alias("name"), F.lit(768).alias("dimension")).distinct(), "Brand#11", 64)


@query
def seed_insert_ignore(t: Tables) -> DataFrame:
    existing = t.departments().select("department_id", F.lit("kept").alias("origin"))
    incoming = t.spark.range(1).select(F.explode(F.array(F.lit("src0"), F.lit("audit"))).alias("department_id"), F.lit("new").alias("origin"))
    return registry.insert_ignore(existing, incoming, ["department_id"])


# --- audits


@query
def dimension_audit(t: Tables) -> DataFrame:
    vectors = t.raw("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    return audit.wrong_dimensions(vectors.where("label = 3"), 768).unionByName(audit.wrong_dimensions(vectors.where("label <> 3"), 64))


@query
def unique_default_audit(t: Tables) -> DataFrame:
    return audit.several_defaults(t.assignments())


@query
def scale_audit(t: Tables) -> DataFrame:
    return audit.out_of_range(t.assignments(), "scale", 0, 1).select("assignment_id", "scale")


@query
def orphan_jobs(t: Tables) -> DataFrame:
    return audit.orphans(t.jobs(), t.raw("documents").where("doc_id % 5 <> 0"), "doc_id").select("job_id")


@query
def cascade_delete(t: Tables) -> DataFrame:
    docs = t.documents()
    _, chunks, vectors, queue = registry.cascade_delete(docs, docs.where("doc_id % 10 = 0"), t.chunk_keys(), t.chunk_vectors(), t.jobs())
    count = lambda frame, name: frame.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).select("doc_id", F.lit(name).alias("child"), "n")
    return count(chunks, "chunks").unionByName(count(vectors, "vectors")).unionByName(count(queue, "jobs"))


@query
def restricted_departments(t: Tables) -> DataFrame:
    empty = t.spark.range(1).select(F.lit("audit").alias("department_id"), F.lit("Audit").alias("name"))
    every = t.departments().unionByName(empty)
    return registry.restricted(every, every.where("department_id in ('src1', 'audit')"), t.documents())


@query
def rules_on_write(t: Tables) -> DataFrame:
    # three batches of assignments: what each breaks, counted as it is written, and what is stored in the end
    tables = Versions(t.spark, passing_folder(t.spark, "rules"))
    tables.create("assignments", "assignment_id long, department_id string, adapter_id long, scale double", [["department_id", "adapter_id"]], {"scale": "scale between 0 and 1"})
    rows, told = t.assignments(), []
    for name, part in (("within", rows.where("scale <= 1")), ("all", rows), ("again", rows.where("scale <= 1 and adapter_id % 3 = 0"))):
        try:
            tables.commit(lambda u, part=part: u.append("assignments", part))
            told.append((name, "", 0))
        except RuleBroken as error:
            told += [(name, rule, n) for rule, n in error.broken.items()]
    outcomes = t.spark.createDataFrame(told, "batch string, rule string, n long")
    return outcomes.crossJoin(F.broadcast(tables.read("assignments").agg(F.count(F.lit(1)).alias("stored"))))  # one row


@query
def columns_by_number(t: Tables) -> DataFrame:
    # files of three schemas read as one table
    tables, docs = Versions(t.spark, passing_folder(t.spark, "columns")), t.documents()
    tables.create("documents", "doc_id long, filename string, department_id string", [["doc_id"]])
    put = lambda part: tables.commit(lambda u: u.append("documents", part))
    put(docs.where("doc_id % 3 = 0"))
    tables.commit(lambda u: u.alter("documents", rename={"filename": "title"}, drop=["department_id"]))
    put(docs.where("doc_id % 3 = 1").withColumnRenamed("filename", "title"))
    tables.commit(lambda u: u.alter("documents", add="department_id int, n_chars long"))
    put(docs.where("doc_id % 3 = 2").withColumnRenamed("filename", "title").withColumn("department_id", F.lit(7)))
    return tables.read("documents").select("doc_id", "title", "department_id", "n_chars")


# --- streams


def _event_stream(t: Tables):
    """A message's words as a model server would stream them: every fifth without the mark, every seventh no JSON, word 30 stops."""

    def frame(w, i):
        good = F.concat(F.lit("data: "), F.to_json(F.struct(F.concat(w, F.lit(" ")).alias("content"), (i == 30).alias("stop"))), F.lit("\n\n"))
        return F.when(i % 5 == 4, F.concat(F.lit("event: "), w, F.lit("\n\n"))).when(i % 7 == 6, F.lit("data: {bad\n\n")).otherwise(good)

    # a line break inside a word would look like the end of a frame, but JSON escapes it
    return F.array_join(F.transform(F.split("text", " "), frame), "")


@query
def sse_assemble(t: Tables) -> DataFrame:
    return t.raw("conversations").select("conv_id", "turn", frames.answer(_event_stream(t)).alias("answer"))


@query
def sse_assemble_stream(t: Tables) -> DataFrame:
    # the same streams cut into pieces of 40 to 100 bytes, which arrive in three batches, out of order
    root, messages = passing_folder(t.spark, "tokens"), t.raw("conversations")
    ident = F.concat_ws(":", "conv_id", "turn")
    whole = messages.select(ident.alias("stream_id"), F.encode(_event_stream(t), "UTF-8").alias("b"), (40 + F.pmod(F.xxhash64("conv_id", "turn"), F.lit(61))).cast("int").alias("size"))
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("b") / F.col("size")).cast("int"))
    cut = whole.select("stream_id", "b", "size", (n - 1).alias("end"), F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    cut = cut.select("stream_id", F.col("k").cast("long").alias("piece"), F.substring("b", F.col("k") * F.col("size") + 1, F.col("size")).alias("data"), (F.col("k") == F.col("end")).alias("last"))
    cut.repartition(3, F.xxhash64("stream_id", "piece")).write.parquet(f"{root}/pieces")
    pieces = t.spark.readStream.schema(tokens.PIECE).option("maxFilesPerTrigger", 1).parquet(f"{root}/pieces")
    tokens.start_joining(t.spark, pieces, f"{root}/out", f"{root}/state").awaitTermination()
    found = tokens.answers(tokens.tokens(t.spark, f"{root}/out"))
    return messages.select("conv_id", "turn", ident.alias("stream_id")).join(found, "stream_id", "left").select("conv_id", "turn", F.coalesce("answer", F.lit("")).alias("answer"))


@query
def stream_concat(t: Tables) -> DataFrame:
    # one conversation is one row here, as a listing shows it; ``op1_chat_format`` streams long ones
    parts = F.sort_array(F.collect_list(F.struct("turn", "text")))
    return t.raw("conversations").groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("transcript"))


@query
def stream_ingest(t: Tables) -> DataFrame:
    root = passing_folder(t.spark, "stream")
    # a stream watches a folder or a pattern; a table may be one file
    files = f"{t.sf_dir}/documents.parque[t]"
    ingest.start_ingest(t.spark, files, f"{root}/out", f"{root}/state").awaitTermination()
    return ingest.ingested(t.spark, f"{root}/out").select("doc_id", "department_id", "chunk_index", "content", "token_count")
