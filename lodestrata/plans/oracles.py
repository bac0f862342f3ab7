"""DuckDB SQL for the queries, written independently of the Spark plans."""

from __future__ import annotations

DOCS = """docs AS (
    SELECT doc_id, source AS department_id,
        'doc-' || doc_id || (CASE doc_id % 6 WHEN 0 THEN '.txt' WHEN 1 THEN '.pdf' WHEN 2 THEN '.docx' WHEN 3 THEN '.xls' WHEN 4 THEN '.PPTX' ELSE '.bin' END) AS filename,
        CASE WHEN doc_id % 17 = 0 THEN 'pending' ELSE 'ready' END AS status, text
    FROM documents)"""
CHUNKS = """chunks AS (
    SELECT doc_id * 8388608 + chunk_index AS chunk_id, doc_id, department_id, filename, status, chunk_index, substring(text, chunk_index * 448 + 1, 512) AS content
    FROM (SELECT *, unnest(range(0, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, CAST(ceil((length(text) - 64) / 448.0) AS BIGINT)) END)) AS chunk_index FROM docs WHERE text IS NOT NULL))"""
MEMBERS = "members AS (SELECT DISTINCT user_id, 'src' || ((user_id + k) % 20) AS department_id FROM events, (VALUES (0), (7)) AS shifts(k))"
KEYS = """keys AS (
    SELECT doc_id * 8388608 + chunk_index AS chunk_id, doc_id, department_id, status, chunk_index
    FROM (SELECT *, unnest(range(0, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, CAST(ceil((length(text) - 64) / 448.0) AS BIGINT)) END)) AS chunk_index FROM docs WHERE text IS NOT NULL))"""
VECTORS = KEYS + """, vectors AS (
    SELECT k.chunk_id, k.doc_id, k.department_id, k.status, k.chunk_index, CAST(e.embedding AS DOUBLE[]) AS v
    FROM keys k JOIN embeddings e ON e.vec_id = (k.doc_id + k.chunk_index) % (SELECT count(*) FROM embeddings))"""
JOBS = """jobs AS (
    SELECT *, CASE WHEN status = 'queued' THEN 0 ELSE 1 END AS attempts, CASE WHEN status <> 'queued' THEN created_at END AS started_at,
        CASE WHEN status IN ('succeeded', 'failed') THEN created_at END AS finished_at, CASE WHEN status = 'failed' THEN 'unreadable' END AS error
    FROM (SELECT event_id AS job_id, event_id % (SELECT count(*) FROM documents) AS doc_id,
        CASE event_type WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'queued' END AS status, ts AS created_at FROM events))"""
ADAPTERS = """adapters AS (
    SELECT p_partkey AS adapter_id, 'models/' || replace(p_name, ' ', '_') || '-' || p_partkey || '.gguf' AS file_path,
        sha256('models/' || replace(p_name, ' ', '_') || '-' || p_partkey || '.gguf') AS file_hash, p_brand AS base_model, 8 * (p_size % 3 + 1) AS rank, p_partkey % 3 <> 0 AS is_active
    FROM part)"""
ASSIGNMENTS = """assignments AS (
    SELECT p_partkey AS assignment_id, 'src' || (p_partkey % 20) AS department_id, p_partkey AS adapter_id, CAST(p_size % 3 AS DOUBLE) AS scale, p_partkey % 40 = p_partkey % 20 AS is_default
    FROM part)"""

#: Parameters of the retrieval queries.
TERMS, VECTOR_ID, USER, ADMIN = ("the", "of", "and"), 7, 3, 1


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


def visible(frame: str, user: int = USER) -> str:
    return f"SELECT * FROM {frame} WHERE department_id IN (SELECT department_id FROM members WHERE user_id = {user})"


def dense(source: str = "vectors", name: str = "dense") -> str:
    return f"""{name}_all AS (
    SELECT chunk_id, round(1 - list_sum(list_transform(list_zip(v, q), lambda p: p[1] * p[2])) / (sqrt(list_sum(list_transform(v, lambda x: x * x))) * sqrt(list_sum(list_transform(q, lambda x: x * x)))), 9) + 0.0 AS distance
    FROM {source}, (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = {VECTOR_ID}) AS query WHERE status = 'ready'),
{name} AS (SELECT chunk_id, distance, row_number() OVER (ORDER BY distance, chunk_id) AS rank FROM {name}_all QUALIFY rank <= 10)"""


def lexical(source: str = "chunks", name: str = "lexical") -> str:
    last = ", ".join(f"max(CASE WHEN tok = '{t}' THEN pos END) OVER w AS p{i}" for i, t in enumerate(TERMS))
    tokens = f"SELECT chunk_id, unnest(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+')) AS tok, generate_subscripts(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+'), 1) AS pos FROM {source} WHERE status = 'ready'"
    terms = ", ".join(f"'{t}'" for t in TERMS)
    return f"""{name}_hits AS (SELECT * FROM ({tokens}) WHERE tok IN ({terms})),
{name}_ends AS (SELECT chunk_id, pos, {last} FROM {name}_hits WINDOW w AS (PARTITION BY chunk_id ORDER BY pos)),
{name}_covers AS (SELECT chunk_id, least(p0, p1, p2) AS b, min(pos) AS e FROM {name}_ends WHERE p0 IS NOT NULL AND p1 IS NOT NULL AND p2 IS NOT NULL GROUP BY ALL),
{name}_all AS (SELECT chunk_id, round(sum(1.0 / (1 + (e - b + 1) - 3)), 9) AS score FROM {name}_covers GROUP BY chunk_id),
{name} AS (SELECT chunk_id, score, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM {name}_all QUALIFY rank <= 10)"""


FUSED = """fused AS (
    SELECT chunk_id, round(sum(CAST(1.0 AS DOUBLE) / (60 + rank)), 12) AS score FROM (SELECT chunk_id, rank FROM dense UNION ALL SELECT chunk_id, rank FROM lexical) GROUP BY chunk_id)"""
BEST = """best AS (SELECT chunk_id, score, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM fused QUALIFY rank <= 5),
hits AS (SELECT b.rank, b.chunk_id, c.doc_id, c.filename, c.content, b.score FROM best b JOIN chunks c USING (chunk_id))"""
HYBRID = with_(DOCS, CHUNKS, VECTORS, dense(), lexical(), FUSED, BEST)
SCOPED = with_(DOCS, CHUNKS, VECTORS, MEMBERS, f"mine_v AS ({visible('vectors')})", f"mine_c AS ({visible('chunks')})", dense("mine_v"), lexical("mine_c"), FUSED, BEST)

# What becomes of the documents of queued jobs.
INGESTED = """wanted AS (SELECT DISTINCT doc_id FROM jobs WHERE status IN ('queued', 'running')),
told AS (
    SELECT doc_id, CASE WHEN text IS NULL OR doc_id % 11 = 0 THEN 'the document''s bytes are missing' WHEN doc_id % 13 = 0 AND length(text) > 512 THEN 'embedding dimension 63, expected 64' END AS error
    FROM docs WHERE doc_id IN (SELECT doc_id FROM wanted))"""

# One stream of frames for each message: its words; every fifth lacks the mark, every seventh isn't JSON, word 30 stops.
WORDS = "words AS (SELECT conv_id, turn, w, i FROM (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) - 1 AS i FROM conversations))"

LABELS = "CASE {} WHEN 'pending' THEN 'Pending' WHEN 'ready' THEN 'Ready' WHEN 'failed' THEN 'Failed' WHEN 'queued' THEN 'Queued' WHEN 'running' THEN 'Ingesting…' WHEN 'succeeded' THEN 'Done' END"
ICONS = "CASE regexp_extract(lower(filename), '[^.]*$') WHEN 'pdf' THEN 'pdf' WHEN 'doc' THEN 'document' WHEN 'docx' THEN 'document' WHEN 'xls' THEN 'sheet' WHEN 'xlsx' THEN 'sheet' WHEN 'ppt' THEN 'slides' WHEN 'pptx' THEN 'slides' WHEN 'txt' THEN 'text' WHEN 'md' THEN 'text' ELSE 'folder' END"
SLUG = "trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') || '-' || substring(md5(CAST(p_partkey AS VARCHAR)), 1, 8)"
UPSERTED = """incoming AS (SELECT adapter_id, 'v2/' || file_path AS file_path, file_hash, 'base' AS base_model, 8 AS rank, true AS is_active FROM adapters WHERE adapter_id % 3 = 0),
existing AS (SELECT * FROM adapters WHERE adapter_id % 2 = 0)"""

ORACLES: dict[str, str] = {
    "chunk_split": with_(DOCS, CHUNKS) + "SELECT chunk_id, doc_id, department_id, chunk_index, content FROM chunks",
    "chunk_token_count": with_(DOCS, CHUNKS) + "SELECT doc_id, count(*) AS n_chunks, CAST(sum(greatest(length(content) // 4, 1)) AS BIGINT) AS n_tokens FROM chunks GROUP BY doc_id",
    "doc_content_hash": "SELECT doc_id, sha256(text) AS file_hash, CAST(strlen(text) AS BIGINT) AS byte_size FROM documents",
    "doc_dedup_per_dept": "SELECT doc_id, source AS department_id, sha256(text) AS file_hash, doc_id = min(doc_id) OVER (PARTITION BY source, text) AS accepted FROM documents",
    "visible_documents": with_(DOCS, MEMBERS) + f"SELECT doc_id, department_id, filename, status FROM ({visible('docs')})",
    "visible_departments": with_(MEMBERS) + "SELECT DISTINCT m.department_id, 'Department ' || m.department_id AS name FROM members m JOIN documents d ON d.source = m.department_id WHERE user_id = 3",
    "visible_chunks": with_(DOCS, CHUNKS, MEMBERS) + f"SELECT chunk_id, department_id, content FROM ({visible('chunks')})",
    "fail_closed": with_(DOCS) + "SELECT doc_id, department_id, filename, status FROM docs WHERE false",
    "write_check_rejects": with_(DOCS, MEMBERS) + "SELECT doc_id, department_id FROM docs WHERE department_id NOT IN (SELECT department_id FROM members WHERE user_id = 3)",
    "member_counts": with_(MEMBERS) + "SELECT department_id, count(*) AS n FROM members GROUP BY department_id",
    "dense_topk": with_(DOCS, VECTORS, dense()) + "SELECT chunk_id, distance, rank FROM dense",
    "dense_topk_batch": with_(DOCS, VECTORS)
    + """, q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 50 = 0),
        every AS (SELECT query_id, chunk_id, round(1 - list_sum(list_transform(list_zip(v, q), lambda p: p[1] * p[2])) / (sqrt(list_sum(list_transform(v, lambda x: x * x))) * sqrt(list_sum(list_transform(q, lambda x: x * x)))), 9) + 0.0 AS distance FROM vectors, q WHERE status = 'ready')
        SELECT query_id, chunk_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM every QUALIFY rank <= 10""",
    "lexical_match": with_(DOCS, CHUNKS, lexical()) + "SELECT chunk_id, score FROM lexical_all",
    "lexical_topk": with_(DOCS, CHUNKS, lexical()) + "SELECT chunk_id, score, rank FROM lexical",
    "rrf_fuse": with_(DOCS, CHUNKS, VECTORS, dense(), lexical(), FUSED) + "SELECT chunk_id, score FROM fused",
    "rrf_fuse_multi_model": with_(DOCS, CHUNKS, VECTORS, dense(), lexical()) + "SELECT chunk_id, round(sum(CAST(1.0 AS DOUBLE) / (60 + rank)), 12) AS score FROM (SELECT chunk_id, rank FROM dense UNION ALL SELECT chunk_id, rank FROM dense UNION ALL SELECT chunk_id, rank FROM lexical) GROUP BY chunk_id",
    "hybrid_retrieve": HYBRID + "SELECT rank, chunk_id, doc_id, filename, content, score FROM hits",
    "hybrid_retrieve_scoped": SCOPED + "SELECT rank, chunk_id, doc_id, filename, content, score FROM hits",
    "hybrid_sources": SCOPED + "SELECT rank, doc_id, filename, substring(content, 1, 200) AS excerpt, score FROM hits",
    "hybrid_context": HYBRID + "SELECT string_agg('[Source ' || rank || '] ' || filename || chr(10) || content, chr(10) || chr(10) ORDER BY rank) AS context FROM hits",
    "prompt_template": HYBRID
    + """SELECT 'Use only the sources below; if they don''t suffice, say that.' || chr(10) || chr(10) || 'Sources:' || chr(10) || string_agg('[Source ' || rank || '] ' || filename || chr(10) || content, chr(10) || chr(10) ORDER BY rank)
        || chr(10) || chr(10) || 'Question: the of and' || chr(10) || chr(10) || 'Answer:' AS prompt FROM hits""",
    "retrieval_provenance": HYBRID + "SELECT h.rank, h.chunk_id, h.score, d.rank AS dense_rank, l.rank AS lexical_rank FROM hits h LEFT JOIN dense d USING (chunk_id) LEFT JOIN lexical l USING (chunk_id)",
    "job_status_counts": with_(JOBS) + "SELECT status, count(*) AS n FROM jobs GROUP BY status",
    "job_visibility": with_(DOCS, JOBS, MEMBERS) + f"SELECT job_id, doc_id, status FROM jobs WHERE doc_id IN (SELECT doc_id FROM ({visible('docs')}))",
    "job_routing": with_(JOBS) + "SELECT doc_id, CASE WHEN bool_and(job_id % 3 = 0) THEN 'failed' ELSE 'ready' END AS status FROM jobs GROUP BY doc_id",
    "latest_status": with_(DOCS, JOBS) + "SELECT d.doc_id, d.status, j.s AS job_status FROM docs d LEFT JOIN (SELECT doc_id, arg_max(status, ROW(created_at, job_id)) AS s FROM jobs GROUP BY doc_id) j USING (doc_id)",
    "status_label": with_(DOCS, JOBS) + f"SELECT d.doc_id, coalesce({LABELS.format('j.s')}, {LABELS.format('d.status')}, d.status) AS label FROM docs d LEFT JOIN (SELECT doc_id, arg_max(status, ROW(created_at, job_id)) AS s FROM jobs GROUP BY doc_id) j USING (doc_id)",
    "doc_icon": with_(DOCS) + f"SELECT doc_id, filename, {ICONS} AS icon FROM docs",
    "mime_default": "SELECT event_id, coalesce(nullif(CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'text/plain' END, ''), 'application/octet-stream') AS mime FROM events",
    "legacy_hash": "SELECT doc_id, 'legacy:' || md5(CAST(doc_id AS VARCHAR)) AS file_hash FROM documents",
    "slugify": f"SELECT p_partkey, {SLUG} AS slug FROM part",
    "adapter_name": with_(ADAPTERS) + "SELECT adapter_id, regexp_replace(regexp_extract(file_path, '[^/\\\\]*$'), '(\\.gguf)+$', '') || '-' || substring(file_hash, 1, 8) AS name FROM adapters",
    "adapters_for_user": with_(MEMBERS, ADAPTERS, ASSIGNMENTS) + "SELECT s.assignment_id, s.adapter_id, s.department_id, a.file_path, s.scale FROM assignments s JOIN members m ON m.department_id = s.department_id AND m.user_id = 3 JOIN adapters a ON a.adapter_id = s.adapter_id AND a.is_active",
    "adapters_distinct_active": with_(ADAPTERS) + "SELECT DISTINCT file_path FROM adapters WHERE is_active",
    "adapter_catalog": with_(ADAPTERS, ASSIGNMENTS) + "SELECT s.assignment_id, s.department_id, a.file_path AS adapter_path, s.scale, a.is_active FROM assignments s JOIN adapters a USING (adapter_id)",
    "adapter_upsert": with_(ADAPTERS, UPSERTED)
    + """SELECT coalesce(e.adapter_id, i.adapter_id) AS adapter_id, coalesce(i.file_path, e.file_path) AS file_path, coalesce(e.file_hash, i.file_hash) AS file_hash, coalesce(e.base_model, i.base_model) AS base_model,
        coalesce(e.rank, i.rank) AS rank, coalesce(e.is_active, i.is_active) AS is_active FROM existing e FULL JOIN incoming i ON e.file_hash = i.file_hash""",
    "assignment_upsert": with_(ASSIGNMENTS) + "SELECT department_id, adapter_id, CASE WHEN adapter_id % 5 = 0 THEN 2.0 ELSE scale END AS scale FROM assignments",
    "adapter_index_join": with_(ADAPTERS) + "SELECT a.adapter_id, a.file_path, a.adapter_id + 1000000 AS loaded_id FROM adapters a WHERE is_active AND adapter_id % 4 <> 0",
    "adapter_index_skipped": with_(ADAPTERS) + "SELECT adapter_id, file_path FROM adapters WHERE is_active AND adapter_id % 4 = 0",
    "single_active_model": "SELECT DISTINCT p_brand AS name, CASE p_brand WHEN 'Brand#11' THEN 64 ELSE 768 END AS dimension, p_brand = 'Brand#11' AS is_active FROM part UNION SELECT 'Brand#11', 64, true",
    "dimension_audit": "SELECT DISTINCT vec_id AS doc_id FROM embeddings WHERE len(embedding) <> CASE WHEN label = 3 THEN 768 ELSE 64 END",
    "unique_default_audit": with_(ASSIGNMENTS) + "SELECT department_id, count(*) AS n FROM assignments WHERE is_default GROUP BY department_id HAVING count(*) > 1",
    "scale_audit": with_(ASSIGNMENTS) + "SELECT assignment_id, scale FROM assignments WHERE NOT scale BETWEEN 0 AND 1",
    "orphan_jobs": with_(JOBS) + "SELECT job_id FROM jobs WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 5 <> 0)",
    "seed_insert_ignore": with_(MEMBERS) + "SELECT department_id, 'kept' AS origin FROM (SELECT DISTINCT source AS department_id FROM documents) UNION ALL SELECT d, 'new' FROM (VALUES ('src0'), ('audit')) AS v(d) WHERE d NOT IN (SELECT source FROM documents)",
    "department_label": with_(ASSIGNMENTS) + "SELECT s.assignment_id, coalesce(d.name, 'Unknown dept') AS department FROM assignments s LEFT JOIN (SELECT DISTINCT source AS department_id, 'Department ' || source AS name FROM documents WHERE source <> 'src4') d USING (department_id)",
    "default_department": "SELECT c_custkey, lower(c_name) || '-dept' AS slug, c_name || '''s Department' AS name, c_name || '@local' AS email FROM customer",
    "safe_identity": "SELECT event_id, CASE event_id % 3 WHEN 0 THEN user_id END AS identity FROM events",
    "schema_evolution": "SELECT doc_id, text AS content, lang, CASE WHEN lang = 'en' THEN 'english' ELSE 'other' END AS language_group FROM documents",
    "sse_assemble": with_(WORDS) + "SELECT c.conv_id, c.turn, coalesce(string_agg(CASE WHEN i % 5 <> 4 AND i % 7 <> 6 AND i <= 30 THEN w || ' ' END, '' ORDER BY i), '') AS answer FROM conversations c LEFT JOIN words USING (conv_id, turn) GROUP BY c.conv_id, c.turn",
    "stream_concat": "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id",
    "job_claim_oldest": with_(JOBS) + "SELECT job_id, doc_id, 'running' AS status, 1 AS attempts, created_at, TIMESTAMP '2024-01-01 00:00:00' AS started_at FROM jobs WHERE status = 'queued' ORDER BY jobs.created_at, job_id LIMIT 1",
    "job_claim_update": with_(JOBS, "claimed AS (SELECT job_id FROM jobs WHERE status = 'queued' ORDER BY created_at, job_id LIMIT 1)")
    + "SELECT jobs.job_id, CASE WHEN c.job_id IS NULL THEN status ELSE 'running' END AS status, attempts + (c.job_id IS NOT NULL)::INT AS attempts, CASE WHEN c.job_id IS NULL THEN started_at ELSE TIMESTAMP '2024-01-01 00:00:00' END AS started_at FROM jobs LEFT JOIN claimed c USING (job_id)",
    "job_reap": with_(JOBS) + "SELECT job_id, doc_id, CASE status WHEN 'running' THEN 'queued' ELSE status END AS status, attempts, CASE WHEN status <> 'running' THEN started_at END AS started_at FROM jobs",
    "job_routing_jobs": with_(JOBS) + "SELECT job_id, doc_id, CASE WHEN job_id % 3 = 0 THEN 'failed' ELSE 'succeeded' END AS status, CASE WHEN job_id % 3 = 0 THEN 'unreadable' END AS error FROM jobs",
    "job_log_state": """WITH log AS (SELECT event_id % 1000 AS job_id, ts AS moment, CASE event_type WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'queued' END AS status,
            CASE WHEN event_type = 'error' THEN 'event ' || event_id END AS error, CASE event_type WHEN 'view' THEN 2 WHEN 'purchase' THEN 4 WHEN 'error' THEN 3 ELSE 1 END AS o FROM events),
        last AS (SELECT job_id, status, error, moment FROM log QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY moment DESC, o DESC) = 1),
        runs AS (SELECT job_id, count(*) AS n, max(moment) AS moment FROM log WHERE status = 'running' GROUP BY job_id)
        SELECT l.job_id, l.status, l.error, coalesce(n, 0) AS attempts, CASE WHEN l.status <> 'queued' THEN r.moment END AS started_at, CASE WHEN l.status IN ('failed', 'succeeded') THEN l.moment END AS finished_at FROM last l LEFT JOIN runs r USING (job_id)""",
    "ingest_jobs": with_(DOCS, JOBS, INGESTED)
    + """SELECT j.job_id, j.doc_id, CASE WHEN j.status IN ('queued', 'running') THEN CASE WHEN t.error IS NULL THEN 'succeeded' ELSE 'failed' END ELSE j.status END AS status, attempts + (j.status IN ('queued', 'running'))::INT AS attempts,
        CASE WHEN j.status IN ('queued', 'running') THEN TIMESTAMP '2024-01-01 00:00:00' ELSE started_at END AS started_at, CASE WHEN j.status IN ('queued', 'running') THEN TIMESTAMP '2024-01-01 00:00:00' ELSE finished_at END AS finished_at,
        CASE WHEN j.status IN ('queued', 'running') THEN t.error ELSE j.error END AS error FROM jobs j LEFT JOIN told t USING (doc_id)""",
    "ingest_documents": with_(DOCS, JOBS, INGESTED) + "SELECT d.doc_id, CASE WHEN t.doc_id IS NULL THEN d.status WHEN t.error IS NULL THEN 'ready' ELSE 'failed' END AS status FROM docs d LEFT JOIN told t USING (doc_id)",
    "ingest_chunks": with_(DOCS, CHUNKS, JOBS, INGESTED) + "SELECT doc_id, department_id, chunk_index, content, greatest(length(content) // 4, 1) AS token_count FROM chunks WHERE doc_id IN (SELECT doc_id FROM told WHERE error IS NULL)",
    "ingest_vectors": with_(DOCS, VECTORS, JOBS, INGESTED) + "SELECT doc_id, chunk_index, len(v) AS dimension FROM vectors WHERE doc_id IN (SELECT doc_id FROM told WHERE error IS NULL)",
    "stream_ingest": with_(DOCS, CHUNKS) + "SELECT doc_id, department_id, chunk_index, content, greatest(length(content) // 4, 1) AS token_count FROM chunks",
    "document_lookup": with_(DOCS) + "SELECT doc_id, filename, status FROM docs WHERE doc_id = 5",
    "document_must_exist": with_(DOCS) + "SELECT doc_id, department_id, filename FROM docs WHERE doc_id = 6",
    "active_model": "SELECT DISTINCT p_brand AS name, 64 AS dimension FROM part WHERE p_brand = 'Brand#12'",
    "insert_returning": "SELECT doc_id, substring(sha256(source || chr(31) || sha256(text)), 1, 32) AS document_id FROM documents",
    "upload_outcomes": with_(DOCS, MEMBERS)
    + """, up AS (SELECT doc_id AS upload_id, department_id, filename, CASE WHEN doc_id % 4 = 1 THEN 'text/plain' ELSE 'application/octet-stream' END AS mime_type, sha256(text) AS file_hash, CAST(strlen(text) AS BIGINT) AS byte_size,
            department_id IN (SELECT department_id FROM members WHERE user_id = 3) AS allowed FROM docs WHERE doc_id % 2 = 1),
        there AS (SELECT DISTINCT department_id, sha256(text) AS file_hash FROM docs WHERE doc_id % 2 = 0),
        told AS (SELECT up.*, CASE WHEN NOT allowed THEN 'denied' WHEN t.file_hash IS NOT NULL OR min(CASE WHEN allowed THEN upload_id END) OVER (PARTITION BY department_id, file_hash) < upload_id THEN 'duplicate' ELSE 'queued' END AS outcome FROM up LEFT JOIN there t USING (department_id, file_hash))
        SELECT department_id, file_hash, upload_id, filename, mime_type, byte_size, outcome, CASE WHEN outcome = 'queued' THEN substring(sha256(department_id || chr(31) || file_hash), 1, 32) END AS document_id FROM told""",
    "blob_round_trip": "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS byte_size, text FROM documents",
    "lossy_decode": "SELECT conv_id, turn, chr(65533) || text || chr(65533) AS text FROM conversations",
    "adapter_file_hash": with_(ADAPTERS) + "SELECT adapter_id, CASE WHEN adapter_id % 3 <> 0 THEN sha256(file_path) ELSE 'path:' || sha256(file_path) END AS file_hash FROM adapters",
    "policy_matrix": with_(DOCS, VECTORS, MEMBERS, ASSIGNMENTS, JOBS)
    + """, mine AS (SELECT department_id FROM members WHERE user_id = 3),
        n AS (SELECT 'documents' AS table_name, 4 AS verbs, count(*) AS n FROM docs WHERE department_id IN (FROM mine) UNION ALL SELECT 'chunks', 4, count(*) FROM keys WHERE department_id IN (FROM mine)
            UNION ALL SELECT 'vectors', 4, count(*) FROM vectors WHERE department_id IN (FROM mine) UNION ALL SELECT 'assignments', 4, count(*) FROM assignments WHERE department_id IN (FROM mine)
            UNION ALL SELECT 'jobs', 3, count(*) FROM jobs WHERE doc_id IN (SELECT doc_id FROM docs WHERE department_id IN (FROM mine)) UNION ALL SELECT 'audit_log', 2, count(*) FROM events WHERE user_id = 3
            UNION ALL SELECT 'departments', 1, count(DISTINCT department_id) FROM docs WHERE department_id IN (FROM mine) UNION ALL SELECT 'members', 1, count(*) FROM members WHERE user_id = 3)
        SELECT table_name, verb, CASE WHEN i <= verbs THEN n ELSE 0 END AS n FROM n, (VALUES (1, 'select'), (2, 'insert'), (3, 'update'), (4, 'delete')) AS v(i, verb)""",
    "policy_update": with_(DOCS, MEMBERS)
    + """, mine AS (SELECT department_id FROM members WHERE user_id = 3), c AS (SELECT doc_id, department_id AS old, CASE WHEN doc_id % 2 = 0 THEN 'src3' ELSE 'src5' END AS department_id, status FROM docs WHERE doc_id % 3 = 0)
        SELECT doc_id, department_id, status, CASE WHEN old NOT IN (FROM mine) THEN 'ignored' WHEN department_id NOT IN (FROM mine) THEN 'rejected' ELSE 'updated' END AS outcome FROM c""",
    "policy_delete": with_(DOCS, MEMBERS) + "SELECT doc_id, department_id FROM docs WHERE doc_id % 3 <> 0 OR department_id NOT IN (SELECT department_id FROM members WHERE user_id = 3)",
    "policy_denied_delete": "SELECT event_type AS action, count(*) AS n FROM events GROUP BY 1",
    "own_audit_rows": "SELECT event_id, user_id, event_type AS action, ts FROM events WHERE user_id = 3",
    "own_memberships": with_(MEMBERS) + "SELECT user_id, department_id FROM members WHERE user_id = 3",
    "admin_departments": "SELECT DISTINCT source AS department_id, 'Department ' || source AS name FROM documents",
    "admin_bootstrap": "WITH u AS (SELECT DISTINCT user_id, 'User' || user_id AS username FROM events) SELECT user_id, username, user_id = (SELECT min(user_id) FROM u) AS is_admin, username || '@local' AS email FROM u",
    "admin_bootstrap_taken": "WITH u AS (SELECT DISTINCT user_id, 'User' || user_id AS username FROM events) SELECT user_id, username, false AS is_admin, username || '@local' AS email FROM u",
    "bootstrap_departments": "WITH u AS (SELECT DISTINCT user_id, 'User' || user_id AS username FROM events) SELECT lower(username) || '-dept' AS department_id, username || '''s Department' AS name, lower(username) || '-dept' AS slug FROM u",
    "bootstrap_members": "WITH u AS (SELECT DISTINCT user_id, 'User' || user_id AS username FROM events) SELECT user_id, lower(username) || '-dept' AS department_id FROM u",
    "cascade_delete": with_(DOCS, VECTORS, JOBS)
    + """SELECT doc_id, child, count(*) AS n FROM (SELECT doc_id, 'chunks' AS child FROM keys UNION ALL SELECT doc_id, 'vectors' FROM vectors UNION ALL SELECT doc_id, 'jobs' FROM jobs) WHERE doc_id % 10 <> 0 GROUP BY ALL""",
    "restricted_departments": "SELECT DISTINCT source AS department_id, 'Department ' || source AS name FROM documents WHERE source = 'src1'",
    "lexical_topk_indexed": with_(DOCS, CHUNKS, lexical()) + "SELECT chunk_id, score, rank FROM lexical",
    "committed_documents": with_(DOCS, VECTORS, JOBS, INGESTED)
    + """, made AS (SELECT doc_id, count(*) AS n FROM vectors WHERE doc_id IN (SELECT doc_id FROM told WHERE error IS NULL) GROUP BY doc_id),
        queue AS (SELECT doc_id, count(*) AS n FROM jobs GROUP BY doc_id)
        SELECT d.doc_id, CASE WHEN t.doc_id IS NULL THEN d.status WHEN t.error IS NULL THEN 'ready' ELSE 'failed' END AS status, coalesce(made.n, 0) AS n_chunks, coalesce(made.n, 0) AS n_vectors, coalesce(queue.n, 0) AS n_jobs
        FROM docs d LEFT JOIN told t USING (doc_id) LEFT JOIN made USING (doc_id) LEFT JOIN queue USING (doc_id) WHERE d.doc_id % 10 <> 0""",
}
ORACLES["committed_jobs"] = ORACLES["ingest_jobs"]
ORACLES["dense_topk_indexed"] = ORACLES["dense_topk"]
ORACLES["dense_topk_batch_indexed"] = ORACLES["dense_topk_batch"]
ORACLES["policy_sql_documents"] = ORACLES["visible_documents"]
ORACLES["policy_sql_tables"] = f"SELECT table_name, n FROM ({ORACLES['policy_matrix']}) WHERE verb = 'select'"
ORACLES["policy_sql_functions"] = with_(ADAPTERS, MEMBERS) + f"SELECT adapter_id, CAST({USER} AS BIGINT) AS me, 'src' || (adapter_id % 20) IN (SELECT department_id FROM members WHERE user_id = {USER}) AS mine FROM adapters"
ORACLES["policy_sql_nobody"] = "SELECT event_id AS job_id, event_id AS doc_id, user_id AS me FROM events WHERE false"
ORACLES["stream_jobs"] = ORACLES["ingest_jobs"]
ORACLES["sse_assemble_stream"] = ORACLES["sse_assemble"]
ORACLES["lexical_match_changed"] = ORACLES["lexical_match"] + " WHERE chunk_id // 8388608 % 5 <> 0"
ORACLES["chunk_split_sql"] = with_(DOCS, CHUNKS) + "SELECT doc_id, department_id, chunk_index, content, greatest(length(content) // 4, 1) AS token_count FROM chunks"
ORACLES["blob_files_round_trip"] = ORACLES["blob_round_trip"]
ORACLES["rules_on_write"] = with_(ASSIGNMENTS, "stored AS (SELECT count(*) AS stored FROM assignments WHERE scale <= 1)") + """SELECT batch, rule, n, stored FROM stored, (
    SELECT 'within' AS batch, '' AS rule, 0 AS n UNION ALL SELECT 'all', 'scale', count(*) FROM assignments WHERE scale > 1
    UNION ALL SELECT 'again', 'unique (department_id, adapter_id)', count(*) FROM assignments WHERE scale <= 1 AND adapter_id % 3 = 0)"""
ORACLES["columns_by_number"] = with_(DOCS) + "SELECT doc_id, filename AS title, CASE WHEN doc_id % 3 = 2 THEN 7 END AS department_id, CASE WHEN doc_id % 3 = 2 THEN length(text) END AS n_chars FROM docs"
