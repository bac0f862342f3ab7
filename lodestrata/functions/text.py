"""Scalar text functions: chunks, names, labels, hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK, OVERLAP = 512, 64
#: Ids of a document's chunks: more than the chunks of the longest string that a row can hold.
CHUNK_IDS = 1 << 23

# Labels that users see.
STATUS_LABELS = {"pending": "Pending", "ready": "Ready", "failed": "Failed", "queued": "Queued", "running": "Ingesting…", "succeeded": "Done"}
# Icon classes by file extension.
ICON_CLASSES = {"pdf": "pdf", "doc": "document", "docx": "document", "xls": "sheet", "xlsx": "sheet", "ppt": "slides", "pptx": "slides", "txt": "text", "md": "text"}


def chunk_count(length: Column, size: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """Windows of ``size`` code points in a text of ``length``, each ``size - overlap`` after the last, the last touching the end."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be at least 0 and less than the size")
    windows = F.greatest(F.lit(1), F.ceil((length - overlap) / (size - overlap)))
    return F.when(length > 0, windows).otherwise(0).cast("int")


def chunk_content(text: Column, index: Column, size: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """The chunk with this index (from 0)."""
    return F.substr(text, (index * (size - overlap) + 1).cast("int"), F.lit(size))


def chunks(docs: DataFrame, text: str, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """A row for each chunk: the columns of ``docs`` but the text, and chunk_index, content."""
    count = chunk_count(F.length(text), size, overlap)
    rows = docs.where(count > 0).withColumn("chunk_index", F.explode(F.sequence(F.lit(0), count - 1)))
    content = chunk_content(F.col(text), F.col("chunk_index"), size, overlap)
    return rows.select(*(c for c in docs.columns if c != text), F.col("chunk_index").cast("long").alias("chunk_index"), content.alias("content"))


def chunk_id(doc_id: Column, index: Column) -> Column:
    """The id of a document's chunk; documents never share one."""
    return doc_id * CHUNK_IDS + index


def document_chunks(docs: DataFrame) -> DataFrame:
    """The chunks of documents (doc_id, text, ...) with their ``chunk_id``."""
    cut = chunks(docs, "text")
    return cut.select(chunk_id(F.col("doc_id"), F.col("chunk_index")).alias("chunk_id"), *cut.columns)


def token_count(content: Column) -> Column:
    """A quarter of the characters, at least one."""
    return F.greatest(F.floor(F.length(content) / 4), F.lit(1)).cast("long")


def slug_base(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def slugify(name: Column, ident: Column) -> Column:
    """Lower-case words joined by dashes, and the first eight characters of the id."""
    return F.concat_ws("-", slug_base(name), F.substring(ident, 1, 8))


def adapter_name(path: Column, content_hash: Column) -> Column:
    """File name without directories and ``.gguf`` endings, and the first eight characters of the hash."""
    stem = F.regexp_replace(F.regexp_extract(path, r"[^/\\]*$", 0), r"(\.gguf)+$", "")
    return F.concat_ws("-", stem, F.substring(content_hash, 1, 8))


def mime_or_default(mime: Column) -> Column:
    return F.coalesce(F.nullif(mime, F.lit("")), F.lit("application/octet-stream"))


def legacy_hash(ident: Column) -> Column:
    """The placeholder of documents from before hashes were kept."""
    return F.concat(F.lit("legacy:"), F.md5(ident.cast("binary")))


def icon_class(filename: Column) -> Column:
    extension = F.lower(F.element_at(F.split(filename, r"\."), -1))
    return F.coalesce(*(F.when(extension == k, F.lit(v)) for k, v in ICON_CLASSES.items()), F.lit("folder"))


def label_of(status: Column) -> Column:
    return F.coalesce(*(F.when(status == k, F.lit(v)) for k, v in STATUS_LABELS.items()))


def status_label(job_status: Column, document_status: Column) -> Column:
    """The job's label if it has a known status, else the document's, else its raw status."""
    return F.coalesce(label_of(job_status), label_of(document_status), document_status)


def excerpt(content: Column, length: int = 200) -> Column:
    return F.substring(content, 1, length)


def safe_identity(value: Column) -> Column:
    """A user id, or null for anything that isn't one; never an error."""
    return F.trim(value.cast("string")).try_cast("long")
