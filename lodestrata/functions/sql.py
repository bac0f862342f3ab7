"""Functions for SQL, from SQL: no Python runs in them."""

from __future__ import annotations

from pyspark.sql import SparkSession

# name: (parameters, what is returned, body)
_FUNCTIONS = {
    # windows of ``size`` code points, each ``size - overlap`` behind the last, the last touching the end
    "chunk_count": (
        "length INT, size INT, overlap INT", "INT",
        "CASE WHEN overlap < 0 OR overlap >= size THEN raise_error('the overlap must be at least 0 and less than the size') WHEN length > 0 THEN CAST(greatest(1, ceil((length - overlap) / (size - overlap))) AS INT) ELSE 0 END",
    ),
    "token_count": ("content STRING", "BIGINT", "greatest(length(content) div 4, 1)"),
    "mime_or_default": ("mime STRING", "STRING", "coalesce(nullif(mime, ''), 'application/octet-stream')"),
    "safe_identity": ("given STRING", "BIGINT", "try_cast(trim(given) AS BIGINT)"),
}
_TABLES = {
    "split_into_chunks": (
        "text STRING, size INT, overlap INT", "chunk_index BIGINT, content STRING",
        """SELECT CAST(e.i AS BIGINT), substr(text, e.i * (size - overlap) + 1, size) FROM explode(CASE
            WHEN overlap < 0 OR overlap >= size THEN CAST(raise_error('the overlap must be at least 0 and less than the size') AS ARRAY<INT>)
            WHEN length(text) > 0 THEN sequence(0, CAST(greatest(1, ceil((length(text) - overlap) / (size - overlap))) AS INT) - 1) ELSE array() END) AS e(i)""",
    ),
}


def register(spark: SparkSession) -> None:
    """Make the functions known in the session; ``split_into_chunks`` is a table for LATERAL."""
    for name, (parameters, kind, body) in _FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    for name, (parameters, columns, body) in _TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE({columns}) RETURN {body}")
