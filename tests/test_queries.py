"""Every query that SQL can express gives DuckDB's rows."""

from __future__ import annotations

import pytest

from lodestrata.plans import registry

from .conftest import same_rows


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, sf_dir, connection, name):
    same_rows(registry.QUERIES[name](spark, sf_dir), connection, registry.ORACLES[name])


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    rows = entry.entry(spark).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1)) and rows
