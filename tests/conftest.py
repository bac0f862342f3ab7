from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SMALL


def same_rows(frame, connection, sql):
    """Spark rows and DuckDB rows as sorted lists over columns sorted by name."""
    columns = sorted(frame.columns)
    mine = sorted(tuple(str(row[c]) for c in columns) for row in frame.collect())
    result = connection.sql(sql)
    order = [result.columns.index(c) for c in sorted(result.columns)]
    theirs = sorted(tuple(str(row[i]) for i in order) for row in result.fetchall())
    assert columns == sorted(result.columns)
    assert mine == theirs


@pytest.fixture(scope="session")
def connection(sf_dir):
    import duckdb

    made = duckdb.connect()
    for name in os.listdir(sf_dir):
        made.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    return made
