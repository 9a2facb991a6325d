"""Every registered query with SQL gives the SQL's rows on the smallest tables."""

import re
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tipoff.suite.queries import REGISTRY

DIR = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not Path(DIR).exists(), reason="test tables are not here")
ROWS_ONLY = {"fit_and_score", "feature_importance", "predict_matchups"}


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for path in Path(DIR).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def test_keys():
    own = lambda names: {n for n in names if n != "pipeline" and not re.match(r"op\d+_", n)}
    assert own(entry.oracle_sql()) == set(REGISTRY) - ROWS_ONLY
    assert own(entry.queries()) == set(REGISTRY)


@pytest.mark.parametrize("name", [n for n in REGISTRY if n not in ROWS_ONLY])
def test_query_matches_sql(spark, con, name):
    from tools.check_oracle import rows_of

    df = entry.queries()[name](spark, DIR)
    result = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
