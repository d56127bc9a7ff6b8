"""Every query of the core library against its SQL in DuckDB."""

import duckdb
import pytest

from relayspark.plans import queries

SF_DIR = "/root/testdata/sf0.001"
TABLES = "documents benchmark pages conversations labels events lineitem supplier customer orders part nation region embeddings"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def values(frame):
    columns = sorted(frame.columns)
    return columns, sorted(map(repr, frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, duck, name):
    assert values(queries.QUERIES[name](spark, SF_DIR).toPandas()) == values(duck.execute(queries.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF_DIR).count() > 0
