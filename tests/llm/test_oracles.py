"""Every query that SQL can say, against DuckDB on the same tables."""


import duckdb
import pandas as pd
import pytest

from pagemill.llm import oracles, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame):
    plain = lambda v: None if pd.isna(v) else round(v, 2) if isinstance(v, float) else v
    return sorted((tuple(str(plain(v)) for v in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_against_sql(name, spark, sql):
    got = (queries.QUERIES | oracles.QUERIES)[name](spark, SF).toPandas()
    want = sql.execute(oracles.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want) > 0
    for a, b in zip(rows(got), rows(want), strict=True):
        assert [x.removesuffix(".0") for x in a] == [x.removesuffix(".0") for x in b]


def test_every_query_is_registered():
    import __spark_entry__ as e

    assert set(queries.QUERIES) | set(oracles.QUERIES) <= set(e.queries()) and set(oracles.ORACLES) <= set(e.oracle_sql())
