"""Every registered query of the HTML operators against its SQL, on the smallest tables."""

import hashlib
import math

import duckdb
import pytest

from pagemill.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    return con


def rows(frame):
    plain = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else v
    return sorted((tuple(str(plain(v)) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, sql):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name not in catalog.ORACLES:
        assert len(got.columns) > 1 and len(got)
        return
    want = sql.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_has_all_of_them(spark):
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_references_cut_before_their_semicolon(spark, tmp_path):
    """The tables' titles may end in &amp, which the reference decodes and reports; the SQL doesn't know of it."""
    code, odd = "missing-semicolon-after-character-reference", "<html><head><title>a &amp;&amp</title></head><body><h1>a &amp;&amp</h1><p>x&am</p></body></html>"
    spark.createDataFrame([(1, "u", odd), (3, "u", "<title>b</title><h1>b</h1>")], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = lambda name: sorted(map(tuple, catalog.QUERIES[name](spark, str(tmp_path)).collect()))
    assert got("title_text") == got("decoded_headings") == [(1, "a &&"), (3, "b")]
    assert got("first_parse_errors") == [(1, 0, code), (1, 1, code)]
    assert got("parse_error_counts") == [(code, 2)] and got("missing_semicolon_pages") == [(1,)]
    assert (1, "Character", 12) in got("token_kind_counts")
    assert got("visible_text_digest")[0] == (1, hashlib.md5(b"a &&a &&x&am").hexdigest())
