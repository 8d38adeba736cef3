import collections
import math
import re

import duckdb
import pytest

import corpus_pipeline
from pagemill.llm import mixing
from pagemill.llm.queries import op10_source_mixing

SF = "/root/testdata/sf0.001"


def test_whole_table_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = {r[0]: r[1:] for r in con.execute(mixing.SQL).fetchall()}
    got = {r["doc_id"]: (r["size"], r["source_size"], r["target"], r["taken"]) for r in op10_source_mixing(spark, SF).collect()}
    assert got.keys() == want.keys()
    for i, g in got.items():
        assert (g[0], g[1], g[3]) == (want[i][0], want[i][1], want[i][3]) and math.isclose(g[2], want[i][2])


def brute_targets(sizes):
    """Shares dealt out, and the excess again and again."""
    names = sorted((k for k in sizes if k is not None), key=lambda s: s.encode()) + [k for k in sizes if k is None]
    w = {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}
    left, target, free = 1.5 * sum(sizes.values()), {}, set(sizes)
    while free:
        unit = left / sum(w[k] for k in free)
        full = {k for k in free if w[k] * unit >= 2 * sizes[k]}
        if not full:
            return target | {k: w[k] * unit for k in free}
        target |= {k: 2.0 * sizes[k] for k in full}
        left -= sum(2 * sizes[k] for k in full)
        free -= full
    return target


ROWS = [(i, "w " * (1 + i % 17), None, s) for i, s in enumerate(["b", "a", None, "ä", "c", "Z"] * 20)] + [(900, None, None, "a"), (901, "", None, "only empty"), (None, "x y", None, "b"), (7, "w " * 8, None, "a"), (950, "long " * 3000, None, "c")]


def test_targets_and_taken_words(frame):
    rows = mixing.mix_sources(frame(ROWS)).collect()
    again = mixing.mix_sources(frame(ROWS[::-1])).collect()
    plain = lambda rows: sorted(((r["doc_id"] or -1), r["size"], r["taken"]) for r in rows)
    assert plain(rows) == plain(again) and len(rows) == len(ROWS)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert plain(rows) == sorted(plain(rows)) and collections.Counter((r["doc_id"], r["size"]) for r in rows) == collections.Counter((r[0], size(r[1])) for r in ROWS)
    sizes = collections.Counter()
    for r in ROWS:
        sizes[r[3]] += size(r[1])
    want = brute_targets(sizes)
    by_target = collections.defaultdict(int)
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by_target[(r["source_size"], round(r["target"], 6))] += r["taken"]
    assert {(sizes[k], round(t, 6)) for k, t in want.items()} == set(by_target)
    for (_, target), taken in by_target.items():
        assert abs(taken - target) <= 1


EQUAL = [
    ([(7, "w")] * 1000, 1500),
    ([(7, "one two three")] * 999, 4495),
    ([(None, "w " * (1 + i % 7)) for i in range(999)], None),
    ([(None, None)] * 3 + [(None, "a b")] * 5 + [(1, "")] * 2, 15),
    ([(3, "x" * 2000)] * 40 + [(i, "abc abcd " * 20) for i in range(100, 160)], None),
]


@pytest.mark.parametrize("rows, want", EQUAL)
def test_equal_rows_where_a_budget_ends(frame, rows, want):
    """Repeated rows and null ids share keys; the words taken still are the target's, and SQL deals them alike."""
    docs = frame([(i, t, None, "s") for i, t in rows])
    got = [tuple(r) for r in mixing.mix_sources(docs).select("doc_id", "size", "target", "taken").collect()]
    assert sum(g[3] for g in got) == math.floor(got[0][2]) and (want is None or sum(g[3] for g in got) in (want, want - 1))
    assert all(g[3] <= 2 * g[1] for g in got)
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "source").toPandas())
    order = lambda rows: sorted(rows, key=str)
    sql = con.execute(f"SELECT doc_id, size, taken FROM ({mixing.SQL})").fetchall()
    assert order((None if i is None else int(i), s, t) for i, s, t in sql) == order((g[0], g[1], g[3]) for g in got)
    out = mixing.mixed_documents(docs)
    assert sum(len(r["text"].split()) for r in out.collect()) == sum(g[3] for g in got)


def test_complete_epochs_come_first(frame):
    for r in mixing.mix_sources(frame(ROWS)).collect():
        if r["source_size"]:
            assert r["taken"] >= r["size"] * math.floor(r["target"] / r["source_size"])


def test_heavier_documents_are_drawn_more_readily(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "IF(id % 2 = 0, repeat('abcde ', 50), repeat('abcdefghijklmnopqrstuvw ', 50)) AS text", "IF(id < 2000, 'a', 'b') AS source")
    taken = collections.Counter()
    for r in mixing.mix_sources(df, weights=(1, 3), share=1.0).collect():
        if r["target"] < r["source_size"]:
            taken[r["doc_id"] % 2] += r["taken"]
    assert taken[0] > 1.3 * taken[1] > 0


def test_mixed_documents_hold_the_taken_words(frame):
    docs = frame(ROWS)
    taken = sum(r["taken"] for r in mixing.mix_sources(docs).collect())
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert sum(len(r["text"].split()) for r in out.collect()) == taken
    assert mixing.mix_sources(docs.limit(0)).count() == 0 and mixing.mixed_documents(docs.limit(0)).count() == 0


def test_many_sources_are_salted_instead_of_broadcast(frame, monkeypatch):
    plain = lambda: sorted((r["doc_id"] or -1, r["size"], r["taken"]) for r in mixing.mix_sources(frame(ROWS)).collect())
    want = plain()
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert plain() == want


def test_no_python_in_the_plan(frame):
    df = mixing.mix_sources(frame(ROWS))
    assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().executedPlan().toString())


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, f in corpus_pipeline.STAGES:
        got = f(spark, docs, SF).cache()
        out.append((name, docs, got))
        docs = got
    return out


def test_stages_keep_columns_and_only_drop_rows(stages):
    assert [n for n, *_ in stages] == ["language_id", "quality_rules", "near_duplicates", "mixing", "packing"]
    for name, before, after in stages[:-1]:
        assert after.columns == before.columns, name
    for _, before, after in stages[:3]:
        assert after.exceptAll(before).count() == 0


def test_near_duplicate_stage_keeps_one_of_each_group(stages):
    from test_ngram_join import brute

    _, before, after = stages[2]
    want = {i for i, (_, c) in brute([(r["doc_id"], r["text"]) for r in before.collect()]).items() if i == c}
    assert {r["doc_id"] for r in after.collect()} == want


def test_quality_stage_drops_what_the_base_rules_fail(stages):
    from test_quality import brute, failed

    _, before, after = stages[1]
    kept = {r["doc_id"] for r in after.collect()}
    assert all(r["doc_id"] not in kept for r in before.collect() if failed(brute(r["text"])))
    assert len(kept) > 0.7 * before.count()


def test_run_gives_the_pieces_of_the_mix(spark, stages):
    from test_tokens_and_packing import ids

    _, before, after = stages[4]
    total = sum(len(ids(r["text"])) + 1 for r in before.collect())
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == after.columns
    assert got.agg({"length": "sum"}).first()[0] == total
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_take_odd_tables(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (2, "a b", None, "s", 3), (2, "a b", None, "s", 3)], "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'x' AS kept", "'y' AS row", "'z' AS gone", "1 AS accepted")
    for _, f in corpus_pipeline.STAGES:
        f(spark, docs, SF).collect()
        assert f(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.STAGES[2][1](spark, docs, SF).where("doc_id = 2").count() == 1


def test_near_duplicate_stage_tells_rows_apart(spark):
    """Ids that repeat with other texts, null ids, equal rows: one row of each group, all others stay."""
    long = " ".join(f"w{i}" for i in range(60))
    near = " ".join(f"w{i}" if i != 30 else "x" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(5, long), (5, other), (5, long), (7, near), (None, near), (None, "only here five words long"), (None, "only here five words long"), (9, ""), (9, ""), (8, other), (11, None), (3, "short")]
    docs = spark.createDataFrame([(*r, "en", "s", 1, k) for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, key long").selectExpr("*", "1 AS again", "2 AS gone_key", "'x' AS id")
    got = corpus_pipeline.near_duplicate_stage(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(5, long), (5, other), (None, "only here five words long"), (9, ""), (9, ""), (11, None), (3, "short")], key=str)
