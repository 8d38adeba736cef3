import collections
import re

import numpy as np
import pytest

from pagemill.llm import quality
from pagemill.llm.queries import op6_quality_rules

SF = "/root/testdata/sf0.01"


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    tri = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def counts(r):
    return r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]


def failed(c):
    return c[0] < 50 or 100 * c[4] > 50 * c[0]


def test_whole_table_and_verdicts_on_labelled_rows(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    good = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = op6_quality_rules(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        c = brute(texts[r["doc_id"]])
        assert counts(r) == c and r["base_failed"] == failed(c) and not (r["base_failed"] and r["kept"])
    clean = [r for r in rows if not r["base_failed"] and good.get(r["doc_id"]) == 1]
    poor = [r for r in rows if not r["base_failed"] and good.get(r["doc_id"]) == 0]
    assert all(r["kept"] for r in clean)
    assert sum(not r["kept"] for r in poor) >= 0.9 * len(poor)


@pytest.mark.parametrize("text", [None, "", " \n\t\n", "a", "a b a b a b", "x\nx\n x\n\n\nx", "é ß#|\x0b<>", "a b c a b c d", "one\x1ctwo three\x85four five", "w " * 30000, "a b c " * 5, "a a a", "  b"])
def test_counts_of_odd_texts(frame, spark, text):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    r = quality.quality_rows(frame([(1, text)]), labels).first()
    assert counts(r) == brute(text)
    assert r["base_failed"] == failed(counts(r)) and r["kept"] != r["base_failed"]


def test_many_different_words_take_the_other_way():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 50, 500)
    words = [str(i) for i in ids]
    assert quality.repeated_words(quality.word_ids([w.encode() for w in words])) == brute(" ".join(words))[4]


def test_nulls_repeats_and_empty_tables(frame, spark):
    labels = spark.createDataFrame([(1, 1), (None, 1), (1, None), (9, 0)], "doc_id long, quality int")
    text = " ".join(f"word{i}" for i in range(60))
    docs = frame([(1, text), (1, text), (None, text), (2, None)])
    got = sorted((r["doc_id"] or -1, r["kept"]) for r in quality.quality_rows(docs, labels).collect())
    assert got == [(-1, True), (1, True), (1, True), (2, False)]
    assert quality.quality_rows(docs.limit(0), labels).count() == 0


def test_forest_scores_outliers_higher():
    """Beyond the rest on either side, in a joint oddity within both ranges, and along a statistic that is constant in the rest."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 4))
    x[:, 1] = x[:, 0] + 0.1 * x[:, 1]
    x[:, 3] = 0
    odd = np.array([[9, 9, 0, 0], [-9, -9, 0, 0], [2, -2, 0, 0], [0, 0, 0, 5.0]])
    every = np.concatenate([x, odd])
    s = quality.Forest(x, every.min(0), every.max(0)).scores(every)
    assert s[[500, 501, 503]].min() > s[:500].max() and s[502] > np.quantile(s[:500], 0.9) and 0 < s.min() and s.max() <= 1


def test_one_labelled_id_on_many_rows(frame, spark):
    """More rows than the sample takes, repeated ones among them: bounded, and judged by their texts."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 400, 80)) for _ in range(300)] + [" ".join(f"w{k}" for k in range(80))] * 300
    labels = spark.createDataFrame([(1, 1), (1, 1)], "doc_id long, quality int")
    rows = quality.quality_rows(frame([(1, t) for t in texts] + [(1, "#$%& " * 90 + " ".join(f"@{k}|<>" for k in range(200)))]), labels, labelled=100).collect()
    assert len(rows) == 601 and sum(r["kept"] for r in rows) >= 590


def test_all_labelled_rows_count(frame, spark):
    """More than 4000 labels: no row that is labelled good and passes the base rules is rejected, however odd, though plain rows are labelled poor."""
    rng = np.random.default_rng(5)
    words = lambda: [f"w{k}" for k in rng.integers(0, 400, 60)]
    texts = [" ".join(words()) for _ in range(1000)] + [" ".join(words() + ["#$" * k, "Q" * 5 * k, "7" * 3 * (60 - k)]) for k in range(60)]
    rows = quality.quality_rows(frame(list(enumerate(texts))), spark.createDataFrame([(i, int(i >= 20)) for i in range(len(texts) + 20000)], "doc_id long, quality int")).collect()
    assert not [r["doc_id"] for r in rows if r["doc_id"] >= 20 and not r["kept"] and not r["base_failed"]]


def test_forest_of_parts_and_smallest(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 3))
    low, high = x.min(0), x.max(0)
    whole, parts = quality.Forest(x, low, high), quality.Forest(x[:0], low, high)
    parts.hold(sum(parts.masses(p) for p in np.array_split(x, 7)))
    assert (whole.feature == parts.feature).all() and (whole.path == parts.path).all() and whole.scale == parts.scale
    y = np.concatenate([rng.random(5000) ** 9, np.full(4000, 0.25)])
    df = spark.createDataFrame([(float(v),) for v in y], "x double")
    assert [quality.smallest(df, k) for k in (0, 50, 7000, 8999)] == [float(np.sort(y)[k]) for k in (0, 50, 7000, 8999)]
