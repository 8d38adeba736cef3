import random

import pytest
from pyspark.sql import functions as F

from pagemill.llm import language
from pagemill.llm.queries import op5_language_id

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op5_language_id(spark, SF).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert {r["lang_pred"] for r in rows} <= set(truth.values()) | {"und"}
    assert sum(r["accepted"] for r in rows) >= 0.99 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def training(n=60):
    rng = random.Random(1)
    words = {"xx": ["alpha", "beta", "gamma", "delta"], "yy": ["ßök", "üzel", "öndö", "zzüß"]}
    return [(i, " ".join(rng.choice(words[k]) for _ in range(30)), k, None) for i, k in enumerate(["xx", "yy"] * n)]


def test_edges(frame):
    rows = training() + [(500, None), (501, ""), (502, "123 ... 4"), (503, "öndö üzel " * 3000), (504, "É"), (None, "alpha beta gamma"), (505, "alpha beta", None), (505, "alpha beta", None)]
    got = {}
    for r in language.language_rows(frame(rows)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert [got[i][0]["lang_pred"] for i in (500, 501, 502)] == ["und"] * 3
    assert not any(got[i][0]["accepted"] for i in (500, 501, 502))
    assert got[503][0]["lang_pred"] == "yy" and got[None][0]["lang_pred"] == "xx" and got[505][0] == got[505][1]
    assert got[504][0]["lang_pred"] in ("xx", "yy")


def test_only_the_text_decides(frame):
    rows = training()
    docs = frame(rows)
    model = language.fit(docs, F.lit(True))
    a = language.identify(docs.select("text", "doc_id"), model, {"doc_id": "bigint"}).collect()
    b = language.identify(docs.select("text", (F.col("doc_id") + 1000).alias("doc_id")), model, {"doc_id": "bigint"}).collect()
    assert [(r["lang_pred"], r["score"]) for r in a] == [(r["lang_pred"], r["score"]) for r in b]


@pytest.mark.parametrize("same", [8, None])
def test_one_id_repeated(frame, same):
    """The draw doesn't depend on ids, and copies are drawn once."""
    rows = [(same, t, k, None) for _, t, k, _ in training(300)]
    got = language.language_rows(frame(rows)).collect()
    assert len(got) == 600 and all(r["lang_pred"] == ("yy" if "ö" in t or "ü" in t else "xx") for r, (_, t, _, _) in zip(got, rows, strict=True))
    copies = language.language_rows(frame([(same, "alpha beta gamma delta", "xx", None)] * 600)).collect()
    assert {(r["lang_pred"], r["accepted"]) for r in copies} == {("xx", True)} and len(copies) == 600


def test_many_languages(frame):
    """More languages than one would list by hand, each of two texts."""
    rng = random.Random(2)
    words = [["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(4)] for _ in range(1100)]
    rows = [(2 * i + k, " ".join(w * 3), f"l{i}", None) for i, w in enumerate(words) for k in range(2)]
    model = language.fit(frame(rows), F.lit(True), centroids=1)
    got = language.identify(frame(rows[:64]).select("text", "lang"), model, {"lang": "string"}).collect()
    assert len(model.languages) >= 1100 and all(r["lang"] == r["lang_pred"] for r in got)


def test_letters_at_random_and_an_unlearnt_language_are_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(docs, F.lit(True))
    rng = random.Random(3)
    other = "nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura che la diritta via era smarrita ahi quanto a dir qual era".split()
    rows = [("".join(rng.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(n)),) for n in (300, 1000, 4000) for _ in range(10)]
    rows += [(" ".join(rng.choice(other) for _ in range(n // 5)),) for n in (1000, 4000) for _ in range(10)]
    got = language.identify(spark.createDataFrame(rows, "text string"), model, {"text": "string"}).collect()
    assert sum(r["accepted"] for r in got) <= 2
    kept = language.identify(docs.select("text", "doc_id"), model, {"doc_id": "bigint"}).where("accepted").count()
    assert kept >= 0.995 * docs.count()


def test_nothing_to_learn_and_empty_tables(frame):
    docs = frame([(1, "some words", None), (2, None, "en")])
    got = language.language_rows(docs).collect()
    assert [(r["lang_pred"], r["accepted"]) for r in got] == [("und", True), ("und", False)]
    assert language.language_rows(docs.limit(0)).count() == 0


def test_rejects_what_is_far_from_all_centroids(frame):
    model = language.fit(frame(training()), F.lit(True))
    rows = [("字" * 200,), ("alpha gamma " * 15,)]
    docs = frame([(i, t) for i, (t,) in enumerate(rows)])
    got = language.identify(docs.select("text", "doc_id"), model, {"doc_id": "bigint"}).collect()
    assert [r["accepted"] for r in sorted(got, key=lambda r: r["doc_id"])] == [False, True]
