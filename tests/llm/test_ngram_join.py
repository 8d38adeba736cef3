import collections
import random

import numpy as np
import pytest

from pagemill.llm import ngram_join as J
from pagemill.llm.graph import components
from pagemill.llm.queries import op1_ngram_jaccard_join


def brute(docs):
    """doc_id -> (set size, component), by comparing all that share a shingle."""
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    for i, s in sets.items():
        for j, c in collections.Counter(j for x in s for j in where[x] if j < i).items():
            if 100 * c >= 80 * (len(s) + len(sets[j]) - c):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.select("doc_id", "n_shingles", "component_id").collect()}


def test_whole_table_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert result(op1_ngram_jaccard_join(spark, sf)) == brute(docs)


@pytest.mark.parametrize("hot", [1, 1000])
def test_families_around_the_threshold(frame, hot):
    """Edited copies of one text, so that links lie just above and below 80 percent; a passage in all others."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(120)]
    passage = [word() for _ in range(55)]
    docs = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(0, 7)):
            w[rng.randrange(len(w))] = word()
        docs.append((i, " ".join(w)))
    docs += [(100 + i, " ".join([word() for _ in range(rng.randrange(5, 60))] + passage)) for i in range(40)]
    docs += [(200, "a b"), (201, "A  b"), (202, "a b c"), (203, ""), (204, None), (205, " \n"), (206, "a b c d e"), (207, "x " * 3000)]
    assert result(J.jaccard_join(frame(docs), hot=hot)) == brute(docs)


def edited(words, at):
    """The text with the words at these places exchanged: five shingles each, if they lie apart."""
    return [f"{w}-{i}" if i in at else w for i, w in enumerate(words)]


def test_links_between_two_parts_of_a_group(frame):
    """A group around a2, where a1 and b1 link but neither b1 nor b2 is most similar to one of the a's."""
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(1004)]
    places = list(range(10, 1000, 10))
    rng.shuffle(places)
    a1, a2 = base, edited(base, set(places[:5]))
    b1, b2 = edited(base, set(places[5:25])), edited(base, set(places[5:30]))
    docs = [(i, " ".join(w)) for i, w in enumerate([b2, b1, a1, a2, a2, a2])]
    want = brute(docs)
    assert {c for _, c in want.values()} == {0}
    assert result(J.jaccard_join(frame(docs))) == want


def test_chains_of_edits(frame):
    """Each text is an edit of the one before, with side branches, so that groups hold several parts."""
    rng = random.Random(12)
    docs = []
    for chain in range(8):
        w = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(304)]
        for step in range(24):
            w = edited(w, set(rng.sample(range(10, 300, 6), rng.randrange(4, 9))))
            docs.append((1000 * chain + 2 * step, " ".join(w)))
            docs.append((1000 * chain + 2 * step + 1, " ".join(edited(w, set(rng.sample(range(10, 300, 6), rng.randrange(1, 8)))))))
    rng.shuffle(docs)
    assert result(J.jaccard_join(frame(docs))) == brute(docs)


@pytest.mark.parametrize("block, hot", [(256, 16), (2, 16), (2, 1)])
def test_chains_of_windows(frame, monkeypatch, block, hot):
    """A-B and C-D share 191 of 201 shingles, B-C 175 of 217: each middle's best partner isn't in the other half of its chain."""
    monkeypatch.setattr(J, "BLOCK", block)
    rng = random.Random(14)
    docs = []
    for chain in range(200 if block > 2 else 60):
        w = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(260)]
        docs += [(10 * chain + k, " ".join(w[at : at + 200])) for k, at in enumerate((0, 5, 26, 31))]
    rng.shuffle(docs)
    got = J.jaccard_join(frame(docs), hot=hot)
    want = brute(docs)
    assert {c for _, c in want.values()} == {10 * k for k in range(len(docs) // 4)}
    assert result(got) == want
    assert sorted(map(tuple, got.select("doc_id", "n_links").collect())) == linked_rows(docs) if len(docs) < 300 else True


def linked_rows(docs):
    """How many other rows each row links with, by comparing all pairs."""
    sets = []
    for _, t in docs:
        w = (t or "").lower().split()
        sets.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    return sorted((i, sum(1 for k, o in enumerate(sets) if k != j and s and 100 * len(s & o) >= 80 * len(s | o))) for j, ((i, _), s) in enumerate(zip(docs, sets, strict=True)))


def test_one_large_group_is_dealt_to_many_tasks(spark):
    """Its members and queries meet the group's sizes in the tasks that hold them, not in one."""
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "64"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        sizes = spark.createDataFrame([(7, 16, 2), (8, 1, 1)], "grp long, blocks int, shares int")
        rows = spark.range(4000).select(J.F.lit(7).cast("long").alias("grp"), J.F.col("id").alias("cls"))
        rows = rows.union(spark.createDataFrame([(8, -1), (9, -2), (None, -3)], "grp long, cls long"))
        got = J.with_sizes(rows, sizes).withColumn("task", J.F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r["grp"], r["cls"], r["blocks"], r["shares"]) for r in got) == [(7, i, 16, 2) for i in range(4000)] + [(8, -1, 1, 1)]
    assert max(collections.Counter(r["task"] for r in got).values()) <= 2000


def test_number_of_links(frame, monkeypatch):
    """Inside groups and between them, in one block or several, copies and repeated rows included."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    docs = [(500, "a b"), (501, "A  b"), (502, ""), (503, None)]
    for family in range(3):
        base = [word() for _ in range(120)]
        for i in range(40):
            text = " ".join(edited(base, {rng.randrange(120) for _ in range(rng.randrange(0, 7))}))
            docs += [(100 * family + i, text)] * rng.choice((1, 1, 1, 2))
    monkeypatch.setattr(J, "BLOCK", 16)
    got = J.jaccard_join(frame(docs)).select("doc_id", "n_links").collect()
    assert sorted(map(tuple, got)) == linked_rows(docs)


def test_repeated_rows_null_ids_and_empty_tables(frame, spark):
    docs = frame([(5, "one two three four five six"), (5, "one two three four five six"), (None, "one two three four five six"), (None, ""), (9, "One TWO three four five six")])
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in J.jaccard_join(docs).collect())
    assert got == [(-1, 0, None), (-1, 2, 5), (5, 2, 5), (5, 2, 5), (9, 2, 5)]
    assert J.jaccard_join(docs.limit(0)).count() == 0
    assert [r["component_id"] for r in J.jaccard_join(frame([(None, "lonely words here")])).collect()] == [None]


def test_prefix_bounds_hold_for_random_sets():
    """Whatever two sets, if they link, their prefixes share as many hits as needed."""
    rng = np.random.default_rng(0)
    for _ in range(3000):
        n, m = rng.integers(1, 120, 2)
        common = int(rng.integers(0, min(n, m) + 1))
        if 100 * common < 80 * (n + m - common):
            continue
        u = np.sort(rng.permutation(10_000)[: n + m - common])
        pick = rng.permutation(len(u))
        a, b = np.sort(u[pick[:n]]), np.sort(u[np.concatenate([pick[:common], pick[n:]])])
        hits = len(np.intersect1d(a[: J.prefix_length(int(n))], b[: J.prefix_length(int(m))]))
        assert hits >= 1 and hits >= min(J.needed_hits(n, m), J.needed_hits(m, n))


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
