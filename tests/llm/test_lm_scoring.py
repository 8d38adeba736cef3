import collections
import math
import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pagemill.llm import lm_scoring as L
from pagemill.llm.queries import op2_lm_scoring

SF = "/root/testdata/sf0.01"


def test_base_and_counts_against_brute_force_and_gain_on_held_out(spark):
    docs = {r["doc_id"]: (r["text"] or "").encode().lower().split() + [None] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    c = collections.Counter(w for i, ws in docs.items() if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    rows = op2_lm_scoring(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ws = docs[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"]), len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert r["score"] < 0
    out = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def probabilities(texts, held, n):
    """(word before, word) -> averaged probability for all pairs of one chunk's texts; the steps of the operator by hand, with n buckets."""
    import pyarrow as pa

    c = L.Chunk(texts + held)
    train = np.array([True] * len(texts) + [False] * len(held))
    by = lambda rows, *kinds: {b: [r for r in rows if r["bucket"] == b and r["kind"] in kinds] for b in range(n)}
    table = lambda rows: pa.Table.from_pylist(rows, L.SCHEMA)
    asked = L.requests(1, c, train, n)
    rows = []
    for b in range(n):
        mine = [r for r in asked.to_pylist() if r["bucket"] == b]
        if mine:
            rows += L.cells_of_bucket(pa.Table.from_pylist(mine, asked.schema), n).to_pylist()
    add = lambda rows, k: [int(x) for x in sum(L.numbers(r["n"], np.int64) for r in rows if r["kind"] == "sums")[:k]]
    total = lambda rows: [r for m in by(rows, "message").values() if m for r in L.totalled(table(m)).to_pylist()]
    _, vocabulary, customers, tables = add(rows, 4)
    known, seats, root = [r for r in rows if r["kind"] in ("cells", "place")], rows, []
    for number in range(L.BURN_IN + L.SAMPLES):
        totals = total(seats)
        known += [r | {"other": number - L.BURN_IN - 1} for r in totals if r["kind"] == "total" and number != L.BURN_IN]
        answers = by(totals, "answer")
        seats = [r for b, left in by(seats, "seats").items() for r in L.swept(table(left), table(answers[b]), n, number, (vocabulary, customers, tables)).to_pylist()]
        customers, tables = add(seats, 2)
        if number >= L.BURN_IN:
            root.append((customers, tables))
            known += [r for r in seats if r["kind"] == "sample"]
    known += [r | {"other": L.SAMPLES - 1} for r in total(seats) if r["kind"] == "total"]
    answers = [r for m in by(known, "cells", "place", "total", "sample").values() for r in L.replies(table(m)).to_pylist()]
    _, out = L.pair_probabilities(c, answers, n, vocabulary, root)
    return {(c.keys[u], c.keys[w]): p for u, w, p in zip(c.pair_before, c.pair_word, out, strict=True)}, c


CORPUS = ["a b a c a b", "b c c a", "d a b", "a b", "c a b a b a b d"] * 4


def test_predictions_add_up_to_one():
    """Over all words of a small corpus and the unknown one, after every word."""
    words = ["a", "b", "c", "d", "unseen"]
    p, _ = probabilities(CORPUS, [f"{u} {w}" for u in words for w in words], 3)
    for u in {u for u, _ in p}:
        own = [x for (v, _), x in p.items() if v == u]
        if len(own) == 6 or u != L.START_KEY:
            assert len(own) == 6 and math.isclose(sum(own), 1, rel_tol=1e-5)


def test_buckets_change_nothing():
    one, _ = probabilities(CORPUS, ["a d zz"], 1)
    many, _ = probabilities(CORPUS, ["a d zz"], 16)
    assert one == many


def seated_one_by_one(texts, sweeps=400, burn=100):
    """Plain Gibbs sampling of the same model, customer by customer: (word before, word) -> averaged probability."""
    rng = np.random.default_rng(3)
    (d1, d0), (s1, s0) = L.DISCOUNT, L.STRENGTH
    tokens = [(u, w) for t in texts for u, w in zip(["<"] + t.split(), t.split() + [">"], strict=True)]
    words = {w for _, w in tokens}
    low, top = collections.defaultdict(list), collections.defaultdict(list)  # sizes of tables by (u, w), by w

    def p0(w):
        c, t = sum(map(sum, top.values())), sum(map(len, top.values()))
        return (sum(top[w]) - d0 * len(top[w]) + (s0 + d0 * t) / (len(words) + 1)) / (s0 + c)

    def tables(u):
        return sum(len(v) for (x, _), v in low.items() if x == u)

    def sit(sizes, d, new):
        x = rng.random() * (sum(sizes) - d * len(sizes) + new)
        for i, size in enumerate(sizes):
            if (x := x - (size - d)) < 0:
                sizes[i] += 1
                return False
        sizes.append(1)
        return True

    def leave(sizes):
        i = rng.choice(len(sizes), p=np.array(sizes) / sum(sizes))
        sizes[i] -= 1
        return sizes[i] == 0 and (sizes.pop(i) == 0)

    def enter(u, w):
        if sit(low[u, w], d1, (s1 + d1 * tables(u)) * p0(w)):
            sit(top[w], d0, (s0 + d0 * sum(map(len, top.values()))) / (len(words) + 1))

    for u, w in tokens:
        enter(u, w)
    total = collections.Counter()
    for k in range(sweeps):
        for u, w in tokens:
            if leave(low[u, w]):
                leave(top[w])
            enter(u, w)
        if k >= burn:
            for u, w in set(tokens):
                n = sum(sum(v) for (x, _), v in low.items() if x == u)
                total[u, w] += (sum(low[u, w]) - d1 * len(low[u, w]) + (s1 + d1 * tables(u)) * p0(w)) / (s1 + n) / (sweeps - burn)
    return total


def test_against_seating_one_by_one(monkeypatch):
    """Mean log probability of a token, and single probabilities, near those of a long plain run."""
    import xxhash

    monkeypatch.setattr(L, "SAMPLES", 12)
    texts = ["a b a c a b", "b c c a e", "d a b f", "a b g", "c a b a b h d", "e f g h"] * 2
    want = seated_one_by_one(texts, 150, 50)
    got, _ = probabilities(texts, [], 2)
    key = lambda w: {"<": L.START_KEY, ">": L.END_KEY}.get(w, np.uint64(xxhash.xxh3_64_intdigest(w)))
    pairs = [(want[p], got[key(p[0]), key(p[1])]) for p in want]
    assert all(abs(a - b) < 0.06 for a, b in pairs)
    assert abs(np.mean([math.log10(b / a) for a, b in pairs])) < 0.03


def test_tables_hold_their_customers():
    rng = np.random.default_rng(1)
    c = np.array([1, 2, 10, 1000, 3])
    t = L.Tables(np.arange(5), c, 5, 0.75)
    for k in range(200):
        who = np.flatnonzero(t.c > 1)
        t.leave(who, rng.random(len(who)))
        t.enter(who, rng.random(len(who)), np.full(len(who), 3.0))
        some = np.array([1, 3])
        part = t.part(some)
        part.enter(np.arange(2), rng.random(2), np.ones(2))
        part.leave(np.arange(2), rng.random(2))
        t.put(some, part)
        assert (np.bincount(t.cell, t.size, 5) == c).all() and (t.c == c).all() and (t.t == np.bincount(t.cell, minlength=5)).all()
        assert t.size.min() > 0 and (np.diff(t.cell) >= 0).all()
    assert 1 < t.t[3] < 40


def test_scores_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    scores, was = [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions, buckets, files in ((3, None, docs), (64, 100, docs.repartition(5))):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            scores.append({r["doc_id"]: (r["n_known"], r["score"]) for r in L.score_documents(files, held, buckets=buckets).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert scores[0].keys() == scores[1].keys()
    assert all(v[0] == scores[1][k][0] and math.isclose(v[1], scores[1][k][1], rel_tol=1e-9) for k, v in scores[0].items())


def test_edges(frame):
    docs = frame([(1, "a b c"), (1, "a b c"), (None, "a b"), (3, None), (4, ""), (5, "zzz " * 5000)])
    got = L.score_documents(docs, F.lit(False)).collect()
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in got) == [(-1, 3), (1, 4), (1, 4), (3, 1), (4, 1), (5, 5001)]
    assert all(r["n_known"] == r["n_tokens"] and r["train_tokens"] == 5014 for r in got)
    none = L.score_documents(docs, F.lit(True)).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0 and abs(r["score"]) < 1e-6 for r in none)
    assert L.score_documents(docs.limit(0), F.lit(False)).count() == 0


def law_of_tables(c, d, weight):
    """Chances of 1 to c tables of c customers, weight(t) being that of a new table beside t others; from generalized Stirling numbers."""
    logs = np.array([-np.inf, 0.0])
    with np.errstate(divide="ignore"):
        for n in range(1, c):
            logs = np.logaddexp(np.append(-np.inf, logs), np.append(logs + np.log(n - d * np.arange(n + 1)), -np.inf))
    logs = logs[1:] + np.cumsum([math.log(weight(k)) for k in range(c)])
    p = np.exp(logs - logs.max())
    return p / p.sum()


def test_a_sweep_moves_every_customer():
    """One sweep takes cells, small and large, from a first seating far off to about the tables that their customers would have."""
    for c in (200, 1500):
        cells, tables, p = 40, 4000, 0.02
        contexts = np.arange(cells, dtype=np.uint64) * np.uint64(977)
        of = lambda x: np.full(cells, x, np.uint32)
        seats = L.row("seats", 0, keys=np.array([7], np.uint64), single=np.array([200_000], np.uint32), word=of(0), context=np.arange(cells, dtype=np.uint32), contexts=L.packed(contexts), count=of(c))
        table = lambda r: pa.Table.from_pylist([r], L.SCHEMA)
        out = L.swept(table(seats), table(L.row("answer", 0, 0, t=of(tables))), 1, 0, (100_000, 10_000_000, 100_000)).to_pylist()
        (message,) = [r for r in out if r["kind"] == "message"]
        got = L.numbers(message["t"], np.uint32).astype(float) + 1
        s, d = L.STRENGTH[0], L.DISCOUNT[0]
        want = law_of_tables(c, d, lambda k, s=s, d=d, p=p: (s + d * (tables - 1 + k)) * p) @ np.arange(1, c + 1)
        assert 0.8 * want < got.mean() < 1.2 * want


class Fixed:
    """A parent that gives a word one probability, whatever happens below."""

    p = 0.05

    def leave(self):
        pass

    def enter(self):
        pass


def test_moves_keep_the_law_of_tables():
    d, s, c, draw = L.DISCOUNT[0], 16.0, 12, random.Random(5).random
    want = law_of_tables(c, d, lambda k: (s + d * k) * Fixed.p)
    t, sizes, n = 1, [c], 8000
    seen = np.zeros((2, c))
    for _ in range(n):
        t, sizes = L.moved(c, t, s, d, Fixed(), draw), L.turned(sizes, s, d, Fixed(), draw)
        assert sum(sizes) == c and 0 not in sizes
        seen[0, t - 1] += 1
        seen[1, len(sizes) - 1] += 1
    assert np.abs(seen / n - want).max() < 0.03
    for c, tables, vocabulary in ((30, 900, 600), (5, 50, 5), (2, 1, 3), (150, 3, 1)):
        want = law_of_tables(c, L.DISCOUNT[1], lambda k, a=tables, v=vocabulary: (L.STRENGTH[1] + L.DISCOUNT[1] * (a + k)) / (v + 1))
        got = L.parent_tables(np.full(20_000, c), np.full(20_000, tables), vocabulary, L.mixed(np.arange(20_000, dtype=np.uint64)))
        assert np.abs(np.bincount(got, minlength=c + 1)[1:] / 20_000 - want).max() < 0.02
        place, seen = L.Place(c, 1, 10_000, tables, vocabulary, draw), np.zeros(c)
        for _ in range(n):
            for _ in range(5):
                place.leave()
                place.enter()
            seen[place.t - 1] += 1
        assert place.c == c and np.abs(seen / n - want).max() < 0.05


def test_large_cells_like_small_ones(monkeypatch):
    """The same corpus with table sizes kept for all cells and for none."""
    texts = ["a b a c a b", "b c c a e", "d a b f", "a b g", "c a b a b h d", "e f g h"] * 2
    monkeypatch.setattr(L, "SAMPLES", 300)
    small, _ = probabilities(texts, [], 2)
    monkeypatch.setattr(L, "LARGE", 1)
    large, _ = probabilities(texts, [], 2)
    assert small.keys() == large.keys() and all(abs(p - large[k]) < 0.03 for k, p in small.items())
    assert abs(np.mean([math.log10(p / large[k]) for k, p in small.items()])) < 0.02


def test_one_customer_leaves_an_empty_place():
    place = L.Place(1, 1, 10, 5, 6, random.Random(1).random)
    place.leave()
    assert (place.c, place.t) == (0, 0)
    place.enter()
    assert (place.c, place.t) == (1, 1)
