import math

import numpy as np
import pytest

from pagemill.llm import embedding_dedup
from pagemill.llm.embedding_dedup import near_duplicates

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    x = {}
    for i, (_, v) in enumerate(rows):
        if v and None not in v and all(map(math.isfinite, v)) and any(v):
            a = np.array(v, np.float32).astype(np.float64)
            x[i] = a / np.linalg.norm(a)
    links = {i: [j for j in x if j != i and len(x[i]) == len(x[j]) and x[i] @ x[j] >= 0.95] if i in x else [] for i in range(len(rows))}
    out = []
    for i, (name, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min(rows[j][0] for j in seen)
        out.append((name, len(links[i]), least, name == least))
    return sorted(out)


def got(df):
    return sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in df.collect())


def test_recall_and_precision_on_planted_neighbours(spark):
    """Pairs at cosines from 0.951 to 0.999 in 64 dimensions: nearly all are found, none below the threshold."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    e = rng.normal(size=x.shape)
    e -= (e * x).sum(1)[:, None] * x
    e /= np.linalg.norm(e, axis=1)[:, None]
    c = rng.uniform(0.951, 0.999, 1500)[:, None]
    y = x * c + e * np.sqrt(1 - c**2)
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(np.concatenate([x, y, x[:200]]))]
    want, have = brute(rows), got(near_duplicates(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)))
    assert sum(h[1] for h in have) >= 0.99 * sum(w[1] for w in want)
    assert all(h[1] <= w[1] for h, w in zip(have, want, strict=True))


def test_small_table_with_every_odd_vector(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.2]), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, None), (8, []), (9, [None, 1.0]), (10, [1.0, 0.0]), (11, [1e-30, 0.0]), (12, [-1.0, 0.0]), (13, [1.0, 0.0, 0.0]), (14, [0.0, -0.0])]
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    assert got(near_duplicates(df)) == brute(rows)
    assert near_duplicates(df.limit(0)).count() == 0


def test_repeated_rows_and_null_ids(spark):
    rows = [(4, [1.0, 2.0], 0), (4, [1.0, 2.0], 0), (None, [1.0, 2.0], 0), (None, [2.0, -1.0], 0)]
    have = sorted((r["vec_id"] or -1, r["n_links"], r["component_id"], r["kept"]) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS cls", "2 AS n")).collect())
    assert [h[:2] for h in have] == [(-1, 0), (-1, 2), (4, 2), (4, 2)]
    assert {h[2] for h in have if h[1]} == {4}


def exact(ids, x, threshold=0.95):
    """vec_id -> (links, component) of vectors of one dimension."""
    x = x.astype(np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    link = x @ x.T >= threshold
    np.fill_diagonal(link, False)
    part, out = {}, {}
    for i in np.argsort(ids):
        if i in part:
            continue
        todo = [i]
        part[i] = ids[i]
        while todo:
            for j in np.flatnonzero(link[todo.pop()]):
                if j not in part:
                    part[j] = ids[i]
                    todo.append(j)
    for i, name in enumerate(ids):
        out[int(name)] = (int(link[i].sum()), int(part[i]))
    return out


def table(spark, parts):
    return spark.createDataFrame([(int(i), v.astype(np.float32).tolist(), 0) for ids, x in parts for i, v in zip(ids, x, strict=True)], SCHEMA)


@pytest.mark.parametrize("small", [100, 1024])
@pytest.mark.parametrize("seed", [0, 1, 2])
def test_components_in_few_dimensions(spark, monkeypatch, seed, small):
    """Dense tables in 3 to 8 and 20 more dimensions, with an index (small = 100) and without: chains of links cross lists and blocks."""
    monkeypatch.setattr(embedding_dedup, "SMALL", small)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 64)
    rng = np.random.default_rng(seed)
    parts = [(np.arange(600) + 1000 * d, rng.normal(size=(600, d))) for d in range(3, 9)]
    parts += [(np.arange(3) + 1000 * d, rng.normal(size=(3, d))) for d in range(9, 29)]
    want = {k: v for ids, x in parts for k, v in exact(ids, x).items()}
    have = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_duplicates(table(spark, parts)).collect()}
    links = sum(v[0] for v in want.values())
    assert sum(v[0] for v in have.values()) >= (1 if small > 600 else 0.99) * links
    assert all(have[k][0] <= v[0] for k, v in want.items())
    assert sum(have[k][1] != v[1] for k, v in want.items()) <= (0 if small > 600 else 6)


def shaped(kind, rng, n=4000, dim=64):
    if kind == "rank 4":
        return rng.normal(size=(n, 4)) @ rng.normal(size=(4, dim))
    if kind == "decaying":
        return rng.normal(size=(n, dim)) * 0.6 ** np.arange(dim)
    if kind == "clusters":
        return rng.normal(size=(40, dim))[rng.integers(0, 40, n)] + 0.18 * rng.normal(size=(n, dim))
    x = rng.normal(size=(n, dim))  # few links
    x[: n // 10] = x[n // 10 : n // 10 * 2] + 0.2 * rng.normal(size=(n // 10, dim))
    return x


@pytest.mark.parametrize("kind", ["rank 4", "decaying", "clusters", "few"])
def test_recall_on_shaped_data(spark, kind):
    """Against brute force: nearly all links, none below the threshold, and whoever has all its neighbours found is in their component."""
    x = shaped(kind, np.random.default_rng(9))
    ids = np.arange(len(x))
    want = exact(ids, x)
    have = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_duplicates(table(spark, [(ids, x)])).collect()}
    assert sum(v[0] for v in have.values()) >= 0.99 * sum(v[0] for v in want.values()) > 0
    assert all(have[k][0] <= v[0] for k, v in want.items())
    assert sum(have[k][1] != v[1] for k, v in want.items()) <= 0.01 * len(x)
