"""Near-duplicate embeddings: coarse inverted lists with product-quantised residuals, table-lookup distances, exact rerank.

1. Vectors with equal components are one class from the start, so copies are never paired.
2. Coarse centroids and sub-space codes are fitted on a bounded sample of the classes, and every
   class is indexed: its nearest list, the codes of its residual, and the error they leave.
3. Every class is a query. It probes its own list and each list whose border (the plane midway
   between two centroids) lies within a reach of it. A link never crosses a border further than
   the radius of the threshold, but probing that far opens most lists. The reach is the larger
   of two that are taken from the table: what neighbours in the directions of other vectors
   nearby would need, and what the links of some vectors, compared with all rows, do need.
4. In a list, distances from lookup tables, less the stored error, rule out members for
   certain; the cosine of the rest is computed in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_partitions, pick, stored
from .graph import components

THRESHOLD = 0.95
#: The index is fitted on about SAMPLE classes, or fewer where they exceed SAMPLE_BYTES; it has a list for 8 of them at most.
SAMPLE, SAMPLE_BYTES = 32_768, 16 << 20
SUBSPACES, CODES, ROUNDS = 8, 64, 8
#: Sampled classes whose links are measured against all rows, the share of links that the reach has to cover, bins of the measure.
MEASURED, RECALL, BINS = 512, 0.998, 512
#: Members of a block, queries of a share, bytes of a task; dimensions with up to SMALL classes are compared without an index.
BLOCK, SHARE, TASK_BYTES, SMALL = 2048, 8192, 32 << 20, 1024


def usable(v: list | None, kind: type = np.float64) -> np.ndarray | None:
    """The vector, or None if it can't be compared."""
    if not v or None in v:
        return None
    a = np.array(v, kind)
    return a if np.isfinite(a).all() and a.any() else None


def stacked(blobs, kind: type) -> np.ndarray:
    """Unit vectors in double precision of stored ones."""
    return unit(np.stack([np.frombuffer(v, kind) for v in blobs]).astype(np.float64))


def unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(-1, keepdims=True)  # squares neither overflow nor vanish
    x = x / big
    return x / np.sqrt((x * x).sum(-1, keepdims=True))


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        own = nearest(x, c)
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    for i in range(0, len(x), 4096):
        out[i : i + 4096] = ((c * c).sum(1) - 2 * (x[i : i + 4096] @ c.T)).argmin(1)
    return out


@dataclass
class Index:
    lists: np.ndarray  # centroids
    books: list[np.ndarray]  # code vectors of each sub-space
    cuts: list[slice]
    radius: float
    reach: float = 0.0  # how far beyond a border is probed

    @classmethod
    def fit(cls, x: np.ndarray, n: int, threshold: float) -> Index:
        """x: unit vectors of a sample; n: how many there are in all."""
        rng = np.random.default_rng(11)
        k = min(max(1, 1 << round(math.log2(max(1.0, math.sqrt(n))))), max(1, len(x) // 8))
        lists = kmeans(x, k, rng)
        rest = x - lists[nearest(x, lists)]
        edges = np.linspace(0, x.shape[1], min(SUBSPACES, x.shape[1]) + 1).astype(int)
        cuts = [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        index = cls(lists, [kmeans(np.ascontiguousarray(rest[:, c]), CODES, rng) for c in cuts], cuts, math.sqrt(2 - 2 * threshold) + 1e-9)
        index.reach = index.likely_reach(x)
        return index

    def likely_reach(self, x: np.ndarray) -> float:
        """What neighbours at the radius need, if they lie in the directions in which other vectors lie nearby: few directions cross more borders than many."""
        some = x[: 4 * MEASURED]
        step = np.zeros_like(some)
        for i in range(0, len(some), 256):
            cos = some[i : i + 256] @ x[: 16 * MEASURED].T
            cos[cos > 1 - 1e-9] = -2
            step[i : i + 256] = x[cos.argmax(1)] - some[i : i + 256]
        size = np.linalg.norm(step, axis=1, keepdims=True)
        there = unit(some + step * np.divide(self.radius, size, out=np.zeros_like(size), where=size > 0))
        need = self.needed(some, nearest(some, self.lists), nearest(there, self.lists))
        return float(np.quantile(need, RECALL)) if len(need) else 0.0

    def needed(self, x: np.ndarray, own: np.ndarray, other: np.ndarray) -> np.ndarray:
        """How far each x lies from its own list's border with another one, at most the radius where a link crosses it."""
        a, b = self.lists[own], self.lists[other]
        apart = np.sqrt(((a - b) ** 2).sum(1))
        gap = ((x - b) ** 2).sum(1) - ((x - a) ** 2).sum(1)
        return np.divide(gap, 2 * apart, out=np.zeros(len(x)), where=apart > 0)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and error of each vector."""
        own = nearest(x, self.lists)
        rest = x - self.lists[own]
        codes = np.stack([nearest(rest[:, c], b) for c, b in zip(self.cuts, self.books, strict=True)], 1)
        back = np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], 1)
        return own, codes.astype(np.uint8), np.sqrt(((rest - back) ** 2).sum(1))

    def probes(self, x: np.ndarray) -> list[np.ndarray]:
        """The lists that each query opens."""
        d = (self.lists**2).sum(1) - 2 * (x @ self.lists.T)
        own = d.argmin(1)
        apart = np.sqrt(np.maximum(((self.lists[own][:, None] - self.lists[None]) ** 2).sum(2), 1e-18))
        beyond = (d - d[np.arange(len(x)), own][:, None]) / (2 * apart)
        ok = beyond <= min(self.reach, self.radius)
        ok[np.arange(len(x)), own] = True
        return [np.flatnonzero(r) for r in ok]

    def tables(self, x: np.ndarray, at: int) -> np.ndarray:
        """Squared distances of a query's residual in list `at` to each code: (queries, sub-spaces, codes)."""
        rest = x - self.lists[at]
        out = np.full((len(x), len(self.books), CODES), np.inf)
        for i, (c, b) in enumerate(zip(self.cuts, self.books, strict=True)):
            r = rest[:, c]
            out[:, i, : len(b)] = np.maximum((r * r).sum(1)[:, None] - 2 * (r @ b.T) + (b * b).sum(1), 0)
        return out


def classes_of(vectors: DataFrame, kind: type) -> DataFrame:
    """vec_id, dim, cls, vec (bytes) of each row; nulls but for vec_id where a vector can't be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                part = b.slice(i, 2048)
                vs = [usable(v, kind) for v in part.column("embedding").to_pylist()]
                raw = [None if v is None else (v + kind(0)).tobytes() for v in vs]  # + 0: no negative zeros
                yield pa.RecordBatch.from_arrays([part.column("vec_id").cast(pa.int64()), pa.array([None if v is None else len(v) for v in vs], pa.int32()), pa.array([None if r is None else xxhash.xxh3_64_intdigest(r) >> 1 for r in raw], pa.int64()), pa.array(raw, pa.binary())], ["vec_id", "dim", "cls", "vec"])

    return pick(vectors, vec_id="vec_id", embedding="embedding").mapInArrow(run, "vec_id long, dim int, cls long, vec binary")


def sampled(classes: DataFrame, n: int, dim: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and unit vectors of the classes whose hash is low, in an order of no meaning."""
    rate = min(1.0, min(SAMPLE, SAMPLE_BYTES / (8 * dim)) / max(n, 1))
    got = sorted((r["cls"], bytes(r["vec"])) for r in classes.where(F.pmod(F.xxhash64("cls"), F.lit(1 << 30)) < int(rate * (1 << 30)) + 1).select("cls", "vec").collect())
    return np.array([c for c, _ in got], np.int64), stacked([v for _, v in got], kind) if got else np.empty((0, dim))


def measured_reach(classes: DataFrame, index: Index, names: np.ndarray, x: np.ndarray, threshold: float, kind: type) -> float:
    """The reach that covers RECALL of the links that the first MEASURED sampled classes have with all rows; a histogram of fixed size comes to the driver."""
    names, x = names[:MEASURED], x[:MEASURED]
    own = nearest(x, index.lists)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS + 1, np.int64)
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                y = stacked(part.column("vec").to_pylist(), kind)
                at, q = np.nonzero((y @ x.T >= threshold) & (part.column("cls").to_numpy()[:, None] != names[None]))
                if len(at):
                    need = index.needed(x[q], own[q], nearest(y[at], index.lists))
                    total += np.bincount(np.clip(np.ceil(need / index.radius * BINS), 0, BINS).astype(np.int64), minlength=BINS + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BINS + 1), pa.int32()), pa.array(total)], ["bin", "n"])

    found = np.zeros(BINS + 1, np.int64)
    for r in classes.select("cls", "vec").mapInArrow(measure, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        found[r["bin"]] = r["n"]
    return float(np.searchsorted(np.cumsum(found), RECALL * found.sum())) / BINS * index.radius if found.any() else 0.0


class Links:
    """Links of queries with the members of one block: how many vectors each query links with, and links that connect it with all of them."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, x: np.ndarray, threshold: float):
        self.ids, self.copies, self.x, self.threshold = ids, copies, x, threshold
        self.root = np.arange(len(ids))  # members with one root are connected by links given out already
        self.u: list[int] = []
        self.v: list[int] = []
        self.n: list[int] = []

    def ask(self, cls: int, q: np.ndarray, near: np.ndarray) -> None:
        """near: the members that may link."""
        at = np.flatnonzero(near & (self.ids != cls))
        at = at[(self.x[at] * q).sum(1) >= self.threshold] if len(at) else at
        if not len(at):
            return
        roots, first = np.unique(self.root[at], return_index=True)
        if len(roots) > 1:
            self.root[np.isin(self.root, roots)] = roots[0]
        for i, k in enumerate(at[first]):
            self.u.append(cls)
            self.v.append(self.ids[k])
            self.n.append(0 if i else int(self.copies[at].sum()))


LINKS = "u long, v long, n long"


def link_frame(found: list[Links]) -> pd.DataFrame:
    return pd.DataFrame({c: np.array([x for f in found for x in getattr(f, c)], np.int64) for c in ("u", "v", "n")})


def compared(pdf: pd.DataFrame, threshold: float, kind: type) -> pd.DataFrame:
    """cls, vec, copies of a small dimension: all links, without an index."""
    x, ids = stacked(pdf["vec"], kind), pdf["cls"].to_numpy()
    found = Links(ids, pdf["copies"].to_numpy(), x, threshold)
    for i in range(0, len(x), 256):
        near = x[i : i + 256] @ x.T >= threshold - 1e-9
        for j, row in enumerate(near):
            found.ask(int(ids[i + j]), x[i + j], row)
    return link_frame([found])


def search(classes: DataFrame, n: int, dim: int, threshold: float, kind: type) -> DataFrame:
    """classes(cls, vec, copies), n of one dimension -> u, v, n: in each block that holds any, how many vectors a class links with, and links that connect it with them."""
    names, sample = sampled(classes, n, dim, kind)
    index = Index.fit(sample, n, threshold)
    index.reach = max(index.reach, measured_reach(classes, index, names, sample, threshold, kind))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                x = stacked(part.column("vec").to_pylist(), kind)
                own, codes, error = index.encode(x)
                ok = index.probes(x)
                yield pa.RecordBatch.from_arrays([part.column("cls"), part.column("vec"), part.column("copies"), pa.array(own, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error, pa.float64()), pa.array(ok, pa.list_(pa.int32()))], ["cls", "vec", "copies", "own", "codes", "error", "probes"])

    placed = stored(classes.mapInArrow(place, "cls long, vec binary, copies long, own int, codes binary, error double, probes array<int>"), "placed")
    members = placed.groupBy("own").agg(F.count("*").alias("members"))
    asked = placed.select(F.explode("probes").alias("own")).groupBy("own").agg(F.count("*").alias("asked"))
    lists = members.join(asked, "own").collect()  # one row a list
    blocks = F.create_map(*[F.lit(x) for r in lists for x in (r["own"], math.ceil(r["members"] / BLOCK))])
    shares = F.create_map(*[F.lit(x) for r in lists for x in (r["own"], math.ceil(r["asked"] / SHARE))])
    left = placed.select("own", "cls", "vec", "copies", "codes", "error", F.pmod(F.xxhash64("cls"), F.element_at(blocks, F.col("own"))).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.element_at(shares, F.col("own")) - 1)).alias("s"))
    right = placed.select(F.col("cls").alias("q"), F.col("vec").alias("qvec"), F.explode("probes").alias("own")).where(F.element_at(blocks, F.col("own")).isNotNull())
    right = right.select("own", "q", "qvec", F.explode(F.sequence(F.lit(0), F.element_at(blocks, F.col("own")) - 1)).alias("b"), F.pmod(F.xxhash64("q"), F.element_at(shares, F.col("own"))).cast("int").alias("s"))
    carried = sum(r["asked"] * math.ceil(r["members"] / BLOCK) + r["members"] * math.ceil(r["asked"] / SHARE) for r in lists)
    tasks = max(n_partitions(classes.sparkSession), math.ceil(carried * dim * np.dtype(kind).itemsize / TASK_BYTES))
    task = F.pmod(F.xxhash64("own", "b", "s"), F.lit(tasks)).alias("task")

    def scan(members: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = []
        held = {k: v for k, v in members.groupby(["own", "b", "s"], sort=False)}
        for key, mine in queries.groupby(["own", "b", "s"], sort=False):
            if (block := held.get(key)) is None:
                continue
            error = block["error"].to_numpy()
            codes = np.stack([np.frombuffer(c, np.uint8) for c in block["codes"]]).astype(np.int64)
            links = Links(block["cls"].to_numpy(), block["copies"].to_numpy(), stacked(block["vec"], kind), threshold)
            found.append(links)
            for i in range(0, len(mine), 64):
                part = mine.iloc[i : i + 64]
                q = stacked(part["qvec"], kind)
                t = index.tables(q, key[0])
                far = sum(t[:, m, codes[:, m]] for m in range(codes.shape[1]))
                near = np.sqrt(far) - error <= index.radius + 1e-7
                for j in np.flatnonzero(near.any(1)):
                    links.ask(int(part["q"].iloc[j]), q[j], near[j])
        return link_frame(found)

    l = left.select(task, "own", "b", "s", "cls", "vec", "copies", "codes", "error").groupBy("task")
    r = right.select(task, "own", "b", "s", "q", "qvec").groupBy("task")
    return l.cogroup(r).applyInPandas(scan, LINKS)


def near_duplicates(vectors: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept: cosine links of at least `threshold` between all rows.

    Needs vec_id and embedding; labels and other columns are ignored. Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing. Equal vectors
    (repeated rows too) link with one another and count as links; vectors of different
    dimensions don't. A null vec_id is never a component's id unless all in it are null. An
    empty table gives no rows. Found links are exact; a pair is missed only if it lies across
    a list's border by more than the reach, which covers RECALL of the links measured. Dimensions
    are searched one after another, all small ones in one pass. A vector that is equally near to
    several centroids lies in the first one's list.
    """
    spark = vectors.sparkSession
    kind = np.float32 if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else np.float64
    rows = stored(classes_of(vectors, kind), "vectors")
    # partial sums hold one vector for each class and task; a group of copies is one row from there on
    ids = rows.where("cls IS NOT NULL").groupBy("dim", "cls").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.min("vec").alias("vec"))
    classes = stored(ids, "classes")
    dims = classes.groupBy("dim").agg(F.count("*").alias("n"))
    large = {r["dim"]: r["n"] for r in dims.where(F.col("n") > SMALL).collect()}  # a row for SMALL vectors at least
    small = classes.where(~F.col("dim").isin(*large)) if large else classes
    edges = small.select("dim", "cls", "vec", "copies").groupBy("dim").applyInPandas(lambda pdf: compared(pdf, threshold, kind), LINKS)
    for d, n in sorted(large.items()):
        edges = edges.union(search(classes.where(F.col("dim") == d).select("cls", "vec", "copies"), n, d, threshold, kind))
    edges = stored(edges, "links")
    counts = edges.groupBy(F.col("u").alias("cls")).agg(F.sum("n").alias("n"))
    parts = components(edges.select("u", "v")).withColumnRenamed("node", "cls")
    rooted = classes.select("cls", "rep", "copies").join(parts, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = rooted.groupBy("component").agg(F.min("rep").alias("component_id"))
    known = rooted.join(least, "component").join(counts, "cls", "left").select("cls", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("links"), "component_id")
    out = rows.select("vec_id", "cls").join(known, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
