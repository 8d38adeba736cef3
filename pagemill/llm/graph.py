"""Connected components of an edge table, without collecting it anywhere."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, n_partitions, rows_of, stored


#: Edges that are contracted at once where they lie, edges to a task where they are dealt out, keys that the edges of a node are spread over.
AT_ONCE, TASK_EDGES, SALTS = 200_000, 500_000, 16


class Stars:
    """Union-find over some edges."""

    def __init__(self):
        self.root: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = self.root
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    def add(self, u: int, v: int) -> None:
        a, b = self.find(u), self.find(v)
        if a != b:
            self.root[max(a, b)] = min(a, b)

    def edges(self) -> Iterator[pa.RecordBatch]:
        """Each node but the least of its part, with that least one."""
        pairs = [(r, x) for x in list(self.root) if (r := self.find(x)) != x]
        for i in range(0, len(pairs), 100_000):
            part = pairs[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in part], pa.int64()), pa.array([p[1] for p in part], pa.int64())], ["u", "v"])


def contracted(at_once: int | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The edges of one partition as stars, at_once of them at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stars, n = Stars(), 0
        for u, v in rows_of(batches, "u", "v"):
            stars.add(u, v)
            n += 1
            if n == at_once:
                yield from stars.edges()
                stars, n = Stars(), 0
        yield from stars.edges()

    return run


def _contract(edges: DataFrame) -> DataFrame:
    """Edges made stars where they lie, then dealt by their larger node, so that all smaller neighbours of a node meet, and made stars there.

    In a star the node with many edges is the smaller one, so no task gets a large part of them.
    """
    near = stored(edges.mapInArrow(contracted(AT_ONCE), "u long, v long"), "edges")
    tasks = max(n_partitions(edges.sparkSession), math.ceil(near.count() / TASK_EDGES))
    out = stored(near.repartition(tasks, "v").mapInArrow(contracted(), "u long, v long"), "edges")
    discard(near)
    return out


def _settled(e: DataFrame) -> bool:
    """Whether all is stars: each node has one centre, and no centre has one."""
    n = e.agg(F.count("*").alias("n"), F.countDistinct("v").alias("nodes")).first()
    return n["n"] == n["nodes"] and not e.select("u").distinct().join(e.select(F.col("v").alias("w")), F.col("u") == F.col("w"), "left_semi").limit(1).count()


def components(edges: DataFrame) -> DataFrame:
    """edges(u long, v long) -> node, component: the least node reachable. Nodes without edges aren't listed.

    Rounds of two steps, each written to the shared folder: all smaller neighbours of a node are
    linked with the least of them, and every centre that has a centre itself hands its nodes
    over to that one, so that chains halve. Centres only ever become smaller, so rounds end. Only centres
    that have a centre are joined, and a centre's edges are spread over SALTS keys for it.
    """
    e = _contract(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")))
    while not _settled(e):
        centres = e.select(F.col("u").alias("w")).distinct()
        up = e.join(centres, F.col("v") == F.col("w"), "left_semi").groupBy(F.col("v").alias("w")).agg(F.min("u").alias("m"))
        up = up.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = e.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
        e = _contract(salted.join(up, (F.col("u") == F.col("w")) & (F.col("s") == F.col("salt")), "left").select(F.coalesce("m", "u").alias("u"), "v"))
    stars = e.select(F.col("v").alias("node"), F.col("u").alias("component"))
    return stars.union(e.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
