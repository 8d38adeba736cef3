"""Quality rules: rule statistics of whole texts, and an isolation forest on them with a threshold from labelled rows."""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, small_batches, stored, trimmed, trimmed_group

SYMBOLS, SPACES = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
#: The forest has TREES trees of depth DEPTH, each on all good rows.
TREES, DEPTH = 100, 12
#: The threshold's share of the poor rows; parts of a range that are counted at once, and rows that are sorted here.
LOWEST, PARTS, FEW = 0.01, 1000, 1000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass
class Rules:
    """Limits of the base rules: fewest words, and most repeated words, in percent."""

    least_words: int = 50
    most_repeated: int = 50


def word_ids(words: list[bytes]) -> np.ndarray:
    """Equal numbers for equal words."""
    seen: dict[bytes, int] = {}
    return np.fromiter(map(seen.setdefault, words, itertools.count()), np.int64, len(words))


def repeated_words(ids: np.ndarray) -> int:
    """Words inside 3-word windows that are found twice or more."""
    n = len(ids)
    if n < 4:
        return 0
    if n < 1 << 21:
        key = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    else:
        _, pair = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)
        key = pair[:-1] * n + ids[2:]
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def statistics(text: str) -> tuple[list[int], list[float]]:
    """The five counts, and the features of the forest: logarithms of word lengths and of shares (in thousandths)."""
    raw = text.encode("utf-8", "replace")
    byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    ids = word_ids(words)
    n, chars = len(words), len(text) - int(byte[list(SPACES)].sum())
    lines, seen, dup, filled = text.split("\n"), set(), 0, 0
    for line in lines:
        if line.strip(" \t\n\x0b\x0c\r"):
            filled += 1
            dup += line in seen
            seen.add(line)
    repeat, symbols = repeated_words(ids), int(byte[list(SYMBOLS)].sum())
    w, c = max(n, 1), max(chars, 1)
    upper, digits = int(byte[65:91].sum()), int(byte[48:58].sum())
    marks = int(byte[33:48].sum() + byte[58:65].sum() + byte[91:97].sum() + byte[123:127].sum())
    longest = max(map(len, words), default=0)
    shares = [symbols / w, dup / max(filled, 1), repeat / w, upper / c, digits / c, marks / c]
    return [n, chars, symbols, dup, repeat], [math.log1p(chars / w), math.log1p(longest), *[math.log1p(1000 * x) for x in shares]]


def base_failed(n_words: int, n_repeat: int, rules: Rules) -> bool:
    return n_words < rules.least_words or 100 * n_repeat > rules.most_repeated * n_words


def expected_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary search tree of n."""
    n = np.asarray(n, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        h = np.log(n - 1) + 0.5772156649015329
        return np.where(n > 2, 2 * h - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


class Forest:
    """Isolation trees as arrays: node i has children 2i+1 and 2i+2; feature -1 is a leaf with its path length.

    A node cuts its box (at the root: low to high) at random, not the range of its rows, so that
    what lies apart from all rows of x, on either side or in an odd combination, ends in an empty
    box after a few cuts, also along a statistic in which all of x are equal. Cuts don't depend on
    rows, so rows can be counted anywhere: masses() of any parts of them add up to what hold() takes.
    """

    def __init__(self, x: np.ndarray, low: np.ndarray, high: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        size = (1 << (DEPTH + 1)) - 1
        self.feature = np.full((TREES, size), -1, np.int8)
        self.cut, self.path = np.zeros((TREES, size), np.float32), np.zeros((TREES, size), np.float32)
        lo, hi = (np.broadcast_to(np.asarray(v, float), (TREES, 1, len(low))) for v in (low, high))
        for depth in range(DEPTH):
            first, n = (1 << depth) - 1, 1 << depth
            wide = hi > lo
            f = np.argmax(np.where(wide, rng.random(wide.shape), -1), 2)
            at = f[..., None]
            cut = (np.take_along_axis(lo, at, 2)[..., 0] + rng.random(f.shape) * np.take_along_axis(hi - lo, at, 2)[..., 0]).astype(np.float32)
            self.feature[:, first : first + n], self.cut[:, first : first + n] = np.where(wide.any(2), f, -1), cut
            mine = np.arange(len(low)) == at
            left, right = np.where(mine, cut[..., None], hi), np.where(mine, cut[..., None], lo)
            lo, hi = (np.stack(pair, 2).reshape(TREES, 2 * n, len(low)) for pair in ((lo, right), (left, hi)))
        if len(x):
            self.hold(self.masses(x))

    def masses(self, x: np.ndarray) -> np.ndarray:
        """How many rows end in each box of the last level of each tree, before hold()."""
        trees, out = np.arange(TREES)[None, :], np.zeros(TREES << DEPTH, np.int64)
        for i in range(0, len(x), 1024):
            part = x[i : i + 1024]
            at, rows = np.zeros((len(part), TREES), np.int64), np.arange(len(part))[:, None]
            for _ in range(DEPTH):
                f = self.feature[trees, at]
                at = 2 * at + 1 + ((f >= 0) & (part[rows, np.maximum(f, 0)] >= self.cut[trees, at]))
            out += np.bincount((at - (1 << DEPTH) + 1 + (trees << DEPTH)).ravel(), minlength=len(out))
        return out.reshape(TREES, -1)

    def hold(self, masses: np.ndarray) -> None:
        """The rows that the trees hold: a box with fewer than two is a leaf."""
        for depth in range(DEPTH, -1, -1):
            level = slice((1 << depth) - 1, (2 << depth) - 1)
            if depth < DEPTH:
                masses = masses.reshape(TREES, -1, 2).sum(2)
            leaf = (masses < 2) | (self.feature[:, level] < 0)
            self.feature[:, level] = np.where(leaf, -1, self.feature[:, level])
            self.path[:, level] = np.where(leaf, depth + expected_path(masses), 0)
        self.scale = max(float(expected_path(masses[0, 0])), 1e-9)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Anomaly scores in (0, 1]: the shorter the mean path, the higher."""
        trees = np.arange(TREES)[None, :]
        at = np.zeros((len(x), TREES), np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            f = self.feature[trees, at]
            right = x[rows, np.maximum(f, 0)] >= self.cut[trees, at]
            at = np.where(f >= 0, 2 * at + 1 + right, at)
        return 2.0 ** (-self.path[trees, at].mean(1, dtype=np.float64) / self.scale)


@dataclass
class Verdicts:
    forest: Forest | None = None
    threshold: float = 1.0

    def scores(self, features: list[list[float]]) -> np.ndarray:
        return self.forest.scores(np.array(features)) if self.forest else np.zeros(len(features))


STATS = ", ".join(f"{c} long" for c in COUNTS)


def smallest(scores: DataFrame, k: int) -> float:
    """The k-th smallest (from 0) of a column x of numbers: parts of its range are counted, then parts of the one that has it."""
    low, high = scores.agg(F.min("x"), F.max("x")).first()
    while True:
        part = F.least(F.floor((F.col("x") - F.lit(low)) / F.lit(high - low) * PARTS), F.lit(PARTS - 1)) if high > low else F.lit(0)
        for r in sorted(scores.where(F.col("x").between(low, high)).groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect()):
            if k < r["n"]:
                break
            k -= r["n"]
        low, high = r["low"], r["high"]
        if low == high:
            return low
        if r["n"] <= FEW:
            return sorted(x for (x,) in scores.where(F.col("x").between(low, high)).collect())[k]


def fit(docs: DataFrame, labels: DataFrame, *, labelled: int | None = None, rules: Rules = Rules()) -> Verdicts:
    """A forest on the statistics of all labelled documents, or of at most `labelled` of them.

    Only rows that the base rules keep count, and equal rows once. The forest's trees hold rows
    labelled good (quality 1), in a box that holds all labelled rows. The threshold lies midway
    between the good rows' highest score and the lowest percentile of the others', or at the
    good rows' highest where they overlap. Without good rows nothing is rejected. A document with
    several labels counts as its worst. Texts stay where they are read; their statistics meet the
    labels. What comes to the driver has the same size for any number of rows.
    """
    small_batches(docs.sparkSession)
    worst = pick(labels, named="doc_id", quality="quality").where("named IS NOT NULL AND quality IS NOT NULL").groupBy("named").agg(F.min("quality").cast("int").alias("quality"))
    docs = pick(docs, doc_id="doc_id", text="text").where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                b = whole.slice(i, 256)
                got = [statistics(t or "") for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), pa.array([base_failed(c[0], c[4], rules) for c, _ in got], pa.bool_()), pa.array([f for _, f in got], pa.list_(pa.float64()))], ["doc_id", "row", "failed", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    measured = docs.mapInArrow(trimmed(measure), f"doc_id {kind}, row long, failed boolean, x array<double>").where("NOT failed")
    rows = measured.join(worst, measured["doc_id"] == worst["named"]).groupBy("row").agg(F.min("quality").alias("quality"), F.min("x").alias("x"))
    rows = stored(rows if labelled is None else rows.orderBy("row").limit(labelled), "labelled")
    n = len(statistics("")[1])
    box = rows.agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") != 1).alias("poor"), *[f(F.col("x")[i]) for f in (F.min, F.max) for i in range(n)]).first()
    if not box["good"]:
        return Verdicts()
    forest = Forest(np.empty((0, n)), np.array(box[2 : 2 + n]), np.array(box[2 + n :]))
    features = lambda b: b.column("x").flatten().to_numpy().reshape(-1, n)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((TREES, 1 << DEPTH), np.int64)
        for b in batches:
            held += forest.masses(features(b))
        yield pa.RecordBatch.from_arrays([pa.array(range(TREES), pa.int32()), pa.array([zlib.compress(h.tobytes(), 1) for h in held], pa.binary())], ["tree", "held"])

    def add(t: pa.Table) -> pa.Table:
        held = sum(np.frombuffer(zlib.decompress(h), np.int64) for h in t.column("held").to_pylist())
        return pa.table([t.column("tree").slice(0, 1), pa.array([zlib.compress(held.tobytes(), 1)], pa.binary())], ["tree", "held"])

    counted = rows.where("quality = 1").select("x").mapInArrow(count, "tree int, held binary").groupBy("tree").applyInArrow(trimmed_group(add), "tree int, held binary").collect()
    forest.hold(np.array([np.frombuffer(zlib.decompress(r["held"]), np.int64) for r in sorted(counted)]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                yield pa.RecordBatch.from_arrays([part.column("quality"), pa.array(forest.scores(features(part)), pa.float64())], ["quality", "x"])

    scored = stored(rows.select("quality", "x").mapInArrow(score, "quality int, x double"), "scored")
    top = scored.where("quality = 1").agg(F.max("x")).first()[0]
    low = smallest(scored.where("quality <> 1").select("x"), int(LOWEST * (box["poor"] - 1))) if box["poor"] else 1.0
    return Verdicts(forest, max(top, (top + low) / 2))


def judged(docs: DataFrame, verdicts: Verdicts, keep: dict[str, str], *, rules: Rules = Rules()) -> DataFrame:
    """For each row of docs(text, ...): the kept columns (name -> type), n_words and the four counts, base_failed, kept, anomaly.

    A null or empty text has no words and fails the base rules; very long texts count whole. Each
    row is judged by its own text alone, so repeated rows, null ids and other columns change
    nothing; a score equal to the threshold is kept. An empty table gives no rows.
    """

    small_batches(docs.sparkSession)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                b = whole.slice(i, 256)
                got = [statistics(t or "") for t in b.column("text").to_pylist()]
                failed = [base_failed(c[0], c[4], rules) for c, _ in got]
                score = verdicts.scores([f for _, f in got])
                kept = [not f and bool(s <= verdicts.threshold) for f, s in zip(failed, score, strict=True)]
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], *[pa.array([c[k] for c, _ in got], pa.int64()) for k in range(5)], pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_()), pa.array(score, pa.float64())], [*keep, *COUNTS, "base_failed", "kept", "anomaly"])

    schema = ", ".join([*[f"`{c}` {t}" for c, t in keep.items()], STATS, "base_failed boolean, kept boolean, anomaly double"])
    return docs.mapInArrow(trimmed(judge), schema)


def quality_rows(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, anomaly."""
    rows = pick(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return judged(rows, fit(docs, labels, **options), {"doc_id": "long"})
