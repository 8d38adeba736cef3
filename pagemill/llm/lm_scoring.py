"""Language-model scores from a hierarchical Pitman-Yor model.

A token's restaurant is that of the word before it, or of a text's start. All of these
restaurants share one parent, whose dishes come from a uniform base over the vocabulary: a table
in a word's restaurant is a customer of the parent. Restaurants, dishes and counts all grow with
the corpus. Contexts are hashes of 40 bits, words of 64.

1. One pass over the texts: for each chunk of documents, the counts of (word, word before it).
2. Dealt by word to buckets, counts of all chunks meet. A cell is a dish of one restaurant; all
   cells of a word and its place in the parent lie in one bucket, its restaurants' totals don't.
3. Sweeps of Gibbs sampling. Before each, totals of all restaurants are added up over all buckets.
   In a sweep every customer of every cell leaves once, which may close its table, and sits down
   again, at a table by its size or at a new one by what the parent gives; then so does every
   customer of the parent, those of cells with one customer (which can't change) included. A
   word's cells and its place in the parent follow each other's changes at once. After burn-in
   each sweep is a sample.
4. Each chunk gets what its words and pairs need to know of every sample, meets its documents
   again, averages the samples' probabilities and adds up.

Random numbers are hashes of word and context, or come from a generator that each word has in each
sweep, and sums are of whole numbers, so scores don't depend on how words and texts are dealt out.
"""

from __future__ import annotations

import math
import random
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, pick, rows_of, small_batches, stored, trim, trimmed, trimmed_group, trimmed_pair

#: Sweeps before the first sample, samples.
BURN_IN, SAMPLES = 1, 2
#: Cells of more customers keep the sizes of their tables.
LARGE = 256
#: Discount and strength of the words' restaurants and of their parent. The parent's discount is 1/2, for which the law of its tables has a closed form.
DISCOUNT, STRENGTH = (0.75, 0.5), (1.0, 1.0)
#: A chunk holds the documents of about so many bytes of a file, a bucket the words of about so many bytes of the table.
CHUNK_BYTES, BUCKET_BYTES, LEAST_BUCKETS = 4 << 20, 5 << 20, 8
#: Keys of the end of a text, a word like another, and of its start, which is a context alone.
END_KEY, START_KEY = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
#: A word's key as a context.
CONTEXT_SHIFT = np.uint64(24)


def bucket_of(contexts: np.ndarray, n: int) -> np.ndarray:
    """The bucket of a word, from its key as a context: dishes and restaurants of one name share it."""
    return ((contexts >> np.uint64(9)) % np.uint64(n)).astype(np.int64)


def packed(contexts: np.ndarray) -> bytes:
    """40-bit numbers in five bytes each."""
    return np.ascontiguousarray(contexts.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def unpacked(b: bytes | np.ndarray) -> np.ndarray:
    out = np.zeros((len(b) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(b, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel().astype(np.uint64)


def squeezed(x: np.ndarray | bytes) -> bytes:
    """Numbers that repeat, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(x if isinstance(x, bytes) else x.tobytes())


def numbers(b: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


class Chunk:
    """Words and (word, word before) pairs of some documents, in an order that doesn't depend on that of the documents."""

    def __init__(self, texts: list[str]):
        ids: dict[bytes | None, int] = {None: 0}
        tokens: list[np.ndarray] = []
        for t in texts:
            words = t.encode("utf-8", "replace").lower().split()
            tokens.append(np.array([ids.setdefault(w, len(ids)) for w in words] + [0], np.int32))
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        names = list(ids)[1:]
        keys = np.concatenate([[END_KEY], np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names)), [START_KEY]]).astype(np.uint64)
        self.keys, place = np.unique(keys, return_inverse=True)
        del ids, names
        flat = place.astype(np.int64)[np.concatenate(tokens)] if tokens else np.empty(0, np.int64)
        before = np.empty(len(flat), np.int64)
        before[1:] = flat[:-1]
        before[np.cumsum(self.lengths) - self.lengths] = place[-1]
        self.token_word = flat.astype(np.int32)
        pairs, inverse = np.unique(flat * len(keys) + before, return_inverse=True)
        self.token_pair = inverse.astype(np.int32)
        self.pair_word, self.pair_before = pairs // len(keys), pairs % len(keys)

    def buckets(self, n: int) -> np.ndarray:
        return bucket_of(self.keys >> CONTEXT_SHIFT, n)


def requests(chunk: int, c: Chunk, train: np.ndarray, n: int) -> pa.RecordBatch:
    """The chunk's pairs and training counts, a row for each bucket: keys of words, how many pairs each has, contexts, counts."""
    counted = np.repeat(train, c.lengths)
    count = np.bincount(c.token_pair[counted], minlength=len(c.pair_word)).astype(np.uint32)
    word_bucket = c.buckets(n)
    pair_bucket = word_bucket[c.pair_word]
    per_word = np.bincount(c.pair_word, minlength=len(c.keys)).astype(np.uint32)
    wo, po = np.argsort(word_bucket, kind="stable"), np.argsort(pair_bucket, kind="stable")
    wa, pb = np.searchsorted(word_bucket[wo], np.arange(n + 1)), np.searchsorted(pair_bucket[po], np.arange(n + 1))
    used = [b for b in range(n) if wa[b] < wa[b + 1]]
    keys, per_word, context, count = c.keys[wo], per_word[wo], (c.keys >> CONTEXT_SHIFT)[c.pair_before[po]], count[po]
    words = lambda f, x: pa.array([f(x[wa[b] : wa[b + 1]]) for b in used], pa.binary())
    pairs = lambda f, x: pa.array([f(x[pb[b] : pb[b + 1]]) for b in used], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([chunk] * len(used), pa.int64()), words(np.ndarray.tobytes, keys), words(squeezed, per_word), pairs(packed, context), pairs(squeezed, count)], ["bucket", "chunk", "keys", "per", "contexts", "count"])


# --- what tasks hand on: rows of one wide table, by kind

BLOBS = ("keys", "known", "single", "word", "context", "contexts", "count", "tables", "sizes", "root_tables", "root_sizes", "t", "n", "flag", "place", "words")
ROW = "kind string, bucket int, other int, chunk long, " + ", ".join(f"{b} binary" for b in BLOBS)
SCHEMA = pa.schema([("kind", pa.string()), ("bucket", pa.int32()), ("other", pa.int32()), ("chunk", pa.int64()), *[(b, pa.binary()) for b in BLOBS]])


def row(kind: str, bucket: int, other: int | None = None, chunk: int | None = None, **blobs: np.ndarray | bytes) -> dict:
    return {"kind": kind, "bucket": bucket, "other": other, "chunk": chunk, **{k: squeezed(v) for k, v in blobs.items()}}


def of_kind(df: DataFrame, *kinds: str) -> DataFrame:
    return df.where(F.col("kind").isin(*kinds))


def steps(x: np.ndarray) -> np.ndarray:
    """Rising numbers as differences, which compress well; np.cumsum gives them back."""
    return np.diff(x, prepend=0).astype(np.uint32)


def cells_of_bucket(table: pa.Table, n: int) -> pa.Table:
    """All requests of one bucket -> its words and cells, what they count for each restaurant, and for each chunk where its pairs and words are among them."""
    rows = table.to_pylist()
    bucket = rows[0]["bucket"]
    keys, per = [np.frombuffer(r["keys"], np.uint64) for r in rows], [numbers(r["per"], np.uint32) for r in rows]
    names, word = np.unique(np.concatenate(keys), return_inverse=True)
    contexts, context = np.unique(np.concatenate([unpacked(r["contexts"]) for r in rows]), return_inverse=True)
    cells, place = np.unique(np.repeat(word, np.concatenate(per)) * max(len(contexts), 1) + context, return_inverse=True)
    c = np.bincount(place, np.concatenate([numbers(r["count"], np.uint32) for r in rows]), len(cells)).astype(np.int64)
    cell_word, cell_context = cells // max(len(contexts), 1), cells % max(len(contexts), 1)
    p, w = np.cumsum([0, *[int(x.sum()) for x in per]]), np.cumsum([0, *[len(k) for k in keys]])
    out = [row("place", bucket, chunk=r["chunk"], place=steps(place[p[i] : p[i + 1]]), words=steps(word[w[i] : w[i + 1]])) for i, r in enumerate(rows)]
    known = np.bincount(cell_word, c, len(names)).astype(np.int64)
    many = np.flatnonzero(c > 1)
    used, at = np.unique(cell_context[many], return_inverse=True)
    single = np.bincount(cell_word[c == 1], minlength=len(names)).astype(np.uint32)
    out.append(row("cells", bucket, keys=names, known=known, count=c.astype(np.uint32)))
    out.append(row("seats", bucket, keys=names, single=single, word=cell_word[many].astype(np.uint32), context=at.astype(np.uint32), contexts=packed(contexts[used]), count=c[many].astype(np.uint32)))
    tables = np.bincount(cell_context[c > 0], minlength=len(contexts))
    asks = np.zeros(len(contexts), np.uint8)
    asks[used] = 1
    out += messages(bucket, contexts, tables, n, tables > 0, flag=asks)
    out.append(row("sums", bucket, n=np.array([known.sum(), (known > 0).sum(), (c > 0).sum(), (known > 0).sum()], np.int64)))
    return pa.Table.from_pylist(out, SCHEMA)


def messages(bucket: int, contexts: np.ndarray, tables: np.ndarray, buckets: int, chosen: np.ndarray, **more: np.ndarray) -> list[dict]:
    """What a bucket has in each restaurant, a row for each bucket of restaurants."""
    there, out = np.where(chosen, bucket_of(contexts, buckets), -1), []
    order = np.argsort(there, kind="stable")
    at = np.searchsorted(there[order], np.arange(buckets + 1))
    for b in range(buckets):
        part = order[at[b] : at[b + 1]]
        if len(part):
            out.append(row("message", b, bucket, contexts=packed(contexts[part]), t=tables[part].astype(np.uint32), **{k: v[part] for k, v in more.items()}))
    return out


def totalled(table: pa.Table) -> pa.Table:
    """Messages to one bucket of restaurants -> the totals of each, and an answer to each bucket with those it asks for."""
    rows = table.to_pylist()
    contexts = [unpacked(numbers(r["contexts"], np.uint8)) for r in rows]
    names, place = np.unique(np.concatenate(contexts), return_inverse=True)
    t = np.bincount(place, np.concatenate([numbers(r["t"], np.uint32) for r in rows]), len(names)).astype(np.int64)
    out, at = [], 0
    for r, c in zip(rows, contexts, strict=True):
        mine = place[at : at + len(c)]
        at += len(c)
        asked = mine if r["flag"] is None else mine[numbers(r["flag"], np.uint8) > 0]
        out.append(row("answer", r["other"], r["bucket"], t=t[asked].astype(np.uint32)))
    out.append(row("total", rows[0]["bucket"], contexts=packed(names), t=t.astype(np.uint32)))
    return pa.Table.from_pylist(out, SCHEMA)


# --- seating


def mixed(x: np.ndarray) -> np.ndarray:
    """A hash of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(seeds: np.ndarray, draw: int) -> np.ndarray:
    """The draw-th number in [0, 1) of each seed."""
    step = np.uint64(draw * 0x9E3779B97F4A7C15 % (1 << 64))
    return (mixed(seeds + step) >> np.uint64(11)) * 2.0**-53


class Tables:
    """Tables of some cells: cell and size of each, in order of cells; customers and tables of each cell.

    Moves of single customers in many cells at once. Sweeps, which move every customer, don't use it any more; its test is kept.
    """

    def __init__(self, cell: np.ndarray, size: np.ndarray, cells: int, discount: float):
        self.cell, self.size, self.discount = cell.astype(np.int64), size.astype(np.int64), discount
        self.c, self.t = np.bincount(self.cell, self.size, cells).astype(np.int64), np.bincount(self.cell, minlength=cells)

    def leave(self, who: np.ndarray, r: np.ndarray) -> np.ndarray:
        """One customer of each of these cells, picked by r in [0, 1), leaves; whether its table closes."""
        ends = np.cumsum(self.size)
        start = np.concatenate([[0], ends])[np.searchsorted(self.cell, who)]
        at = np.searchsorted(ends, start + np.minimum((r * self.c[who]).astype(np.int64), self.c[who] - 1), "right")
        self.size[at] -= 1
        closed = self.size[at] == 0
        self.c[who] -= 1
        self.t[who] -= closed
        if closed.any():
            keep = self.size > 0
            self.cell, self.size = self.cell[keep], self.size[keep]
        return closed

    def enter(self, who: np.ndarray, r: np.ndarray, new: np.ndarray) -> np.ndarray:
        """One customer sits down in each of these cells: at a table by its size less the discount, or at a new one, of weight `new`; whether it is new."""
        old = self.c[who] - self.discount * self.t[who]
        x = np.floor(r * (old + new) * 2.0**20) / 2.0**20  # sums with it are exact
        opened = (x >= old) | (self.t[who] == 0)
        ends = np.cumsum(self.size - self.discount)
        first = np.searchsorted(self.cell, who)
        stay = np.flatnonzero(~opened)
        at = np.searchsorted(ends, np.concatenate([[0], ends])[first[stay]] + x[stay], "right")
        self.size[at] += 1
        if opened.any():
            place = np.searchsorted(self.cell, who[opened], "right")
            self.cell, self.size = np.insert(self.cell, place, who[opened]), np.insert(self.size, place, 1)
        self.c[who] += 1
        self.t[who] += opened
        return opened

    def part(self, who: np.ndarray) -> Tables:
        """Some cells on their own, renumbered."""
        new = np.full(len(self.c), -1)
        new[who] = np.arange(len(who))
        mine = new[self.cell] >= 0
        return Tables(new[self.cell[mine]], self.size[mine], len(who), self.discount)

    def put(self, who: np.ndarray, part: Tables) -> None:
        """Those cells back in their place."""
        other = ~np.isin(self.cell, who)
        cell, size = np.concatenate([self.cell[other], who[part.cell]]), np.concatenate([self.size[other], part.size])
        order = np.argsort(cell, kind="stable")
        self.cell, self.size = cell[order], size[order]
        self.c[who], self.t[who] = part.c, part.t


@lru_cache(maxsize=1)
def alone(d: float) -> list[list[float]]:
    """[c][t]: how likely one of c customers at t tables has a table of its own, from generalized Stirling numbers of discount d, for c up to LARGE."""
    out, logs = [[], [0.0, 1.0]], np.array([-np.inf, 0.0])
    with np.errstate(divide="ignore"):
        for c in range(2, LARGE + 1):
            opened = np.append(-np.inf, logs)
            logs = np.logaddexp(opened, np.append(logs + np.log(c - 1 - d * np.arange(c)), -np.inf))
            out.append([0.0, *np.exp(opened[1:] - logs[1:]).tolist()])
    return out


class Place:
    """A word's place in the parent, c customers at t tables, and the word's probability p there.

    How likely a customer that leaves closes its table has a closed form for the discount 1/2.
    """

    __slots__ = ("c", "t", "p", "new", "customers", "tables", "base", "draw")

    def __init__(self, c: int, t: int, customers: int, tables: int, vocabulary: int, draw: Callable[[], float]):
        """customers, tables: those of all other words."""
        self.c, self.t, self.customers, self.tables, self.base, self.draw = c, t, customers, tables, 1 / (vocabulary + 1), draw
        self.told()

    def told(self) -> None:
        self.new = (STRENGTH[1] + DISCOUNT[1] * (self.tables + self.t)) * self.base
        self.p = (self.c - DISCOUNT[1] * self.t + self.new) / (STRENGTH[1] + self.customers + self.c)

    def leave(self) -> None:
        """A table below has closed."""
        if self.c == 1 or (self.t > 1 and self.draw() * (2 * self.c - self.t - 1) < self.t - 1):
            self.t -= 1
        self.c -= 1
        self.told()

    def enter(self) -> None:
        """A table below has opened."""
        if self.draw() * (self.c - DISCOUNT[1] * self.t + self.new) < self.new:
            self.t += 1
        self.c += 1
        self.told()


def moved(c: int, t: int, s: float, d: float, place: Place, draw: Callable[[], float]) -> int:
    """Tables of a cell of c customers after each has left and sat down again, once; s: its restaurant's strength without the cell's own tables.

    Sizes of tables depend on nothing but c and t, so they are left open.
    """
    ends, new = alone(d)[c], (s + d * t) * place.p
    for _ in range(c):
        if t > 1 and draw() < ends[t]:
            t -= 1
            place.leave()
            new = (s + d * t) * place.p
        if draw() * (c - 1 - d * t + new) < new:
            t += 1
            place.enter()
            new = (s + d * t) * place.p
    return t


def turned(sizes: list[int], s: float, d: float, place: Place, draw: Callable[[], float]) -> list[int]:
    """moved() for a cell of any number of customers: sizes of its tables after each customer, in random order, has left and sat down again.

    A table is chosen as that of another customer picked at random, kept by its size less the
    discount, so a move's time doesn't grow with the tables.
    """
    seat, free, sizes = array("I"), [], list(sizes)
    for k, size in enumerate(sizes):
        seat += array("I", [k]) * size
    others, t = len(seat) - 1, len(sizes)
    new = (s + d * t) * place.p
    for i in range(others + 1):
        j = i + int(draw() * (others + 1 - i))
        k, seat[j] = seat[j], seat[i]
        sizes[k] -= 1
        if not sizes[k]:
            t -= 1
            free.append(k)
            place.leave()
            new = (s + d * t) * place.p
        if not t or draw() * (others - d * t + new) < new:
            t += 1
            place.enter()
            new = (s + d * t) * place.p
            if free:
                k = free.pop()
            else:
                k = len(sizes)
                sizes.append(0)
        else:
            while True:
                j = int(draw() * others)
                k = seat[j + (j >= i)]
                if draw() * sizes[k] >= d:
                    break
        seat[i] = k
        sizes[k] += 1
    return [size for size in sizes if size]


def parent_tables(c: np.ndarray, tables: np.ndarray, vocabulary: int, seeds: np.ndarray) -> np.ndarray:
    """Tables of words' places in the parent, all c customers of a word seated anew at once; tables: those of all other words.

    The chance of t + 1 tables is that of t times the weight of a new one and 4 (c - t) / (t (2 c - t - 1)),
    a ratio of generalized Stirling numbers of discount 1/2. It falls with t, so what is left out
    is below 1e-17 of all.
    """
    out, t = np.minimum(c, 1), 1
    log, total, who = np.zeros(len(c)), np.zeros(len(c)), np.flatnonzero(c > 1)
    while len(who):
        n = c[who]
        ratio = (STRENGTH[1] + DISCOUNT[1] * (tables[who] + t)) / (vocabulary + 1) * 4 * (n - t) / (t * (2 * n - t - 1))
        log[who] += np.log(ratio)
        total[who] = np.logaddexp(total[who], log[who])
        share = log[who] - total[who]
        t += 1
        out[who[uniform(seeds[who], t) < np.exp(share)]] = t
        who = who[(n > t) & ((ratio >= 1) | (share > -40))]
    return out


class Seating:
    """The cells of one bucket with more than one customer, and its words' places in the parent."""

    def __init__(self, m: dict, vocabulary: int, root_customers: int, root_tables: int):
        get = lambda k, kind: numbers(m[k], kind)
        self.names, self.single = get("keys", np.uint64), get("single", np.uint32).astype(np.int64)
        self.word, self.context, self.count = get("word", np.uint32).astype(np.int64), get("context", np.uint32).astype(np.int64), get("count", np.uint32).astype(np.int64)
        self.contexts = unpacked(get("contexts", np.uint8))
        self.vocabulary, self.all_customers, self.all_tables = vocabulary, root_customers, root_tables
        self.word_seed = mixed(self.names)
        self.cell_seed = mixed(self.word_seed[self.word] ^ mixed(self.contexts[self.context] + np.uint64(1)))
        self.large = self.count > LARGE
        if m["tables"] is not None:
            self.t, self.c0, self.t0 = (get(k, np.uint32).astype(np.int64) for k in ("tables", "root_sizes", "root_tables"))
            self.sizes = get("sizes", np.uint32).astype(np.int64)

    def weights(self, c0: np.ndarray, t0: np.ndarray) -> np.ndarray:
        """The parent's probability of each word."""
        d, s = DISCOUNT[1], STRENGTH[1]
        return (c0 - d * t0 + (s + d * self.all_tables) / (self.vocabulary + 1)) / (s + self.all_customers)

    def begin(self, tables: np.ndarray) -> None:
        """A first seating: about as many tables in each cell as its customers would open one after another, all but one with one customer."""
        c0 = self.single + np.bincount(self.word, minlength=len(self.names))
        a = (STRENGTH[0] + DISCOUNT[0] * tables[self.context]) * self.weights(c0, np.minimum(c0, 1))[self.word]
        t = 1 + np.floor(a * np.log1p((self.count - 1) / (a + 1 - DISCOUNT[0])) + uniform(self.cell_seed, 0)).astype(np.int64)
        self.t = np.minimum(t, self.count)
        t = self.t[self.large]
        self.sizes = np.ones(t.sum(), np.int64)
        self.sizes[np.cumsum(t) - t] += self.count[self.large] - t
        self.c0 = self.single + np.bincount(self.word, self.t, len(self.names)).astype(np.int64)
        self.t0 = np.minimum(self.c0, 1)

    def sweep(self, tables: np.ndarray, number: int) -> None:
        """Every customer of every cell, and of the words' places in the parent, leaves once and sits down again; tables: those of each restaurant in all buckets."""
        (d, _), (s, _), words = DISCOUNT, STRENGTH, len(self.names)
        if number:
            own, c0, t0 = self.t, self.c0, self.t0
        else:  # totals are those before the first seating
            own = np.ones(len(self.count), np.int64)
            c0 = self.single + np.bincount(self.word, minlength=words)
            t0 = np.minimum(c0, 1)
        strength, customers, places = (s + d * (tables[self.context] - own)).tolist(), (self.all_customers - c0).tolist(), self.all_tables - t0
        seeds, word_at = mixed(self.word_seed + np.uint64(number + 1)), np.searchsorted(self.word, np.arange(words + 1)).tolist()
        count, t, c0, t0 = self.count.tolist(), self.t.tolist(), self.c0.tolist(), self.t0.tolist()
        sizes, at = array("q"), 0
        draws = random.Random()
        draw = draws.random
        for w in np.unique(self.word).tolist():
            draws.seed(int(seeds[w]))
            place = Place(c0[w], t0[w], customers[w], int(places[w]), self.vocabulary, draw)
            for i in range(word_at[w], word_at[w + 1]):
                if count[i] <= LARGE:
                    t[i] = moved(count[i], t[i], strength[i], d, place, draw)
                else:
                    after = turned(self.sizes[at : at + t[i]].tolist(), strength[i], d, place, draw)
                    at += t[i]
                    t[i] = len(after)
                    sizes.extend(after)
            c0[w] = place.c
        self.t, self.c0, self.sizes = np.array(t, np.int64), np.array(c0, np.int64), np.array(sizes, np.int64)
        self.t0 = parent_tables(self.c0, places, self.vocabulary, mixed(seeds))

    def state(self) -> dict[str, np.ndarray]:
        small = lambda x: x.astype(np.uint32)
        return {"tables": small(self.t), "sizes": small(self.sizes), "root_tables": small(self.t0), "root_sizes": small(self.c0)}


def answered(rows: list[dict], contexts: np.ndarray, n: int) -> np.ndarray:
    """Totals of a bucket's contexts from the answers of all buckets of restaurants."""
    out, there = np.zeros(len(contexts), np.int64), bucket_of(contexts, n)
    for r in rows:
        out[there == r["other"]] = numbers(r["t"], np.uint32)
    return out


def swept(left: pa.Table, right: pa.Table, n: int, number: int, sums: tuple[int, int, int]) -> pa.Table:
    """One bucket's seats and the answers to it -> its seats after a sweep, what they add to each restaurant, and what a sample keeps of them."""
    if not left.num_rows:
        return pa.Table.from_pylist([], SCHEMA)
    m = left.to_pylist()[0]
    s = Seating(m, *sums)
    total = answered(right.to_pylist(), s.contexts, n)
    if not number:
        first, tables = total, total
        s.begin(tables)
    else:
        first = numbers(m["t"], np.int64)
        tables = first + total
    s.sweep(tables, number)
    bucket, sample = m["bucket"], number - BURN_IN
    out = [row("sums", bucket, n=np.array([s.c0.sum(), s.t0.sum()], np.int64))]
    if sample + 1 < SAMPLES:
        out.append({**m, **row("seats", bucket, t=first, **s.state())})
    out += messages(bucket, s.contexts, np.bincount(s.context, s.t - 1, len(s.contexts)).astype(np.int64), n, np.ones(len(s.contexts), bool))
    if sample >= 0:
        out.append(row("sample", bucket, sample, **{k: v for k, v in s.state().items() if k != "sizes"}))
    return pa.Table.from_pylist(out, SCHEMA)


# --- answers to chunks


REPLIES = ("known", "first", "more", "root_sizes", "root_tables", "count", "tables")
REPLY = "chunk long, bucket int, " + ", ".join(f"{b} binary" for b in REPLIES)
REPLY_SCHEMA = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), *[(b, pa.binary()) for b in REPLIES]])


def replies(table: pa.Table) -> pa.Table:
    """All that one bucket knows -> for each chunk, whole numbers about its words and cells.

    Of a word: customers, tables of its restaurant before seating and how many more in each sample,
    its customers and tables in the parent in each sample. Of a cell: customers, and tables in all samples.
    """
    rows = table.to_pylist()
    kind = lambda k: [r for r in rows if r["kind"] == k]
    if not kind("cells"):
        return pa.Table.from_pylist([], REPLY_SCHEMA)
    cells = kind("cells")[0]
    names, known, count = numbers(cells["keys"], np.uint64), numbers(cells["known"], np.int64), numbers(cells["count"], np.uint32)
    many, contexts = np.flatnonzero(count > 1), names >> CONTEXT_SHIFT
    first, tables = np.zeros(len(names), np.uint32), np.where(count > 0, SAMPLES, 0).astype(np.uint32)
    more, root_sizes, root_tables = (np.zeros((SAMPLES, len(names)), np.uint32) for _ in range(3))
    for r in kind("sample"):
        k = r["other"]
        tables[many] += numbers(r["tables"], np.uint32) - np.uint32(1)
        root_sizes[k], root_tables[k] = numbers(r["root_sizes"], np.uint32), numbers(r["root_tables"], np.uint32)
    for r in kind("total"):
        there = unpacked(numbers(r["contexts"], np.uint8))
        at = np.searchsorted(there, contexts)
        ok = at < len(there)
        ok[ok] = there[at[ok]] == contexts[ok]
        (first if r["other"] < 0 else more[r["other"]])[ok] = numbers(r["t"], np.uint32)[at[ok]]
    out = []
    for r in kind("place"):
        at, words = np.cumsum(numbers(r["place"], np.uint32), dtype=np.int64), np.cumsum(numbers(r["words"], np.uint32), dtype=np.int64)
        own = {"known": known[words], "first": first[words], "more": more[:, words], "root_sizes": root_sizes[:, words], "root_tables": root_tables[:, words], "count": count[at], "tables": tables[at]}
        out.append({"chunk": r["chunk"], "bucket": cells["bucket"], **{k: squeezed(v) for k, v in own.items()}})
    return pa.Table.from_pylist(out, REPLY_SCHEMA)


def pair_probabilities(c: Chunk, rows: list[dict], n: int, vocabulary: int, root: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Training counts of a chunk's words, and the probability of each of its pairs, averaged over the samples; root: the parent's customers and tables in each."""
    word_bucket = c.buckets(n)
    pair_bucket = word_bucket[c.pair_word]
    known, tables, p0 = np.zeros(len(c.keys), np.int64), np.zeros((SAMPLES, len(c.keys))), np.zeros((SAMPLES, len(c.keys)))
    value = np.zeros(len(c.pair_word))
    (d, d0), (s, s0) = DISCOUNT, STRENGTH
    for r in rows:
        at = word_bucket == r["bucket"]
        known[at] = numbers(r["known"], np.int64)
        by_sample = lambda k, r=r: numbers(r[k], np.uint32).reshape(SAMPLES, -1).astype(np.float64)
        tables[:, at] = numbers(r["first"], np.uint32) + by_sample("more")
        p0[:, at] = by_sample("root_sizes") - d0 * by_sample("root_tables")
        value[pair_bucket == r["bucket"]] = numbers(r["count"], np.uint32) - d * numbers(r["tables"], np.uint32) / SAMPLES
    for k, (customers, all_tables) in enumerate(root):
        p0[k] = (p0[k] + (s0 + d0 * all_tables) / (vocabulary + 1)) / (s0 + customers)
    customers = known.astype(np.float64)  # every word is followed by one, and as many starts as ends
    customers[c.keys == START_KEY] = known[c.keys == END_KEY]
    share = sum((s + d * tables[k][c.pair_before]) * p0[k][c.pair_word] for k in range(SAMPLES)) / SAMPLES
    return known, (value + share) / (s + customers[c.pair_before])


# --- the operator


def scanned(docs: DataFrame) -> bool:
    """Whether rows come straight from files, so that each part of a file is one task's, whenever it is read."""
    node = docs._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    return node.nodeName() == "LogicalRelation"


def chunked(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, text, held_out, chunk: where a row lies in its file (and a hash, for long parts of files).

    Both passes of a session see the same parts, so a chunk is read by one task each time and
    its pairs are counted where they are read. Tables that don't come straight from files are
    written first.
    """
    if not scanned(docs):
        docs = stored(pick(docs, doc_id="doc_id", text="text"), "documents")
    cols = [F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), held_out.alias("held_out")]
    meta = docs.select("doc_id", "text", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.col("_metadata.file_block_length").alias("n"))
    share = F.pmod(F.xxhash64("doc_id", "text"), F.ceil(F.col("n") / F.lit(CHUNK_BYTES)))
    return meta.select(*cols, F.xxhash64("f", "b", share).alias("chunk"))


def n_buckets(rows: DataFrame) -> int:
    """As many as the table's size asks for; scores don't depend on it."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(LEAST_BUCKETS, math.ceil(size / BUCKET_BYTES)) if size < 1 << 60 else 256


def summed(df: DataFrame, k: int) -> list[int]:
    """The sums of the first k numbers of all rows of kind sums; a few numbers from each partition."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(k, np.int64)
        for (n,) in rows_of(batches, "n"):
            out += numbers(n, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k), pa.int32()), pa.array(out)], ["i", "v"])

    got = of_kind(df, "sums").select("n").mapInArrow(add, "i int, v long").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = dict.fromkeys(range(k), 0) | {r["i"]: r["v"] for r in got}
    return [out[i] for i in range(k)]


def score_documents(docs: DataFrame, held_out: Column, *, buckets: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text.

    Tokens are the lower-cased (A-Z) words and one end; the model learns from rows that aren't
    held out. A null or empty text is its end alone. Words that training lacks share the base's
    weight for one more word. base_score is the add-one unigram model's log10 probability, score
    that of the probabilities averaged over samples. Repeated rows are learnt as often as they
    stand there; null ids are documents like others; other columns are ignored. Very long texts
    count whole, in one chunk's memory. An empty table gives no rows. `buckets` (by default a
    number that grows with the table's size) and the session's partitions change no score.
    """
    small_batches(docs.sparkSession)
    rows = chunked(docs, held_out)
    n = buckets or n_buckets(rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, tuple[list[str], list[bool]]] = {}
        for text, held, chunk in rows_of(batches, "text", "held_out", "chunk"):
            texts, train = open_.setdefault(chunk, ([], []))
            texts.append(text)
            train.append(not held)
        for chunk in list(open_):
            texts, train = open_.pop(chunk)
            yield requests(chunk, Chunk(texts), np.array(train, bool), n)
            del texts
            trim()

    asked = rows.select("text", "held_out", "chunk").mapInArrow(trimmed(count), "bucket int, chunk long, keys binary, per binary, contexts binary, count binary")
    cells = stored(asked.groupBy("bucket").applyInArrow(trimmed_group(lambda t: cells_of_bucket(t, n)), ROW), "cells")
    train_tokens, vocabulary, customers, tables = summed(cells, 4)
    total = lambda df: of_kind(df, "message").groupBy("bucket").applyInArrow(trimmed_group(totalled), ROW)
    known = [of_kind(cells, "cells", "place")]
    seats, root, gone = cells, [], []
    for number in range(BURN_IN + SAMPLES):
        totals = stored(total(seats), "totals")
        if number in (0, *range(BURN_IN + 1, BURN_IN + SAMPLES)):
            known.append(of_kind(totals, "total").withColumn("other", F.lit(number - BURN_IN - 1)))
        else:
            gone.append(totals)
        sums = (vocabulary, customers, tables)
        both = of_kind(seats, "seats").groupBy("bucket").cogroup(of_kind(totals, "answer").groupBy("bucket"))
        seats = stored(both.applyInArrow(trimmed_pair(lambda a, b, number=number, sums=sums: swept(a, b, n, number, sums)), ROW), "seats")
        for old in gone:
            discard(old)
        gone = []
        customers, tables = summed(seats, 2)
        if number >= BURN_IN:
            root.append((customers, tables))
            known.append(of_kind(seats, "sample"))
        else:
            gone.append(seats)
    known.append(of_kind(total(seats), "total").withColumn("other", F.lit(SAMPLES - 1)))
    every = known[0]
    for more in known[1:]:
        every = every.union(more)
    answers = every.groupBy("bucket").applyInArrow(trimmed_group(replies), REPLY)
    scale = math.log10(train_tokens + vocabulary + 1)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a chunk as one row, texts compressed."""
        open_: dict[int, list[tuple]] = {}
        for doc_id, text, held, chunk in rows_of(batches, "doc_id", "text", "held_out", "chunk"):
            open_.setdefault(chunk, []).append((doc_id, text.encode("utf-8", "replace"), held))
        for chunk in list(open_):
            ids, texts, held = zip(*open_.pop(chunk), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())), pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), pa.array([squeezed(b"".join(texts))], pa.binary())], ["chunk", "ids", "held", "lengths", "texts"])
            del texts
            trim()

    packs = rows.mapInArrow(trimmed(pack), "chunk long, ids array<long>, held array<boolean>, lengths array<long>, texts binary")

    def add_up(left: pa.Table, right: pa.Table) -> pa.Table:
        m = left.to_pylist()[0]
        every, ends = zstandard.ZstdDecompressor().decompress(m["texts"]), np.cumsum(m["lengths"])
        c = Chunk([every[b - k : b].decode() for k, b in zip(m["lengths"], ends, strict=True)])
        del every
        known, p = pair_probabilities(c, right.to_pylist(), n, vocabulary, root)
        doc = np.repeat(np.arange(len(c.lengths)), c.lengths)
        seen = known[c.token_word]
        add = lambda x: np.bincount(doc, x, len(c.lengths))
        base = add(np.log10(seen + 1.0)) - scale * c.lengths
        out = [pa.array(m["ids"], pa.int64()), pa.array(m["held"], pa.bool_()), pa.array(c.lengths), pa.array(add(seen > 0).astype(np.int64)), pa.array(np.full(len(c.lengths), train_tokens, np.int64)), pa.array(base), pa.array(add(np.log10(p)[c.token_pair]))]
        return pa.Table.from_arrays(out, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return packs.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(trimmed_pair(add_up), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
