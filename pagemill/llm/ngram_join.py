"""N-gram Jaccard join with a token-group matrix: exact links between documents by their 5-word shingles.

1. One pass over the texts: a set for each document, documents with equal sets are one class
   (the set's hash), and shingles found in many documents are marked in a bitmap of fixed size.
2. Similar classes are put into groups: classes that share a minimum hash are compared with the
   one of them that has most copies, and those with a third of their shingles in common make
   a group, linked or not.
3. The matrix: for each shingle of a prefix, the groups whose union has it. A link needs a
   certain number of shared prefix shingles under any one order of shingles; the order puts
   marked ones last, so passages that many documents share open nothing. Classes meet other
   groups in it.
4. For each class, its own group and each group it met: the overlap with the group's whole union
   bounds the overlap with its members; only groups that reach the bound are opened, and members
   compared. So every link is seen once from outside a group and from both ends inside one.

Sets are 64-bit hashes of shingles; all sums and thresholds are integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, n_partitions, pick, rows_of, small_batches, stored, trimmed, trimmed_group
from .graph import components

WIDTH, PERCENT = 5, 80
#: Similar enough, in percent, for one group.
SIMILAR = 30
#: Shingles in more documents than HOT are marked. Counted are those below the LOW quantile of hashes, and all of documents with fewer than SHORT.
HOT, LOW, SHORT = 16, 0.4, 256
#: A prefix has n // SPARE shingles more than one shared shingle would need.
SPARE = 20
#: What a task holds of shingles before it passes them on, and of pairs while it counts them.
TOKENS_AT_ONCE, PAIRS_AT_ONCE = 600_000, 400_000
#: Keys that the classes of one minimum hash are spread over where they meet the group's first.
SALTS = 8
_CUT = np.uint64(int(LOW * 2**64))
#: Bits of each bitmap (4 MB), minimum hashes of a class, members of a block, bytes of one task's sets.
BITS, MINIMA, BLOCK, TASK_BYTES = 1 << 25, 4, 256, 12 << 20
#: A group of more blocks than this, or of more than one share of queries, is large: one for each 1024 members or 2048 queries at most.
LARGE = 4
_ODD = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93)]
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def shingles(text: str | None) -> np.ndarray:
    """The distinct 5-word shingles of a text as sorted hashes; with fewer words, the whole sequence as one."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(w) < WIDTH:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(w))], np.uint64)
    h = w[: len(w) - WIDTH + 1].copy()
    for k in range(1, WIDTH):
        h ^= h >> np.uint64(29)
        h *= _MIX
        h += w[k : len(w) - WIDTH + 1 + k]
    h ^= h >> np.uint64(32)
    h *= _ODD[0]
    h ^= h >> np.uint64(29)
    return np.unique(h)


def prefix_length(n):
    """For a number or an array of set sizes: one more than a link may miss, and n // SPARE more, so that linked sets share several."""
    return n + PERCENT * -n // 100 + 1 + n // SPARE


def needed_hits(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Shared prefix shingles that a set of n needs with one of m to link, seen from the first of the two whose prefix ends.

    Up to that end all shared shingles are seen; after it there are n minus its prefix at most.
    """
    overlap = -(-PERCENT * (n + m) // (100 + PERCENT))
    return overlap - (n - prefix_length(n))


def slices_for(partitions: int) -> int:
    """Into how many slices shingles are dealt: grows with the session's shuffle partitions, a power of two."""
    return 1 << max(6, math.ceil(math.log2(max(partitions, 2) / 2)))


def sliced(tokens: np.ndarray, n: int, hot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Order of the tokens by slice (their low bits), and where each slice starts.

    With a bitmap of marks, marked tokens are dealt by ranges of hashes: sets that share many
    of them share neighbours in the order, and then meet in few slices rather than in many.
    """
    at = (tokens & np.uint64(n - 1)).astype(np.int64)
    if hot is not None:
        at = np.where(bit(hot, mark(tokens, n)), (tokens >> np.uint64(59)).astype(np.int64) * (n // 32), at)
    order = np.argsort(at, kind="stable")
    return order, np.searchsorted(at[order], np.arange(n + 1))


def mark(tokens: np.ndarray, n: int) -> np.ndarray:
    """Places in the bitmap. A slice has a range of its own there, so each slice's part is made apart."""
    return places((tokens & np.uint64(n - 1)).astype(np.int64), counted_bits(tokens), n)


def counted_bits(tokens: np.ndarray) -> np.ndarray:
    """What is kept of a token for counting, besides its slice: bits 12 to 43."""
    return (tokens >> np.uint64(12)).astype(np.uint32)


def places(slices: np.ndarray | int, bits: np.ndarray, n: int) -> np.ndarray:
    per = BITS // n
    return slices * per + (bits >> np.uint32(8)).astype(np.int64) % per


def prefix(s: np.ndarray, hot: np.ndarray, n: int) -> np.ndarray:
    """The first shingles in the order: unmarked low hashes, unmarked others, marked ones."""
    p = prefix_length(len(s))
    marked = bit(hot, mark(s, n))
    low = s < _CUT
    first = s[~marked & low]
    if len(first) >= p:
        return first[:p]
    return np.concatenate([first, s[~marked & ~low], s[marked]])[:p]


# --- the first pass: classes and marks

FIRST = "doc_id long, n long, cls long, " + ", ".join(f"m{i} long" for i in range(MINIMA)) + ", slice int, blob binary"


def first_pass(docs: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: list[np.ndarray] = []
        size = 0
        fields = [f.split() for f in FIRST.split(", ")]
        schema = pa.schema([(k, {"int": pa.int32(), "binary": pa.binary()}.get(t, pa.int64())) for k, t in fields])

        def flush() -> pa.RecordBatch:
            t = np.concatenate(counted)
            order, at = sliced(t, n)
            t = counted_bits(t[order])
            part = [i for i in range(n) if at[i] < at[i + 1]]
            none = pa.nulls(len(part), pa.int64())
            return pa.RecordBatch.from_arrays([none] * (3 + MINIMA) + [pa.array(part, pa.int32()), pa.array([np.sort(t[at[i] : at[i + 1]]).tobytes() for i in part], pa.binary())], schema=schema)

        rows: list[list] = [[] for _ in range(3 + MINIMA)]
        for doc_id, text in rows_of(batches, "doc_id", "text"):
            s = shingles(text)
            cls = xxhash.xxh3_64_intdigest(s.tobytes()) >> 1 if len(s) else None
            minima = [int((s * o).min() >> np.uint64(1)) for o in _ODD] if len(s) else [None] * MINIMA
            for c, v in zip(rows, (doc_id, len(s), cls, *minima), strict=True):
                c.append(v)
            if len(s):
                counted.append(s if len(s) < SHORT else s[: np.searchsorted(s, _CUT)])
                size += len(counted[-1])
            if len(rows[0]) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows] + [pa.nulls(len(rows[0]), pa.int32()), pa.nulls(len(rows[0]), pa.binary())], schema=schema)
                rows = [[] for _ in rows]
            if size >= TOKENS_AT_ONCE:
                yield flush()
                counted, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows] + [pa.nulls(len(rows[0]), pa.int32()), pa.nulls(len(rows[0]), pa.binary())], schema=schema)
        if counted:
            yield flush()

    return docs.mapInArrow(trimmed(run), FIRST)


def marked(first: DataFrame, n: int, hot: int) -> np.ndarray:
    """The bitmap of shingles in more than `hot` documents. Each slice counts its own shingles; the driver gets BITS bits in all."""
    per = BITS // n

    def count(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(np.concatenate([np.frombuffer(b, np.uint32) for b in pdf["blob"]]))
        often = t[hot:][t[hot:] == t[: len(t) - hot]] if len(t) > hot else t[:0]
        bits = np.zeros(per, bool)
        bits[places(0, np.unique(often), n)] = True
        return pd.DataFrame({"slice": [key[0]], "bits": [np.packbits(bits).tobytes()]})

    out = np.zeros(BITS // 8, np.uint8)
    for r in first.where("slice IS NOT NULL").select("slice", "blob").groupBy("slice").applyInPandas(count, "slice int, bits binary").collect():
        out[r["slice"] * per // 8 : (r["slice"] + 1) * per // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def bit(bits: np.ndarray, at: np.ndarray | int):
    """Whether bits of a packed bitmap are set."""
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1 if isinstance(at, np.ndarray) else bool(bits[at >> 3] >> (7 - (at & 7)) & 1)


def bitmap(keys: DataFrame) -> np.ndarray:
    """Bits of pmod(key, BITS) for a table of one long column, packed by ranges; a filter with false hits, never false misses."""
    span = 1 << 16

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(span, bool)
        bits[pdf["at"].to_numpy(np.int64)] = True
        return pd.DataFrame({"part": [key[0]], "bits": [np.packbits(bits).tobytes()]})

    place = F.pmod(F.col(keys.columns[0]), F.lit(BITS))
    parts = keys.select((place / span).cast("int").alias("part"), (place % span).cast("int").alias("at")).distinct()
    out = np.zeros(BITS // 8, np.uint8)
    for r in parts.groupBy("part").applyInPandas(pack, "part int, bits binary").collect():
        out[r["part"] * span // 8 : (r["part"] + 1) * span // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def in_bitmap(bits: np.ndarray, key: Column) -> Column:
    """Whether a long key may be among those of a bitmap; only the key travels to Python."""

    @F.arrow_udf(returnType="boolean")
    def hit(at: pa.Array) -> pa.Array:
        return pa.array(bit(bits, at.to_numpy(zero_copy_only=False)), pa.bool_())

    return hit(F.pmod(key, F.lit(BITS)))


# --- comparing classes with groups


def sets_of(docs: DataFrame, classes: DataFrame, needed: DataFrame) -> DataFrame:
    """cls, toks (sorted hashes) of the needed classes, from the text of each one's first document.

    A few others come along (false hits of the bitmap), and repeated rows come repeatedly.
    """
    row_key = F.xxhash64(F.coalesce("doc_id", F.lit(-1)))
    who = classes.join(needed.select("cls").distinct(), "cls", "left_semi")
    want = bitmap(who.select(F.xxhash64(F.coalesce("rep", F.lit(-1))).alias("key")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = bit(want, b.column("at").to_numpy())
            part = b.filter(pa.array(hit))
            for i in range(0, part.num_rows, 512):
                sets = [shingles(t) for t in part.column("text").slice(i, 512).to_pylist()]
                sets = [s for s in sets if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_64_intdigest(s.tobytes()) >> 1 for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["cls", "toks"])

    return docs.select("text", F.pmod(row_key, F.lit(BITS)).alias("at")).mapInArrow(trimmed(run), "cls long, toks binary")


def opened(rows: pd.DataFrame, least: int) -> pd.DataFrame:
    """Rows grp, part, asks, own, copies, cls, toks: members, and queries (asks; own: of their own group); a part is a block of a group's members with a share of its queries.

    Links of each query with members that have `least` percent in common with it: one for each set
    of members that the part's earlier queries haven't connected yet; strong: they have PERCENT.
    n adds up to the rows that a class (u) has such links with; a row of members of other groups
    than the query's, which don't ask back, has u = v.
    """
    rows = rows.drop_duplicates(["grp", "part", "asks", "cls"])
    left, right = rows[~rows["asks"]], rows[rows["asks"]]
    out = []
    members = {k: v for k, v in left.groupby(["grp", "part"], sort=False)}
    for key, queries in right.groupby(["grp", "part"], sort=False):
        if (own := members.get(key)) is None:
            continue
        sets = [np.frombuffer(t, np.uint64) for t in own["toks"]]
        ids, sizes = own["cls"].to_numpy(), np.array([len(s) for s in sets])
        every = np.concatenate(sets)
        order = np.argsort(every, kind="stable")
        every, owner = every[order], np.repeat(np.arange(len(sets)), sizes)[order]
        root, copies, asked = np.arange(len(sets)), own["copies"].to_numpy(), np.zeros(len(sets), np.int64)
        for cls, toks, inside, times in zip(queries["cls"], queries["toks"], queries["own"], queries["copies"], strict=True):
            q = np.frombuffer(toks, np.uint64)
            lo, hi = np.searchsorted(every, q, "left"), np.searchsorted(every, q, "right")
            n = hi - lo
            if 100 * int((n > 0).sum()) < least * len(q):  # the bound by the group's union
                continue
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
            common = np.bincount(owner[at], minlength=len(sets))
            common[ids == cls] = 0
            union = len(q) + sizes - common
            linked = np.flatnonzero((100 * common >= least * union) & (ids != cls))
            roots, first = np.unique(root[linked], return_index=True)
            if len(roots) > 1:
                root[np.isin(root, roots)] = roots[0]
            n = int(copies[linked].sum())
            for k in linked[first]:
                out.append((cls, ids[k], 100 * int(common[k]) >= PERCENT * int(union[k]), n))
                n = 0
            if not inside:
                asked[linked] += times
        out += [(ids[k], ids[k], True, asked[k]) for k in np.flatnonzero(asked)]
    u, v, strong, n = zip(*out, strict=True) if out else ((), (), (), ())
    return pd.DataFrame({"u": np.array(u, np.int64), "v": np.array(v, np.int64), "strong": np.array(strong, bool), "n": np.array(n, np.int64)})


def with_sizes(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """rows with their group's blocks and shares, where it has any. The few large groups' are sent to all tasks, for one group may hold most rows."""
    large = (F.col("blocks") > LARGE) | (F.col("shares") > 1)
    few = F.broadcast(sizes.where(large))
    rest = rows.join(few.select("grp"), "grp", "left_anti").join(sizes.where(~large).hint("merge"), "grp")
    return rows.join(few, "grp").unionByName(rest)


def compared(docs: DataFrame, classes: DataFrame, met: DataFrame, members: DataFrame, least: int) -> DataFrame:
    """met(q, grp, own), members(grp, cls) -> u, v, strong, n: links that connect each query with all members it has `least` percent in common with, and their numbers.

    Groups are cut into blocks of members and queries into shares, so that no task holds an
    unbounded group; blocks go to tasks by hash, about TASK_BYTES of sets to one.
    """
    met = stored(met.distinct(), "met")
    queries = met.groupBy("grp").agg(F.ceil(F.count("*") / (8 * BLOCK)).cast("int").alias("shares"))
    sizes = stored(members.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).join(queries, "grp"), "sizes")
    inside = stored(with_sizes(members.select("grp", "cls"), sizes), "members")
    asked = with_sizes(met, sizes)
    sets = stored(sets_of(docs, classes, inside.select("cls").union(met.select(F.col("q").alias("cls")))), "sets")
    mean = sets.agg(F.coalesce(F.avg(F.octet_length("toks")), F.lit(0.0))).first()[0]
    tasks = max(2 * n_partitions(docs.sparkSession), math.ceil(mean * (inside.count() + met.count()) / TASK_BYTES))
    copies = classes.select("cls", "copies")
    left = inside.withColumn("b", F.pmod(F.xxhash64("cls"), F.col("blocks"))).withColumn("s", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    right = asked.withColumn("s", F.pmod(F.xxhash64("q"), F.col("shares"))).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    part = F.concat_ws("-", F.col("b").cast("string"), F.col("s").cast("string")).alias("part")
    both = left.select("grp", part, F.lit(False).alias("asks"), F.lit(False).alias("own"), "cls").union(right.select("grp", part, F.lit(True).alias("asks"), "own", F.col("q").alias("cls")))
    task = F.pmod(F.xxhash64("grp", "part"), F.lit(tasks)).alias("task")
    rows = both.join(copies, "cls").select(task, "grp", "part", "asks", "own", "copies", "cls").join(sets, "cls")
    found = stored(rows.groupBy("task").applyInPandas(trimmed_group(lambda r: opened(r, least)), "u long, v long, strong boolean, n long"), "found")
    discard(sets)
    return found


# --- the matrix

ENTRY = "slice int, toks binary, grps binary, clss binary, ns binary"


def entries(tokens: np.ndarray, grps: np.ndarray, clss: np.ndarray, ns: np.ndarray, n: int, hot: np.ndarray) -> pa.RecordBatch:
    """Matrix entries by slice, a row for each."""
    order, at = sliced(tokens, n, hot)
    part = [i for i in range(n) if at[i] < at[i + 1]]
    tokens, grps, clss, ns = (x[order] for x in (tokens, grps, clss, ns))
    cut = lambda x: pa.array([x[at[i] : at[i + 1]].tobytes() for i in part], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), cut(tokens), cut(grps), cut(clss), cut(ns)], ["slice", "toks", "grps", "clss", "ns"])


def prefixes(docs: DataFrame, hot: np.ndarray, grouped: np.ndarray, n: int) -> DataFrame:
    """Matrix entries of the classes that may not be in a group of several (each its own group), and (cls, n, toks) of those that may be."""
    schema = ENTRY + ", cls long, n long, own binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toks, clss, ns, size, seen = [], [], [], 0, set()
        later: list[tuple[int, int, bytes]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if toks:
                k = np.array([len(t) for t in toks])
                c = np.repeat(np.array(clss, np.int64), k)
                b = entries(np.concatenate(toks), c, c, np.repeat(np.array(ns, np.int32), k), n, hot)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.nulls(len(b), pa.int64()), pa.nulls(len(b), pa.int64()), pa.nulls(len(b), pa.binary())], [*b.schema.names, "cls", "n", "own"])
            if later:
                k = len(later)
                yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int32()), *[pa.nulls(k, pa.binary())] * 4, pa.array([x[0] for x in later], pa.int64()), pa.array([x[1] for x in later], pa.int64()), pa.array([x[2] for x in later], pa.binary())], ["slice", "toks", "grps", "clss", "ns", "cls", "n", "own"])

        for (text,) in rows_of(batches, "text"):
            s = shingles(text)
            if not len(s):
                continue
            cls = xxhash.xxh3_64_intdigest(s.tobytes()) >> 1
            if cls in seen:  # a copy in this task
                continue
            seen.add(cls)
            p = prefix(s, hot, n)
            if bit(grouped, cls % BITS):
                later.append((cls, len(s), p.tobytes()))
            else:
                toks.append(p)
                clss.append(cls)
                ns.append(len(s))
            size += len(p)
            if size >= TOKENS_AT_ONCE:
                yield from flush()
                toks, clss, ns, size, later = [], [], [], 0, []
        yield from flush()

    return docs.select("text").mapInArrow(trimmed(run), schema)


def regrouped(own: DataFrame, n: int, hot: np.ndarray) -> DataFrame:
    """cls, n, own, grp -> matrix entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = [np.frombuffer(x, np.uint64) for x in b.column("own").to_pylist()]
            if t:
                k = np.array([len(x) for x in t])
                yield entries(np.concatenate(t), np.repeat(b.column("grp").to_numpy(), k), np.repeat(b.column("cls").to_numpy(), k), np.repeat(b.column("n").to_numpy().astype(np.int32), k), n, hot)

    return own.mapInArrow(trimmed(run), ENTRY)


def meetings(pdf: pd.DataFrame) -> pd.DataFrame:
    """Classes, the other groups they meet in this slice, at how many of its shingles, and how many hits in all they need.

    In a run of one shingle, each class counts once for each group that comes later in order,
    if sizes permit. A group's need is the least of those of its members that are met.
    """
    tok, grp, cls, n = (np.concatenate([np.frombuffer(b, kind) for b in pdf[c]]) for c, kind in (("toks", np.uint64), ("grps", np.int64), ("clss", np.int64), ("ns", np.int32)))
    order = np.lexsort((cls, grp, tok))
    tok, grp, cls, n = tok[order], grp[order], cls[order], n[order].astype(np.int64)
    new = np.concatenate([[True], (tok[1:] != tok[:-1]) | (cls[1:] != cls[:-1])])
    tok, grp, cls, n = tok[new], grp[new], cls[new], n[new]
    run_start = np.concatenate([[True], tok[1:] != tok[:-1]])
    group_start = run_start | np.concatenate([[True], grp[1:] != grp[:-1]])
    run, target = np.cumsum(run_start) - 1, np.cumsum(group_start) - 1
    first = np.flatnonzero(group_start)
    low, high = np.minimum.reduceat(n, first), np.maximum.reduceat(n, first)
    last = np.flatnonzero(np.concatenate([group_start[1:] & run_start[1:], [True]]))  # rows that end a run
    later = target[last][run] - target  # groups of the run after a row's own
    names, q = np.unique(cls, return_inverse=True)
    groups, g = np.unique(grp[first], return_inverse=True)
    rows = np.flatnonzero(later)
    ends = np.cumsum(later[rows])
    keys, hits, need, at = [], [], [], 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
        part = rows[at:to]
        k = later[part]
        src = np.repeat(part, k)
        dst = np.repeat(target[part] + 1 - np.concatenate([[0], np.cumsum(k)[:-1]]), k) + np.arange(int(k.sum()))
        ok = (100 * high[dst] >= PERCENT * n[src]) & (PERCENT * low[dst] <= 100 * n[src])
        src, dst = src[ok], dst[ok]
        u, back, c = np.unique(q[src] * len(groups) + g[dst], return_inverse=True, return_counts=True)
        least = np.full(len(u), np.iinfo(np.int64).max)
        few = np.minimum(needed_hits(n[src], low[dst]), needed_hits(high[dst], n[src]))
        np.minimum.at(least, back, few - 2 * (low[dst] < high[dst]))  # rounding isn't monotone in a member's size
        keys.append(u)
        hits.append(c)
        need.append(least)
        at = to
    if not keys:
        return pd.DataFrame({c: np.empty(0, np.int64) for c in ("q", "grp", "hits", "need")})
    u, back = np.unique(np.concatenate(keys), return_inverse=True)
    least = np.full(len(u), np.iinfo(np.int64).max)
    np.minimum.at(least, back, np.concatenate(need))
    total = np.bincount(back, np.concatenate(hits), minlength=len(u)).astype(np.int64)
    return pd.DataFrame({"q": names[u // len(groups)], "grp": groups[u % len(groups)], "hits": total, "need": least})


def grouped(links: DataFrame) -> DataFrame:
    return stored(components(links).select(F.col("node").alias("cls"), F.col("component").alias("grp")), "groups")


def jaccard_join(docs: DataFrame, *, hot: int = HOT) -> DataFrame:
    """doc_id, n_shingles, n_links, component_id of every document; links are 100 * common >= 80 * union of 5-word shingle sets.

    n_links is the number of other rows that a document links with, copies included.

    Needs doc_id and text; other columns are ignored. A null text and one without words have no
    shingles and link with nothing: component_id is their own id. Equal sets (copies, repeated
    rows) are one class from the first pass on, so they are never paired. A null id is never a
    component's id unless all in it are null. Very long texts count whole. An empty table gives
    no rows. `hot` only steers cost: whatever it is, every link is found.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = pick(docs, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("long"))
    n = slices_for(n_partitions(spark))
    first = stored(first_pass(docs, n), "first")
    hot_bits = marked(first, n, hot)
    rows = stored(first.where("slice IS NULL").select("doc_id", "n", "cls", *[f"m{i}" for i in range(MINIMA)]), "rows")
    discard(first)
    classes = stored(rows.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.count("*").alias("copies"), *[F.min(f"m{i}").alias(f"m{i}") for i in range(MINIMA)]), "classes")

    # groups: each class against the class with most copies in its buckets, most likely what others were made from
    buckets = classes.select("cls", "n", "copies", F.posexplode(F.array(*[f"m{i}" for i in range(MINIMA)])).alias("i", "m"))
    leaders = buckets.groupBy("i", "m").agg(F.min(F.struct(-F.col("copies"), "cls")).getField("cls").alias("lead"), F.count("*").alias("k")).where("k > 1").drop("k")
    sizes = classes.select(F.col("cls").alias("lead"), F.col("n").alias("ln"))
    salted = buckets.withColumn("salt", F.pmod(F.xxhash64("cls"), F.lit(SALTS)).cast("int"))  # many classes may share a minimum
    leaders = leaders.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    near = salted.join(leaders, ["i", "m", "salt"]).where("cls <> lead").select("cls", "n", "lead").distinct().join(sizes, "lead")
    near = stored(near.where(f"100 * least(n, ln) >= {SIMILAR} * greatest(n, ln)").select("cls", "lead"), "near")
    ones = near.select(F.col("lead").alias("grp")).distinct().withColumn("cls", F.col("grp"))
    near = compared(docs, classes, near.select(F.col("cls").alias("q"), F.col("lead").alias("grp"), F.lit(False).alias("own")), ones, SIMILAR)
    groups = grouped(near)

    # the matrix: classes that meet other groups
    made = stored(prefixes(docs, hot_bits, bitmap(groups.select("cls")), n), "matrix")
    own = made.where("slice IS NULL").select("cls", "n", "own").dropDuplicates(["cls"]).join(groups, "cls", "left").withColumn("grp", F.coalesce("grp", "cls"))
    matrix = made.where("slice IS NOT NULL").select("slice", "toks", "grps", "clss", "ns").union(regrouped(own, n, hot_bits))
    met = matrix.groupBy("slice").applyInPandas(trimmed_group(meetings), "q long, grp long, hits long, need long")
    met = stored(met.groupBy("q", "grp").agg(F.sum("hits").alias("hits"), F.min("need").alias("need")).where("hits >= need").select("q", "grp"), "meetings")
    discard(made)
    # within a group each class asks all of it, whatever links are known: links are counted here
    inner = groups.select(F.col("cls").alias("q"), "grp", F.lit(True).alias("own"))
    alone = met.select("grp").distinct().join(groups.select("grp").distinct(), "grp", "left_anti").select("grp", F.col("grp").alias("cls"))
    more = compared(docs, classes, met.withColumn("own", F.lit(False)).union(inner), groups.select("grp", "cls").union(alone), PERCENT)
    counts = more.groupBy(F.col("u").alias("cls")).agg(F.sum("n").alias("n"))

    found = components(more.where("u <> v").select("u", "v"))
    rooted = classes.select("cls", "rep", "copies").join(found.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = rooted.groupBy("component").agg(F.min("rep").alias("component_id"))
    ids = rooted.join(least, "component").join(counts, "cls", "left").select("cls", "component_id", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("links"))
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "cls").join(ids, "cls", "left").select("doc_id", "n_shingles", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component)
