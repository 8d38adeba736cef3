"""Mixing sources to target weights by Efraimidis-Spirakis sampling; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, pick, stored

#: Ranges of keys to each doubling, and parts of a range; only the part that holds a budget's end is sorted.
STEPS, PARTS = 256, 4096
#: So many sources' thresholds are broadcast; with more, a source's documents are spread over SALTS keys.
BROADCAST_SOURCES, SALTS = 20_000, 64


def doc_quality(size: Column, chars: Column) -> Column:
    """The default quality weight, in (0, 1]: 1 for a mean word of 6 characters (with its space), less the further off it is."""
    mean = chars.cast("double") / F.greatest(size, F.lit(1))
    return F.lit(1.0) / (F.lit(1.0) + F.abs(mean - F.lit(6.0)) / F.lit(6.0))


def sampling_key(doc_id: Column, text: Column, weight: Column, seed: int) -> Column:
    """-ln(u) / weight, u in (0, 1) from the md5 of id, text and seed: small keys are drawn first, a document of twice the weight twice as readily."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f"#{seed}#"), F.md5(F.coalesce(text, F.lit("")))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(u) / weight


def with_size_and_key(docs: DataFrame, seed: int) -> DataFrame:
    """Adds size (words of the text; null: 0) and key."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    out = docs.withColumn("size", size)
    return out.withColumn("key", sampling_key(F.col("doc_id"), F.col("text"), doc_quality(F.col("size"), F.coalesce(F.length("text"), F.lit(0))), seed))


def targets(sizes: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """source, source_size -> target: share of all sizes dealt out by weight, at most `most` times a source's size, the excess reshared.

    Where each source's cap / weight is in order, the capped sources come first, so that
    prefix sums of caps and suffix sums of weights give the level without a loop. One row
    a source: the single-partition windows hold no documents.
    """
    cyc = F.array(*[F.lit(int(w)) for w in weights])
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    w = ranked.withColumn("weight", F.element_at(cyc, ((F.col("rank") - 1) % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("rank"))
    before = F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing))
    every = Window.partitionBy(F.lit(1))
    level = w.withColumn("level", (F.sum("source_size").over(every) * F.lit(float(share)) - before) / rest)
    full = level.withColumn("full", F.col("cap") / F.col("weight") <= F.col("level"))
    last = F.max(F.when(~F.col("full"), F.col("level"))).over(every)
    return full.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * last).alias("target"))


def ends_in(groups: DataFrame, by: str, goal: DataFrame) -> DataFrame:
    """groups(source, by, words) and goal(g, budget, before): g, by and the words before the one of a source's groups in which its budget ends."""
    earlier = Window.partitionBy("source").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    reached = groups.join(goal, F.col("source").eqNullSafe(F.col("g"))).withColumn("before", F.col("before") + F.coalesce(F.sum("words").over(earlier), F.lit(0)))
    return reached.where("before < budget AND budget <= before + words")


def thresholds(keyed: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """One row a source: source_size, target, epochs (complete), edge (the key where the budget ends), and at the edge: left words for ties documents.

    keyed: source, size, key. Ranges are steps of the key's logarithm, so that they split a
    source alike whatever weights its documents have: sums by (source, range) find the range
    in which a budget ends, sums by (source, part of that range) the part, and only that part,
    some millionth of a source, is sorted.
    """
    steps = F.log2("key") * STEPS
    ranged = keyed.where("size > 0").withColumn("range", F.floor(steps)).withColumn("part", F.floor((steps - F.floor(steps)) * PARTS))
    sizes = keyed.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(sizes, weights, share, most)
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = goal.withColumn("budget", F.floor("target") - F.col("epochs") * F.col("source_size"))
    sums = ranged.groupBy("source", "range").agg(F.sum("size").alias("words"))
    ends = ends_in(sums, "range", goal.select(F.col("source").alias("g"), "budget", F.lit(0).cast("long").alias("before"))).select(F.col("source").alias("e"), F.col("range").alias("r"), "before", "budget")
    parts = ranged.join(ends, F.col("source").eqNullSafe(F.col("e")) & (F.col("range") == F.col("r"))).groupBy("source", "part").agg(F.sum("size").alias("words"))
    ends = ends_in(parts, "part", ends.select(F.col("e").alias("g"), "r", "budget", "before")).select(F.col("source").alias("e"), "r", F.col("part").alias("p"), "before", "budget")
    edge = ranged.join(ends, F.col("source").eqNullSafe(F.col("e")) & (F.col("range") == F.col("r")) & (F.col("part") == F.col("p"))).groupBy("source", "key").agg(F.sum("size").alias("words"), F.count("*").alias("ties"))
    edge = ends_in(edge, "key", ends.select(F.col("e").alias("g"), "budget", "before"))
    edge = edge.select(F.col("source").alias("x"), F.col("key").alias("edge"), (F.col("budget") - F.col("before")).alias("left"), "ties")
    return goal.join(edge, F.col("source").eqNullSafe(F.col("x")), "left").select(F.col("source").alias("t"), "source_size", "target", "epochs", F.coalesce("edge", F.lit(-1.0)).alias("edge"), F.coalesce("left", F.lit(0)).alias("left"), F.coalesce("ties", F.lit(0)).alias("ties"))


def with_taken(docs: DataFrame, t: DataFrame) -> DataFrame:
    """docs(source, doc_id, size, key, ...) with its source's thresholds and `taken`, without dealing documents by source.

    Complete epochs, then documents before the edge whole; what is left at the edge goes to the
    document there. One row a source is broadcast where their number, which is counted first,
    allows it. Beyond, documents of a source are spread over SALTS keys. Only where several rows
    stand at an edge (they are equal then) are those written, numbered and served in order.
    """
    t = stored(t, "thresholds")
    many = t.agg(F.count("*").alias("n"), F.coalesce(F.max("ties"), F.lit(0)).alias("ties")).first()
    if many["n"] <= BROADCAST_SOURCES:
        met = docs.join(F.broadcast(t), F.col("source").eqNullSafe(F.col("t")), "left")
    else:
        salted = docs.withColumn("salt", F.pmod(F.xxhash64("doc_id", "key"), F.lit(SALTS)))
        met = salted.join(t.withColumn("salt_t", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), F.col("source").eqNullSafe(F.col("t")) & (F.col("salt") == F.col("salt_t")), "left").drop("salt", "salt_t")
    if many["ties"] <= 1:
        return met.withColumn("taken", taken_words(F.lit(0)))
    tied = (F.col("key") == F.col("edge")) & (F.col("ties") > 1)
    out = met.where(~tied).withColumn("taken", taken_words(F.lit(0)))
    # a written table keeps the numbers; rows are in order within the part of the table where they were read
    at = stored(met.where(tied).withColumn("place", F.monotonically_increasing_id()).withColumn("lot", F.shiftright("place", 33)), "ties")
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    lots = at.groupBy("source", "lot").agg(F.sum("size").alias("words"))
    lots = lots.withColumn("before", F.coalesce(F.sum("words").over(earlier(Window.partitionBy("source").orderBy("lot"))), F.lit(0))).select(F.col("source").alias("s"), F.col("lot").alias("l"), "before")
    inside = F.coalesce(F.sum("size").over(earlier(Window.partitionBy("source", "lot").orderBy("place"))), F.lit(0))
    at = at.withColumn("inside", inside).join(lots, F.col("source").eqNullSafe(F.col("s")) & (F.col("lot") == F.col("l")))
    return out.unionByName(at.withColumn("taken", taken_words(F.col("before") + F.col("inside"))).select(out.columns))


def taken_words(before: Column) -> Column:
    """Of a document with `before` words of equal documents before it."""
    part = F.when(F.col("key") < F.col("edge"), F.col("size")).when(F.col("key") == F.col("edge"), F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - before))).otherwise(F.lit(0))
    return (F.col("epochs") * F.col("size") + part).cast("long")


def mix_sources(docs: DataFrame, *, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 42) -> DataFrame:
    """doc_id, size, source_size, target, taken: how many words of each document a mix takes, repeats counted.

    Needs doc_id, text, source; other columns are ignored. A null or empty text has size 0
    and is taken 0 times; a null source is a source of its own, last in order; a null id is
    an id like another. Repeated rows are separate documents with equal keys: where a budget ends
    among them, they are served one after another. Very long texts count whole. An empty table
    gives no rows. Reruns agree: keys are hashes of ids and texts.
    """
    keyed = stored(with_size_and_key(pick(docs, doc_id="doc_id", text="text", source="source"), seed).drop("text"), "mix")
    t = thresholds(keyed, weights, share, most)
    return with_taken(keyed, t).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, *, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 42) -> DataFrame:
    """The mix itself: each document as often as its taken words hold it, all columns of docs kept.

    A remainder at a source's edge becomes one more row whose text ends after that many words
    (columns derived from the text, such as n_chars, keep the whole document's value).
    """
    names = docs.columns
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id").alias("doc_id"), F.col("text").alias("text"), F.col("source").alias("source"))
    inner = with_size_and_key(inner, seed)
    t = thresholds(stored(inner.select("source", "size", "key"), "mix"), weights, share, most)
    out = with_taken(inner, t)
    whole, part = F.floor(F.col("taken") / F.greatest("size", F.lit(1))).cast("int"), (F.col("taken") % F.greatest("size", F.lit(1))).cast("int")
    copies = out.where("taken > 0").select("row", "text", F.explode(F.concat(F.array_repeat(F.lit(None).cast("int"), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))).alias("words"))
    cut = F.when(F.col("words").isNull(), F.col("text")).otherwise(F.array_join(F.slice(F.regexp_extract_all("text", F.lit(rf"(?s)[\x20\x09-\x0D]*{WORD}"), F.lit(0)), 1, F.coalesce("words", F.lit(0))), ""))
    return copies.select([cut.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in names])


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, length(coalesce(text, '')) AS chars, md5(coalesce(text, '')) AS content FROM documents
), k AS (
  SELECT doc_id, source, size,
    -ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '#42#' || content), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0)
      / (1.0 / (1.0 + abs(chars::DOUBLE / greatest(size, 1) - 6.0) / 6.0)) AS key FROM d
), s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
r AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank, source_size * 2.0::DOUBLE AS cap FROM s
), w AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM r),
l AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), f AS (SELECT *, max(CASE WHEN cap / weight <= level THEN NULL ELSE level END) OVER () AS last FROM l),
t AS (
  SELECT source, source_size, CASE WHEN cap / weight <= level THEN cap ELSE weight * last END::DOUBLE AS target FROM f
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM t
), c AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, floor(e.target)::BIGINT - e.epochs * e.source_size AS budget,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id ROWS UNBOUNDED PRECEDING) - k.size AS before
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - before)))::BIGINT AS taken FROM c
"""
