"""SQL (DuckDB) for the rows of queries, and queries for the parts of operators that SQL can say."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licenses, mixing, queries

LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
#: crc32 of an id as text, bit by bit.
CRC32 = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({0}::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
#: Links (i, j) in both directions of all(id) -> the least id reachable.
COMPONENTS = "r AS (SELECT i, j FROM links UNION SELECT r.i, l.j FROM r JOIN links l ON r.j = l.i), least_of AS (SELECT i, min(j) AS j FROM r GROUP BY i), degree AS (SELECT i, count(*) AS n FROM links GROUP BY i)"

NGRAM_JOIN = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(LOWER.format("coalesce(text, '')"))} AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT i, j FROM common JOIN n a ON a.doc_id = i JOIN n b ON b.doc_id = j WHERE 100 * c >= 80 * (a.n + b.n - c)),
{COMPONENTS}
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(degree.n, 0)::BIGINT AS n_links, least(d.doc_id, coalesce(least_of.j, d.doc_id))::BIGINT AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN degree ON degree.i = d.doc_id LEFT JOIN least_of ON least_of.i = d.doc_id
"""

EMBEDDINGS = f"""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE embedding IS NOT NULL),
u AS (SELECT vec_id, e, len(e) AS k FROM v WHERE list_sum(list_transform(e, lambda x: x * x)) > 0),
links AS (SELECT a.vec_id AS i, b.vec_id AS j FROM u a JOIN u b ON a.k = b.k AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
{COMPONENTS}
SELECT v.vec_id, coalesce(degree.n, 0)::BIGINT AS n_links, least(v.vec_id, coalesce(least_of.j, v.vec_id))::BIGINT AS component_id, coalesce(v.vec_id <= least_of.j, true) AS kept
FROM embeddings v LEFT JOIN degree ON degree.i = v.vec_id LEFT JOIN least_of ON least_of.i = v.vec_id
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT hex, min(page_id) AS first FROM p GROUP BY hex),
d AS (SELECT page_id, payload, first, list_transform(range(0, 8), lambda k: ('0x' || substr(p.hex, (5 * k + 1)::INTEGER, 5))::BIGINT) AS fifths FROM p JOIN f ON p.hex = f.hex)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((fifths[k // 4 + 1] >> (15 - 5 * (k % 4))) & 31)::INTEGER + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END::BIGINT AS refers_to FROM d
"""


def lm_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the language model's rows hold besides its score."""
    return queries.op2_lm_scoring(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 3).alias("base_score"))


LM_BASE = f"""
WITH t AS (SELECT doc_id, {CRC32.format("doc_id")} % 7 = 2 AS held_out, unnest(list_concat({WORDS.format(LOWER.format("coalesce(text, '')"))}, [' '])) AS w FROM documents),
c AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w), n AS (SELECT sum(c)::BIGINT AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*)::BIGINT AS n_tokens, count(c.c)::BIGINT AS n_known, n.n AS train_tokens, round(sum(log10((coalesce(c.c, 0) + 1.0) / (n.n + n.v + 1))), 3) AS base_score
FROM t LEFT JOIN c ON c.w = t.w, n GROUP BY doc_id, held_out, n.n
"""


def license_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of the license scan."""
    return queries.op3_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


_PLACES = " UNION ALL ".join(
    f"SELECT doc_id, unnest(list_filter(range(0, len(w)), lambda k: {' AND '.join(f'w[k + {i + 1}] = {chr(39)}{x}{chr(39)}' for i, x in enumerate(phrase.split()))})) AS place, '{label}' AS label FROM w" for phrase, label in licenses.PHRASES.items()
)
LICENSE_BASE = f"""
WITH w AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p AS ({_PLACES}), g AS (SELECT doc_id, count(*) AS n, min(place) AS a, max(place) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM p GROUP BY doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(g.n, 0)::BIGINT AS n_base, g.a::BIGINT AS first_word, g.z::BIGINT AS last_word, coalesce(g.labels, '') AS base_labels FROM w LEFT JOIN g ON g.doc_id = w.doc_id
"""


def language_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rows language ID holds out, and which it can't say."""
    return queries.op5_language_id(spark, sf_dir).select("doc_id", "held_out", (F.col("lang_pred") == "und").alias("undetermined"))


LANGUAGE_FOLDS = f"SELECT doc_id, {CRC32.format('doc_id')} % 4 = 2 AS held_out, NOT regexp_matches(coalesce(text, ''), '\\p{{L}}') AS undetermined FROM documents"


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and the base verdict of the quality rules."""
    return queries.op6_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUALITY_BASE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
windows AS (SELECT doc_id, k, array_to_string(w[k:k + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS k FROM d)),
twice AS (SELECT doc_id, g FROM windows GROUP BY doc_id, g HAVING count(*) > 1),
inside AS (SELECT x.doc_id, count(DISTINCT x.k + s.o) AS n FROM windows x JOIN twice t ON t.doc_id = x.doc_id AND t.g = x.g, (SELECT unnest([0, 1, 2]) AS o) s GROUP BY x.doc_id),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
  coalesce(inside.n, 0)::BIGINT AS n_repeat_words, len(w) < 50 OR 100 * coalesce(inside.n, 0) > 50 * len(w) AS base_failed
FROM d LEFT JOIN dup ON dup.doc_id = d.doc_id LEFT JOIN inside ON inside.doc_id = d.doc_id
"""


def token_byte_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of each text, and whether it has tokens."""
    return queries.op8_token_counts(spark, sf_dir).select("doc_id", "n_bytes", (F.col("n_tokens") > 0).alias("has_tokens"))


TOKEN_BYTES = "SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes, length(coalesce(text, '')) > 0 AS has_tokens FROM documents"


def packing_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document, whether its pieces hold each of its ids once; and sequences that are too long or have gaps, as a row without id where there are any."""
    pieces = queries.op9_harmonic_packing(spark, sf_dir)
    whole = pieces.groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n"), F.min("start").alias("first"), F.max(F.col("start") + F.col("length")).alias("last"))
    docs = whole.select("doc_id", ((F.col("n") == F.col("doc_tokens")) & (F.col("first") == 0) & (F.col("last") == F.col("doc_tokens"))).alias("whole"))
    bins = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("last"), F.min("offset").alias("first"))
    bad = bins.where("n > 2048 OR last <> n OR first <> 0").select(F.lit(None).cast("long").alias("doc_id"), F.lit(False).alias("whole"))
    return docs.unionByName(bad)


PACKING = "SELECT doc_id, true AS whole FROM documents"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (lm_base_counts, license_base_counts, language_folds, quality_base_counts, token_byte_counts, packing_invariants)}
ORACLES = {
    "op1_ngram_jaccard_join": NGRAM_JOIN,
    "op4_embedding_dedup": EMBEDDINGS,
    "op7_warc_roundtrip": WARC,
    "op10_source_mixing": mixing.SQL,
    "lm_base_counts": LM_BASE,
    "license_base_counts": LICENSE_BASE,
    "language_folds": LANGUAGE_FOLDS,
    "quality_base_counts": QUALITY_BASE,
    "token_byte_counts": TOKEN_BYTES,
    "packing_invariants": PACKING,
}
