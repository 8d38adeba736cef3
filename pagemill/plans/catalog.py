"""The registered queries of the HTML operators, and SQL for the same rows where SQL can say it.

The SQL knows the pages' structure and nothing of the kernel: it blanks script and style
bodies and then works with regular expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import escape_attribute, escape_html, map_code_point, named_reference, naive_strip_script, preprocess, visible
from ..operators import relational
from ..operators.lex import build_tree, decode_references, doctypes, lex_column, lexed, parse_errors, tokenize, trace_runs
from ..operators.native import native_differential
from ..operators.sanitize import mutation_check, parse_in_contexts, sanitize
from ..operators.states import VOID
from ..sources.documents import pages
from . import fixtures

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def registered(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


#: The pages without the text inside script and style; then the text outside tags, references decoded (& last).
BLANKED = "WITH b AS (SELECT page_id, html, regexp_replace(regexp_replace(html, '<script>.*?</script>', '<script></script>', 'gs'), '<style>.*?</style>', '<style></style>', 'gs') AS h FROM pages)"
DECODED = "replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&copy;', chr(169)), '&amp;', '&')"
TEXT = DECODED.format("regexp_replace(h, '<[^>]*>', '', 'g')")
RAW = "length(regexp_extract(html, '<script>(.*?)</script>', 1, 's')) + length(regexp_extract(html, '<style>(.*?)</style>', 1, 's'))"


@registered("SELECT page_id, length(replace(replace(html, concat(chr(13), chr(10)), chr(10)), chr(13), chr(10)))::BIGINT AS n FROM pages")
def preprocess_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select(F.col("doc_id").alias("page_id"), F.length(preprocess(F.col("html"))).cast("long").alias("n"))


@registered(
    BLANKED
    + f""", c AS (SELECT page_id,
      len(regexp_extract_all(h, '<[a-z][^>]*>'))::BIGINT AS "StartTag", len(regexp_extract_all(h, '</[a-z][^>]*>'))::BIGINT AS "EndTag",
      len(regexp_extract_all(h, '<!--.*?-->'))::BIGINT AS "Comment", len(regexp_extract_all(h, '<!DOCTYPE'))::BIGINT AS "DOCTYPE", 1::BIGINT AS "EOF",
      (length({TEXT}) + {RAW})::BIGINT AS "Character" FROM b)
    SELECT page_id, kind, n FROM c UNPIVOT (n FOR kind IN ("StartTag", "EndTag", "Comment", "DOCTYPE", "EOF", "Character")) WHERE n > 0"""
)
def token_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each kind on each page, characters one by one, as a tree builder would have them tokenized."""
    n = F.sum(F.coalesce(F.col("n_chars"), F.lit(1)).cast("long")).alias("n")
    return tokenize(pages(spark, sf_dir), driven=True).groupBy(F.col("doc_id").alias("page_id"), "kind").agg(n)


@registered(BLANKED + " SELECT tag, count(*)::BIGINT AS n FROM (SELECT unnest(regexp_extract_all(h, '<([a-z][a-z0-9]*)', 1)) AS tag FROM b) GROUP BY tag")
def start_tag_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(pages(spark, sf_dir), driven=True, kinds=["StartTag"]).groupBy("tag").agg(F.count("*").alias("n"))


@registered("SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM pages")
def href_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    attrs = tokenize(pages(spark, sf_dir), driven=True, kinds=["StartTag"]).where("tag = 'a'").select(F.col("doc_id").alias("page_id"), F.inline("attrs"))
    return attrs.where("name = 'href'").select("page_id", F.col("value").alias("href"))


@registered(BLANKED + " SELECT name, count(*)::BIGINT AS n FROM (SELECT unnest(regexp_extract_all(t, ' ([a-z]+)=', 1)) AS name FROM (SELECT unnest(regexp_extract_all(h, '<[a-z][^>]*>')) AS t FROM b)) GROUP BY name")
def attribute_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(pages(spark, sf_dir), driven=True, kinds=["StartTag"]).select(F.inline("attrs")).groupBy("name").agg(F.count("*").alias("n"))


@registered("SELECT page_id, unnest(regexp_extract_all(html, '<!--(.*?)-->', 1, 's')) AS data FROM pages")
def comment_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(pages(spark, sf_dir), driven=True, kinds=["Comment"]).select(F.col("doc_id").alias("page_id"), "data")


@registered("SELECT page_id, lower(regexp_extract(html, '<!DOCTYPE ([a-zA-Z]+)', 1)) AS name, NULL::VARCHAR AS public_id, NULL::VARCHAR AS system_id, false AS force_quirks FROM pages")
def doctype_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doctypes(pages(spark, sf_dir)).withColumnRenamed("doc_id", "page_id")


@registered("SELECT page_id, " + DECODED.format("regexp_extract(html, '<title>(.*?)</title>', 1, 's')") + " AS title FROM pages")
def title_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = relational.text_of(F.col("x.nodes"), lambda n: n["tag"] == "title")
    return lexed(pages(spark, sf_dir), want=("nodes",)).select(F.col("doc_id").alias("page_id"), title.alias("title")).where("title IS NOT NULL")


@registered(BLANKED + f" SELECT page_id, md5({TEXT}) AS digest FROM b")
def visible_text_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of each page outside script and style."""
    text = relational.text_of(F.col("x.nodes"), lambda n: n["tag"].isin("script", "style"), inside=False)
    return lexed(pages(spark, sf_dir), want=("nodes",)).select(F.col("doc_id").alias("page_id"), text.alias("text")).where("text IS NOT NULL").select("page_id", F.md5("text").alias("digest"))


@registered(
    BLANKED
    + """, s AS (SELECT page_id, unnest(regexp_extract_all(h, '<([a-z][a-z0-9]*)', 1)) AS tag, 1 AS d FROM b
      UNION ALL SELECT page_id, unnest(regexp_extract_all(h, '</([a-z][a-z0-9]*)', 1)) AS tag, -1 AS d FROM b)
    SELECT page_id, tag, sum(d)::BIGINT AS n FROM s WHERE tag NOT IN ('br', 'meta') GROUP BY page_id, tag HAVING sum(d) > 0"""
)
def unclosed_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = tokenize(pages(spark, sf_dir), driven=True, kinds=["StartTag", "EndTag"]).where(~F.col("tag").isin(*sorted(VOID)))
    n = F.sum(F.when(F.col("kind") == "StartTag", 1).otherwise(-1)).cast("long").alias("n")
    return tags.groupBy(F.col("doc_id").alias("page_id"), "tag").agg(n).where("n > 0")


@registered("SELECT page_id, regexp_replace(html, '<script\\b[^>]*>.*?</script\\s*>', '', 'gis') AS html FROM pages")
def naive_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select(F.col("doc_id").alias("page_id"), naive_strip_script(F.col("html")).alias("html"))


@registered(BLANKED + " SELECT page_id, len(regexp_extract_all(h, '<[a-z][^>]*>'))::BIGINT AS elements, len(regexp_extract_all(h, '<!--.*?-->'))::BIGINT AS comments FROM b")
def tree_node_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = lambda k: F.count_if(F.col("kind") == k)
    return build_tree(pages(spark, sf_dir)).groupBy(F.col("doc_id").alias("page_id")).agg(kinds("element").alias("elements"), kinds("comment").alias("comments"))


@registered()
def tree_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_tree(pages(spark, sf_dir)).groupBy(F.col("doc_id").alias("page_id")).agg(F.max("depth").alias("depth"), F.count("*").alias("nodes"))


@registered("SELECT page_id, 'title' AS tag FROM pages")
def path_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second child of the first child of each page's first node."""
    return lexed(pages(spark, sf_dir), want=("nodes",)).select(F.col("doc_id").alias("page_id"), relational.node_at(F.col("x.nodes"), 0, 0, 1)["tag"].alias("tag")).where("tag IS NOT NULL")


@registered("SELECT page_id, regexp_extract(html, '<a href=\"([^\"]*)\"', 1) AS href FROM pages WHERE html LIKE '%<a href=%'")
def first_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = relational.first_of(tokenize(pages(spark, sf_dir), driven=True, kinds=["StartTag"]), "tag = 'a'")
    return first.select(F.col("doc_id").alias("page_id"), F.filter("attrs", lambda a: a["name"] == "href")[0]["value"].alias("href"))


def damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages, every second one with &amp for &amp; so that there are errors to find."""
    return pages(spark, sf_dir).withColumn("html", F.when(F.col("doc_id") % 2 == 0, F.replace("html", F.lit("&amp;"), F.lit("&amp "))).otherwise(F.col("html")))


#: How many references without a semicolon each damaged page has outside scripts, styles and comments.
LOST = BLANKED + ", e AS (SELECT page_id, len(regexp_extract_all(regexp_replace(h, '<!--.*?-->', '', 'gs'), '&amp;'))::BIGINT AS n FROM b WHERE page_id % 2 = 0)"


@registered(LOST + " SELECT page_id FROM e WHERE n > 0")
def missing_semicolon_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = damaged(spark, sf_dir)
    found = relational.with_error(docs, parse_errors(docs, driven=True), "missing-semicolon-after-character-reference")
    return found.select(F.col("doc_id").alias("page_id"))


@registered(LOST + " SELECT 'missing-semicolon-after-character-reference' AS code, sum(n)::BIGINT AS n FROM e HAVING sum(n) > 0")
def parse_error_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of damaged pages by code."""
    return parse_errors(damaged(spark, sf_dir), driven=True).groupBy("code").agg(F.count("*").alias("n"))


@registered(LOST + " SELECT page_id, unnest(range(0, least(n, 100)))::INTEGER AS err_ord, 'missing-semicolon-after-character-reference' AS code FROM e")
def first_parse_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred errors of each damaged page."""
    return relational.first_errors(parse_errors(damaged(spark, sf_dir), driven=True)).select(F.col("doc_id").alias("page_id"), "err_ord", "code")


@registered()
def state_trace_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace_runs(pages(spark, sf_dir)).withColumnRenamed("doc_id", "page_id")


@registered()
def token_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.coalesce_runs(tokenize(pages(spark, sf_dir)), order="tok", value="kind").withColumnRenamed("doc_id", "page_id")


@registered(
    BLANKED
    + """, t AS (SELECT page_id, list_append(regexp_extract_all(h, '<!--.*?-->|<!DOCTYPE[^>]*>|</?[a-z][^>]*>', 0, 's'), 'EOF') AS t FROM b),
    u AS (SELECT page_id, unnest(range(1, len(t) + 1)) AS place, unnest(t) AS t FROM t)
    SELECT page_id, place::INTEGER AS place, CASE WHEN t = 'EOF' OR t LIKE '<!--%' THEN t WHEN t LIKE '<!%' THEN 'DOCTYPE' WHEN t LIKE '</%' THEN regexp_extract(t, '</[a-z0-9]+') || '>'
      ELSE regexp_extract(t, '<[a-z0-9]+') || CASE WHEN t LIKE '%/>' THEN '/>' ELSE '>' END END AS label FROM u"""
)
def token_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels of each page's tokens in order, without characters."""
    others = F.filter("x.tokens", lambda t: t["kind"] != "Character")
    numbered = lexed(pages(spark, sf_dir), driven=True).select("doc_id", F.posexplode(others).alias("place", "t"))
    shapes = relational.shape(numbered.select("doc_id", F.col("t").withField("tok", F.col("place") + 1).alias("t")).select("doc_id", "t.*"))
    return shapes.select(F.col("doc_id").alias("page_id"), F.col("tok").alias("place"), "label")


@registered()
def pretty_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.pretty(tokenize(pages(spark, sf_dir), driven=True)).withColumnRenamed("doc_id", "page_id")


@registered("SELECT page_id, 0::BIGINT AS scripts, 0::BIGINT AS handlers FROM pages")
def sanitize_no_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of scripts and handlers once sanitized pages are parsed again."""
    tags = tokenize(sanitize(pages(spark, sf_dir)), driven=True, kinds=["StartTag", "EOF"])
    handlers = F.size(F.filter("attrs", lambda a: a["name"].startswith("on")))
    return tags.groupBy(F.col("doc_id").alias("page_id")).agg(F.count_if(F.col("tag") == "script").alias("scripts"), F.sum(F.coalesce(F.when(F.col("kind") == "StartTag", handlers), F.lit(0))).cast("long").alias("handlers"))


@registered()
def sanitized_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitize(pages(spark, sf_dir)).withColumnRenamed("doc_id", "page_id")


@registered("SELECT page_id, true AS inert, true AS mutates FROM pages")
def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages stored as a textarea's text and put into a div later."""
    return mutation_check(pages(spark, sf_dir)).select(F.col("doc_id").alias("page_id"), "inert", "mutates")


@registered()
def fragments_in_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = parse_in_contexts(pages(spark, sf_dir), ("div", "textarea", "style", "script", "plaintext"))
    return found.select(F.col("doc_id").alias("page_id"), "context", F.size("nodes").alias("nodes"))


@registered("SELECT page_id FROM pages")
def pure_differs_from_driven(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose tokens depend on who drives the tokenizer: each has markup inside a script."""
    docs = pages(spark, sf_dir)
    flat = lambda driven: F.transform(lex_column(preprocess(F.col("html")), driven=driven)["tokens"], lambda t: F.struct(t["tok"], t["kind"], t["tag"], t["data"]))
    return docs.where(flat(False) != flat(True)).select(F.col("doc_id").alias("page_id"))


@registered("SELECT page_id, true AS regular, true AS agrees FROM pages")
def native_lexer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that native patterns can tokenize, and whether the kernel gives the same tokens."""
    return native_differential(pages(spark, sf_dir)).withColumnRenamed("doc_id", "page_id")


@registered("SELECT url, replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS escaped, replace(replace(url, '&', '&amp;'), '\"', '&quot;') AS attribute, replace(url, chr(10), '\\n') AS shown FROM pages")
def escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return pages(spark, sf_dir).select("url", escape_html(u).alias("escaped"), escape_attribute(u).alias("attribute"), visible(u).alias("shown"))


@registered("SELECT page_id, " + DECODED.format("regexp_extract(html, '<h1>(.*?)</h1>', 1, 's')") + " AS heading FROM pages")
def decoded_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References decoded in a plain column, without a parse."""
    return pages(spark, sf_dir).select(F.col("doc_id").alias("page_id"), decode_references(F.regexp_extract("html", "(?s)<h1>(.*?)</h1>", 1)).alias("heading"))


@registered("SELECT i::BIGINT AS n, CASE WHEN i = 0 OR i > 1114111 OR i BETWEEN 55296 AND 57343 THEN 65533 WHEN i = 128 THEN 8364 WHEN i = 150 THEN 8211 WHEN i = 159 THEN 376 ELSE i END::INTEGER AS mapped, CASE WHEN i = 0 THEN 'x' END AS name FROM (SELECT unnest([0, 65, 127, 128, 129, 150, 159, 160, 55296, 57343, 57344, 1114111, 1114112]) AS i)")
def mapped_code_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric and named references by native expressions."""
    n = spark.sql("SELECT explode(array(0L, 65L, 127L, 128L, 129L, 150L, 159L, 160L, 55296L, 57343L, 57344L, 1114111L, 1114112L)) AS n")
    return n.select("n", map_code_point(F.col("n")).alias("mapped"), F.when(named_reference(F.concat(F.lit("amp;"), F.col("n").cast("string"))) == "&", F.when(F.col("n") == 0, "x")).alias("name"))


for _name, (_query, _sql) in fixtures.QUERIES.items():
    QUERIES[_name], ORACLES[_name] = _query, _sql
