"""Structural sanitizing and re-parsing in other contexts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import escape_attribute, escape_text
from .lex import lexed, once
from .states import VOID

#: White space of the patterns in a policy, spelt out: it is wider than Java's \s.
JS_SPACE = "\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"


@dataclass(frozen=True)
class Policy:
    """Elements that go with all they hold, and attributes that go: by name, or by the value of URL attributes."""

    dropped: tuple[str, ...] = ("script",)
    attribute: str = "(?i)^on"
    url_attributes: tuple[str, ...] = ("href", "src")
    scheme: str = f"(?i)^[{JS_SPACE}]*javascript:"


def safe_attributes(attrs: Column, policy: Policy = Policy()) -> Column:
    def safe(a: Column) -> Column:
        url = F.lower(a["name"]).isin(*policy.url_attributes) & a["value"].rlike(policy.scheme)
        return ~a["name"].rlike(policy.attribute) & ~url

    return F.filter(attrs, safe)


def kept_nodes(nodes: Column, policy: Policy = Policy()) -> Column:
    """A document's nodes (an array in order of pre) outside all dropped elements, with their safe attributes.

    A node is inside a dropped element if the largest post of those opened so far lies beyond
    its own; a nested element's post is smaller than its holder's, so dropped ranges are told
    by their outermost elements alone.
    """
    gone = F.filter(nodes, lambda n: (n["kind"] == "element") & n["tag"].isin(*policy.dropped))
    outside = F.filter(nodes, lambda n: ~F.exists(gone, lambda g: (g["pre"] <= n["pre"]) & (n["post"] <= g["post"])))
    return F.transform(outside, lambda n: n.withField("attrs", safe_attributes(n["attrs"], policy)))


def html_of(nodes: Column) -> Column:
    """A document's nodes as html: opening pieces in order of pre and closing ones in order of post, which share a counter."""

    def start(n: Column) -> Column:
        attrs = F.array_join(F.transform(n["attrs"], lambda a: F.concat(F.lit(" "), a["name"], F.lit('="'), escape_attribute(a["value"]), F.lit('"'))), "")
        return F.when(n["kind"] == "element", F.concat(F.lit("<"), n["tag"], attrs, F.lit(">"))).when(n["kind"] == "text", escape_text(n["data"])).when(n["kind"] == "comment", F.concat(F.lit("<!--"), n["data"], F.lit("-->"))).otherwise("")

    closed = F.filter(nodes, lambda n: (n["kind"] == "element") & ~n["tag"].isin(*sorted(VOID)))
    opening = F.transform(nodes, lambda n: F.struct(n["pre"].alias("at"), start(n).alias("s")))
    closing = F.transform(closed, lambda n: F.struct(n["post"].alias("at"), F.concat(F.lit("</"), n["tag"], F.lit(">")).alias("s")))
    return F.array_join(F.transform(F.array_sort(F.concat(opening, closing)), lambda p: p["s"]), "")


def sanitize(docs: DataFrame, policy: Policy = Policy(), **options) -> DataFrame:
    """doc_id, html without the elements and attributes that the policy drops: one parse and array functions, no shuffle."""
    kept = lexed(docs, want=("nodes",), **options).select("doc_id", kept_nodes(F.col("x.nodes"), policy).alias("nodes"))
    return once(kept.select("doc_id", "nodes"), html_of(F.col("nodes")), "html").select("doc_id", "html")


def contexts_frame(spark: SparkSession, *tags: str) -> DataFrame:
    return spark.createDataFrame([(t,) for t in tags], "context string")


def parse_in_contexts(docs: DataFrame, contexts: tuple[str, ...]) -> DataFrame:
    """doc_id, context, nodes: each document as a fragment of each element. The contexts are a literal list, exploded in place."""
    each = docs.where("html IS NOT NULL").select("doc_id", "html", F.explode(F.array(*[F.lit(c) for c in contexts])).alias("context"))
    keyed = each.select(F.struct("doc_id", "context").alias("doc_id"), "html", "context")
    return lexed(keyed, want=("nodes",), context=F.col("context")).select("doc_id.doc_id", "doc_id.context", F.col("x.nodes").alias("nodes"))


def mutation_check(docs: DataFrame, safe: str = "textarea", live: str = "div") -> DataFrame:
    """doc_id, inert, captured, live_elements, mutates: whether text that is inert in one context holds elements once put into another.

    The text captured from the first parse is parsed again, so what a decoded reference
    brings to life is found too. Two narrow kernel calls, no join.
    """

    def elements(nodes: Column) -> Column:
        return F.size(F.filter(nodes, lambda n: n["kind"] == "element"))

    first = parse_in_contexts(docs, (safe,))
    text = F.array_join(F.transform(F.filter("nodes", lambda n: n["kind"] == "text"), lambda n: n["data"]), "")
    held = once(first.select("doc_id", (elements(F.col("nodes")) == 0).alias("inert"), "nodes"), text, "captured").drop("nodes")
    keyed = held.select(F.struct("doc_id", "inert", "captured").alias("doc_id"), F.col("captured").alias("html"), F.lit(live).alias("context"))
    again = lexed(keyed, want=("nodes",), context=F.col("context")).select("doc_id.*", elements(F.col("x.nodes")).alias("live_elements"))
    return again.withColumn("mutates", F.col("inert") & (F.col("live_elements") > 0))
