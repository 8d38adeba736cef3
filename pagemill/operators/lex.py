"""Tokens, parse errors, state traces and element trees of a column of HTML.

The kernel runs as one scalar Arrow UDF, so Catalyst still prunes columns and pushes filters
on other columns into the scan; what the UDF makes is chosen by `want`, and is built column by
column. Everything after it is a narrow generate: no operator here shuffles.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType, _parse_datatype_string

from ..functions.text import preprocess
from .kernel import lex
from .states import TITLES

ATTRS = "array<struct<name:string,value:string>>"
TOKEN = f"tok int, kind string, emit_state string, tag string, self_closing boolean, attrs {ATTRS}, data string, n_chars int, dt_name string, dt_public string, dt_system string, force_quirks boolean"
ERROR = "err_ord int, state string, code string"
TRACE = "step int, state string, pos int"
RUN = "run int, state string, n long, pos int"
NODE = f"node int, parent int, depth int, sib int, pre int, post int, kind string, tag string, attrs {ATTRS}, data string"
DOCTYPE = "name string, public_id string, system_id string, force_quirks boolean"
PARTS = {"tokens": TOKEN, "errors": ERROR, "trace": TRACE, "runs": RUN, "nodes": NODE}
TRACE_CAP = 4000


def _typed(ddl: str) -> str:
    return ddl.replace(" ", ":", 1) if "," not in ddl else ", ".join(p.replace(" ", ":", 1) for p in _fields(ddl))


def _fields(ddl: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, c in enumerate(ddl):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(ddl[at:i].strip())
            at = i + 1
    return [*out, ddl[at:].strip()]


def result_type(want: Iterable[str]) -> StructType:
    arrays = [f"{w} array<struct<{_typed(PARTS[w])}>>" for w in PARTS if w in want]
    return _parse_datatype_string(", ".join([*arrays, f"doctype struct<{_typed(DOCTYPE)}>", "end_state string", "last_start_tag string"]))


class _Lists:
    """Lists of structs, one for each document, gathered as columns."""

    def __init__(self, kind: pa.DataType):
        self.kind, self.fields = kind, list(kind.value_type)
        self.columns: list[list] = [[] for _ in self.fields]
        self.starts: list[int] = []
        self.n = 0

    def add(self, *columns: list) -> None:
        """A document's columns, in the order of the struct's fields."""
        self.starts.append(self.n)
        self.n += len(columns[0])
        for held, more in zip(self.columns, columns, strict=True):
            held += more

    def array(self) -> pa.Array:
        columns = [_attributes(c, f.type) if f.name == "attrs" else pa.array(c, f.type) for c, f in zip(self.columns, self.fields, strict=True)]
        structs = pa.StructArray.from_arrays(columns, fields=self.fields)
        return pa.ListArray.from_arrays(pa.array([*self.starts, self.n], pa.int32()), structs, type=self.kind)


def _attributes(lists: list[list | None], kind: pa.DataType) -> pa.Array:
    names, values, starts = [], [], []
    for pairs in lists:
        starts.append(None if pairs is None else len(names))
        for name, value in pairs or ():
            names.append(name)
            values.append(value)
    pairs = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.string())], fields=list(kind.value_type))
    return pa.ListArray.from_arrays(pa.array([*starts, len(names)], pa.int32()), pairs, type=kind)


def lex_column(html: Column, *, want: Iterable[str] = ("tokens",), kinds: Iterable[str] | None = None, driven: bool = False, context: Column | None = None, init_state: Column | None = None, last_start_tag: Column | None = None, cap: int | None = TRACE_CAP, steps: int | None = None) -> Column:
    """The kernel's struct for a column of preprocessed html; null html gives null.

    want: of tokens, errors, trace, runs (of the trace), nodes. kinds: only tokens of these kinds
    (their numbers stay). cap: how many steps a trace has at most; None for all of them.
    """
    want, kinds = frozenset(want), None if kinds is None else frozenset(kinds)
    schema = result_type(want)
    arrow = to_arrow_type(schema)
    driven = driven or "nodes" in want
    steps_kept = (sys.maxsize if cap is None else cap) if want & {"trace", "runs"} else 0
    token_fields, node_fields = ([f.split()[0] for f in _fields(ddl)] for ddl in (TOKEN, NODE))

    @F.arrow_udf(returnType=schema)
    def run(texts: pa.Array, contexts: pa.Array, states: pa.Array, lasts: pa.Array) -> pa.Array:
        parts = {f.name: _Lists(f.type) for f in arrow if f.name in PARTS}
        doctype, ended, last_tags, null = [], [], [], []
        for text, ctx, state, last in zip(texts.to_pylist(), contexts.to_pylist(), states.to_pylist(), lasts.to_pylist(), strict=True):
            null.append(text is None)
            m = lex(text or "", state=state, last_start_tag=last, driven=driven, context=ctx, trace=steps_kept, steps=steps)
            ended.append(TITLES[m.state])
            last_tags.append(m.last)
            doctype.append(m.tree.doctype if m.tree else None)
            if "tokens" in parts:
                kept = [(i, t) for i, t in enumerate(m.tokens) if kinds is None or t["kind"] in kinds]
                tokens = [t for _, t in kept]
                columns = {"tok": [i for i, _ in kept], "emit_state": [TITLES[t["emit_state"]] for t in tokens]}
                parts["tokens"].add(*[columns.get(f) or [t.get(f) for t in tokens] for f in token_fields])
            if "errors" in parts:
                parts["errors"].add(list(range(len(m.errors))), [TITLES[s] for s, _ in m.errors], [c for _, c in m.errors])
            if "trace" in parts:
                parts["trace"].add(list(range(len(m.trace))), [TITLES[s] for s, _ in m.trace], [p for _, p in m.trace])
            if "runs" in parts:
                at = [i for i, (s, _) in enumerate(m.trace) if not i or s != m.trace[i - 1][0]]
                parts["runs"].add(list(range(1, len(at) + 1)), [TITLES[m.trace[i][0]] for i in at], [b - a for a, b in zip(at, [*at[1:], len(m.trace)], strict=True)], [m.trace[i][1] for i in at])
            if "nodes" in parts:
                nodes = m.tree.finish()
                parts["nodes"].add(*[[n[f] for n in nodes] for f in node_fields])
        columns = {**{k: v.array() for k, v in parts.items()}, "doctype": pa.array(doctype, arrow.field("doctype").type), "end_state": pa.array(ended, pa.string()), "last_start_tag": pa.array(last_tags, pa.string())}
        return pa.StructArray.from_arrays([columns[f.name] for f in arrow], fields=list(arrow), mask=pa.array(null, pa.bool_()))

    given = [F.lit(None).cast("string") if c is None else c for c in (context, init_state, last_start_tag)]
    return run(html, *given)


def once(df: DataFrame, value: Column, name: str) -> DataFrame:
    """df with one more column that filters and generators above refer to by name: the optimizer would otherwise put the expression, kernel and all, into each of them."""
    return df.withColumn(name, F.array(value)).select(*df.columns, F.explode_outer(name).alias(name))


def lexed(docs: DataFrame, *, html: str = "html", doc_id: str = "doc_id", **options) -> DataFrame:
    """docs(doc_id, html) -> doc_id, x (the kernel's struct), newlines normalised; rows with null html go."""
    given = docs.where(F.col(html).isNotNull())
    held = given.select(F.col(doc_id).alias("doc_id"), F.array(lex_column(preprocess(F.col(html)), **options)).alias("x"))
    return held.select("doc_id", F.explode_outer("x").alias("x"))


def tokenize(docs: DataFrame, **options) -> DataFrame:
    """A row for each token; runs of character tokens with one emitting state are one row with their count.

    Pure by default: tags never change the state of the text after them. driven=True tokenizes as a tree builder would have it.
    """
    return lexed(docs, want=("tokens",), **options).select("doc_id", F.inline("x.tokens"))


def parse_errors(docs: DataFrame, **options) -> DataFrame:
    return lexed(docs, want=("errors",), **options).select("doc_id", F.inline("x.errors"))


def state_trace(docs: DataFrame, **options) -> DataFrame:
    """A row for each step, the first `cap` of a document; pos counts UTF-16 units."""
    return lexed(docs, want=("trace",), **options).select("doc_id", F.inline("x.trace"))


def trace_runs(docs: DataFrame, *, cap: int | None = None, **options) -> DataFrame:
    """doc_id, run, state, n steps, pos of the first: runs of one state in the trace of the whole document, made where it is lexed."""
    return lexed(docs, want=("runs",), cap=cap, **options).select("doc_id", F.inline("x.runs"))


def build_tree(docs: DataFrame, **options) -> DataFrame:
    """A row for each node: parent, depth, place among siblings, and pre/post numbers from one counter, so that `a` holds `b` if a.pre < b.pre and b.post < a.post."""
    return lexed(docs, want=("nodes",), **options).select("doc_id", F.inline("x.nodes"))


def doctypes(docs: DataFrame, **options) -> DataFrame:
    """doc_id, name, public_id, system_id, force_quirks of the last DOCTYPE; all null without one."""
    return lexed(docs, want=(), driven=True, **options).select("doc_id", "x.doctype.*")


def end_states(docs: DataFrame, **options) -> DataFrame:
    return lexed(docs, want=(), **options).select("doc_id", "x.end_state", "x.last_start_tag")


def explode_chars(tokens: DataFrame) -> DataFrame:
    """One row for each character token again: char_ord within the run, data of one character."""
    runs = tokens.where("kind = 'Character'").select("doc_id", "tok", "emit_state", F.posexplode(F.split("data", "")).alias("char_ord", "data"))
    return runs.where("data <> ''")


def register_sql(spark: SparkSession) -> None:
    """html_tokens(html) as a table function, for SQL; bulk work goes through tokenize()."""
    fields = [f.split()[0] for f in _fields(TOKEN)]

    class HtmlTokens:
        def eval(self, html: str):
            if html is None:
                return
            m = lex(html.replace("\r\n", "\n").replace("\r", "\n"))
            for i, t in enumerate(m.tokens):
                row = {**t, "tok": i, "emit_state": TITLES[t["emit_state"]], "attrs": None if t.get("attrs") is None else [tuple(a) for a in t["attrs"]]}
                yield tuple(row.get(f) for f in fields)

    spark.udtf.register("html_tokens", F.udtf(HtmlTokens, returnType=", ".join(_fields(TOKEN))))


def decode_references(c: Column, in_attribute: bool = False) -> Column:
    """A text with its character references decoded, outside any markup."""
    from ..functions.charref import decode_all

    @F.arrow_udf(returnType="string")
    def decode(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else decode_all(t, in_attribute) for t in texts.to_pylist()], pa.string())

    return decode(c)
