"""Tokens of regular pages by native expressions alone, and a differential against the kernel.

A page is regular if simple patterns cover all of it: lower-case tags with double-quoted or bare
attributes, closed comments, plain doctypes, script and style bodies, named references. What is
regular needs no machine; the kernel stays the measure, and every other page goes there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.charref import NAMED
from ..functions.text import preprocess
from .lex import lex_column

#: Named references with their semicolon, and those that work without it too, the ampersand last; others stay as they are, here as in the kernel.
REFERENCES = {f"&{k}": v for k, v in NAMED.items() if k.endswith(";") and k[:-1] not in NAMED}
BARE = {f"&{k}": v for k, v in sorted(NAMED.items(), key=lambda kv: kv[0] == "amp") if not k.endswith(";")}
RAW = ("script", "style")
ATTRIBUTE, NAME_AND_VALUE = r' [a-z][a-z0-9-]*(?:="[^"\x00]*")?', r' ([a-z][a-z0-9-]*)(?:="([^"\x00]*)")?'
#: Repeats are bounded or of single characters, which Java's matcher takes without recursion.
PIECES = "|".join(
    [
        *[rf"(?<=<{t}>)(?!</{t}>)[\s\S]+?(?=</{t}>)" for t in RAW],
        r"<!--(?!-?>)[^\x00]*?-->",
        r"<!DOCTYPE [a-zA-Z]+>",
        rf"<[a-z][a-z0-9]*(?:{ATTRIBUTE}){{0,200}} ?/?>",
        r"</[a-z][a-z0-9]*>",
        r"[^<\x00]+",
    ]
)
START = rf"^<([a-z][a-z0-9]*)((?:{ATTRIBUTE}){{0,200}})"
#: Elements whose text the patterns don't follow, numeric references, a tag with the same attribute twice.
ODD = "|".join(
    [
        r"<(?:xmp|iframe|noembed|noframes|noscript|plaintext)[ >/]|<(?:title|textarea|script|style)[ /]",
        r"<(title|textarea)>(?![^<]*</\1>)|<(script|style)>(?!</\2>)",
        r"&#",
        r"<[a-z][^>]* ([a-z0-9-]+)(?:=\"[^\"]*\")?(?: [^>]*)? \3[ =/>]",
    ]
)


def decoded(text: Column, in_attribute: bool = False) -> Column:
    """References as characters; in a value, a name without its semicolon is none before a letter, a digit or =."""
    for name, char in REFERENCES.items():
        text = F.replace(text, F.lit(name), F.lit(char))
    for name, char in BARE.items():
        text = F.regexp_replace(text, f"{name};|{name}(?![a-zA-Z0-9=])" if in_attribute else f"{name};?", char)
    return text


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once: a lambda's variable, where the expression itself would be worked out anew for each element of the lambdas in f."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def pieces(html: Column) -> Column:
    """The tags, comments, doctypes and texts of preprocessed html in order; null if the page isn't regular."""
    return let(F.regexp_extract_all(html, F.lit(PIECES), F.lit(0)), lambda found: _covering(html, found))


def _covering(html: Column, found: Column) -> Column:
    outside = F.regexp_replace(F.regexp_replace(html, r"(?s)<(script|style)>.*?</\1>", "<$1></$1>"), r"(?s)<!--.*?-->", "")
    odd_comment = F.exists(found, lambda p: p.startswith("<!--") & F.substring(p, F.lit(5), F.length(p) - 7).rlike("--|<!|-$"))
    return F.when((F.array_join(found, "") == html) & ~outside.rlike(ODD) & ~odd_comment, found)


def native_tokens(html: Column) -> Column:
    """array<struct<kind, tag, self_closing, attrs, data>> of a regular page as a tree builder would have it tokenized, adjacent characters as one token; else null."""

    def token(p: Column, before: Column) -> Column:
        names = F.regexp_extract_all(F.regexp_extract(p, START, 2), F.lit(NAME_AND_VALUE), F.lit(1))
        values = F.regexp_extract_all(F.regexp_extract(p, START, 2), F.lit(NAME_AND_VALUE), F.lit(2))
        attrs = F.zip_with(names, values, lambda n, v: F.struct(n.alias("name"), F.coalesce(decoded(v, True), F.lit("")).alias("value")))
        raw = before.isin(*[f"<{t}>" for t in RAW])
        none = F.lit(None).cast("array<struct<name:string,value:string>>")
        start, end = p.rlike("^<[a-z]") & ~raw, p.rlike("^</[a-z]") & ~raw
        comment, doctype = p.startswith("<!--") & ~raw, p.startswith("<!D") & ~raw
        kind = F.when(start, "StartTag").when(end, "EndTag").when(comment, "Comment").when(doctype, "DOCTYPE").otherwise("Character")
        tag = F.when(start, F.regexp_extract(p, START, 1)).when(end, F.regexp_extract(p, "^</([a-z0-9]+)", 1)).when(doctype, F.lower(F.regexp_extract(p, " ([a-zA-Z]+)", 1)))
        data = F.when(comment, F.substring(p, F.lit(5), F.length(p) - 7)).when(~(start | end | doctype), F.when(raw, p).otherwise(decoded(p)))
        return F.struct(kind.alias("kind"), tag.alias("tag"), (start & p.endswith("/>")).alias("self_closing"), F.when(start, attrs).otherwise(none).alias("attrs"), data.alias("data"))

    return let(pieces(html), lambda found: F.transform(found, lambda p, i: token(p, F.coalesce(F.get(found, i - 1), F.lit("")))))


def stream(tokens: Column, doctype: str = "tag") -> Column:
    """Tokens as one text, the same for two lists if they are equal up to how characters are cut; doctype: the field with a doctype's name."""

    def shown(t: Column) -> Column:
        attrs = F.array_join(F.transform(t["attrs"], lambda a: F.concat(F.lit("\x02"), a["name"], F.lit("\x03"), a["value"])), "")
        rest = F.when(t["kind"] == "StartTag", F.concat(t["self_closing"].cast("string"), attrs)).otherwise(F.coalesce(t["data"], F.lit("")))
        named = F.coalesce(t["tag"], t[doctype], F.lit(""))
        return F.when(t["kind"] == "Character", t["data"]).otherwise(F.concat(F.lit("\x01"), t["kind"], F.lit("\x02"), named, rest, F.lit("\x04")))

    return F.array_join(F.transform(F.filter(tokens, lambda t: t["kind"] != "EOF"), shown), "")


def native_differential(docs: DataFrame) -> DataFrame:
    """doc_id, regular, agrees: whether the patterns cover a page, and whether their tokens are the kernel's (null where they don't)."""
    html = preprocess(F.col("html"))
    both = docs.where("html IS NOT NULL").select("doc_id", native_tokens(html).alias("native"), lex_column(html, driven=True)["tokens"].alias("exact"))
    return both.select("doc_id", F.col("native").isNotNull().alias("regular"), F.when(F.col("native").isNotNull(), stream(F.col("native")) == stream(F.col("exact"), "dt_name")).alias("agrees"))
