"""Native column functions: newline normalisation, escapes, visible characters, character references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .charref import NAMED, WINDOWS_1252

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else (lower() folds all of Unicode)."""
    return F.translate(c, UPPER, UPPER.lower())


def preprocess(c: Column) -> Column:
    """CRLF and CR become LF, in one pass."""
    return F.regexp_replace(c, "\r\n?", "\n")


def _replaced(c: Column, *pairs: tuple[str, str]) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)


def escape_text(c: Column) -> Column:
    """For element content; > stays."""
    return _replaced(c, ("&", "&amp;"), ("<", "&lt;"))


def escape_attribute(c: Column) -> Column:
    return _replaced(c, ("&", "&amp;"), ('"', "&quot;"))


def escape_html(c: Column) -> Column:
    """For display: & < > and the double quote."""
    return _replaced(c, ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))


def visible(c: Column) -> Column:
    """Control characters by name, for display."""
    return _replaced(c, ("\n", "\\n"), ("\t", "\\t"), ("\f", "\\f"), ("\0", "\\0"))


def naive_strip_script(c: Column) -> Column:
    """The regex baseline that a structural sanitizer is compared with."""
    return F.regexp_replace(c, r"(?is)<script\b[^>]*>.*?</script\s*>", "")


def map_code_point(n: Column) -> Column:
    """The code point that a numeric reference to n stands for (n: long)."""
    table = F.create_map(*[F.lit(x) for k, v in WINDOWS_1252.items() for x in (k, v)])
    bad = (n == 0) | (n > 0x10FFFF) | ((n >= 0xD800) & (n <= 0xDFFF))
    return F.when(bad, F.lit(0xFFFD)).otherwise(F.coalesce(F.try_element_at(table, n.cast("int")), n.cast("int")))


def named_reference(c: Column) -> Column:
    """The text of the longest known name that c starts with, else null."""
    names = sorted(NAMED, key=len, reverse=True)
    table = F.create_map(*[F.lit(x) for k, v in NAMED.items() for x in (k, v)])
    found = F.regexp_extract(c, "^(?:" + "|".join(names) + ")", 0)
    return F.try_element_at(table, found)
