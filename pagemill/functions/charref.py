"""Character references: the fixed tables, and the decoder that the kernel and the SQL function share."""

from __future__ import annotations

import re

# The named references known here. Only amp, lt, gt and quot work without the semicolon.
NAMED = {
    "amp;": "&",
    "amp": "&",
    "lt;": "<",
    "lt": "<",
    "gt;": ">",
    "gt": ">",
    "quot;": '"',
    "quot": '"',
    "apos;": "'",
    "nbsp;": "\u00a0",
    "copy;": "©",
    "reg;": "®",
    "trade;": "™",
    "mdash;": "—",
    "ndash;": "–",
    "hellip;": "…",
    "euro;": "€",
    "times;": "×",
    "divide;": "÷",
    "plusmn;": "±",
    "deg;": "°",
    "sect;": "§",
    "para;": "¶",
    "micro;": "µ",
    "laquo;": "«",
    "raquo;": "»",
}
# What numeric references to 0x80-0x9F stand for.
WINDOWS_1252 = {
    0x80: 0x20AC,
    0x82: 0x201A,
    0x83: 0x0192,
    0x84: 0x201E,
    0x85: 0x2026,
    0x86: 0x2020,
    0x87: 0x2021,
    0x88: 0x02C6,
    0x89: 0x2030,
    0x8A: 0x0160,
    0x8B: 0x2039,
    0x8C: 0x0152,
    0x8E: 0x017D,
    0x91: 0x2018,
    0x92: 0x2019,
    0x93: 0x201C,
    0x94: 0x201D,
    0x95: 0x2022,
    0x96: 0x2013,
    0x97: 0x2014,
    0x98: 0x02DC,
    0x99: 0x2122,
    0x9A: 0x0161,
    0x9B: 0x203A,
    0x9C: 0x0153,
    0x9E: 0x017E,
    0x9F: 0x0178,
}

#: One match from just after the ampersand: hex digits, decimal digits, or the longest known name.
_REFERENCE = re.compile(r"#(?:[xX](?P<hex>[0-9a-fA-F]*)|(?P<dec>[0-9]*))(?P<end>;?)|(?P<name>" + "|".join(sorted(NAMED, key=len, reverse=True)) + ")")
_ALNUM_OR_EQUALS = re.compile("[a-zA-Z0-9=]")


def code_point(n: int) -> tuple[int, str | None]:
    """What a numeric reference to n stands for, and the error it is."""
    if n == 0:
        return 0xFFFD, "null-character-reference"
    if n > 0x10FFFF:
        return 0xFFFD, "character-reference-outside-unicode-range"
    if 0xD800 <= n <= 0xDFFF:
        return 0xFFFD, "surrogate-character-reference"
    if n in WINDOWS_1252:
        return WINDOWS_1252[n], "control-character-reference"
    return n, None


def number(digits: str, base: int) -> int:
    """int(), but digits beyond any code point aren't converted (they may be very many)."""
    digits = digits.lstrip("0")
    return int(digits or "0", base) if len(digits) <= 8 else 0x110000


def decode_at(text: str, pos: int, in_attribute: bool) -> tuple[str | None, int, list[str]]:
    """(decoded text, position after it, errors) of the reference whose ampersand is just before pos; (None, pos, ...) where there is none."""
    m = _REFERENCE.match(text, pos)
    if not m:
        return None, pos, []
    if name := m["name"]:
        if name[-1] == ";":
            return NAMED[name], m.end(), []
        if in_attribute and _ALNUM_OR_EQUALS.match(text, m.end()):
            return None, pos, []
        return NAMED[name], m.end(), ["missing-semicolon-after-character-reference"]
    digits = m["hex"] if m["hex"] is not None else m["dec"]
    if not digits:
        return None, pos, ["absence-of-digits-in-numeric-character-reference"]
    n, error = code_point(number(digits, 16 if m["hex"] is not None else 10))
    return chr(n), m.end(), [*([] if m["end"] else ["missing-semicolon-after-character-reference"]), *([error] if error else [])]


def decode_all(text: str, in_attribute: bool = False) -> str:
    """The text with its references decoded."""
    parts = text.split("&")
    if len(parts) == 1:
        return text
    out, pos = [], 0
    while (at := text.find("&", pos)) >= 0:
        decoded, end, _ = decode_at(text, at + 1, in_attribute)
        out += [text[pos:at], "&" if decoded is None else decoded]
        pos = end
    return "".join([*out, text[pos:]])
