"""The state machine as data: for each state, what a class of characters does and which state follows.

A line is `class: operations > next state`. Classes: ws (tab, LF, FF, space), upper, alpha, nul, eof,
single characters in quotes, and * for all others. `^` before the next state gives the character back;
without a next state the machine stays. Operations:

  emit, emit=XY     character tokens: the current one, or these
  err=CODE          a parse error in this state
  new=KIND          a new current token (start, end, comment, doctype)
  add=F, low=F      the current character (low: A-Z lowered) goes to a field; put=F~XY: this text does
  set=F~XY          a field becomes this text
  attr              a new attribute; named: its name is complete (a duplicate is dropped)
  flush             the current token is emitted
  quirks, closing   flags of the current token
  clear             the temporary buffer is emptied
  halt              an EOF token, and the end

States marked `peek` look without consuming at the end of input; those marked `code` are in the kernel.
"""

from __future__ import annotations

#: Identifier -> title, in the order of the machine.
TITLES = {
    "DATA": "Data",
    "CHARACTER_REFERENCE_IN_DATA": "Character reference in data",
    "RCDATA": "RCDATA",
    "CHARACTER_REFERENCE_IN_RCDATA": "Character reference in RCDATA",
    "RAWTEXT": "RAWTEXT",
    "SCRIPT_DATA": "Script data",
    "PLAINTEXT": "PLAINTEXT",
    "TAG_OPEN": "Tag open",
    "END_TAG_OPEN": "End tag open",
    "TAG_NAME": "Tag name",
    **{f"{k}_{i}": f"{t} {s}" for k, t in (("RCDATA", "RCDATA"), ("RAWTEXT", "RAWTEXT"), ("SCRIPT_DATA", "Script data")) for i, s in (("LESS_THAN_SIGN", "less-than sign"), ("END_TAG_OPEN", "end tag open"), ("END_TAG_NAME", "end tag name"))},
    "SCRIPT_DATA_ESCAPE_START": "Script data escape start",
    "SCRIPT_DATA_ESCAPE_START_DASH": "Script data escape start dash",
    "SCRIPT_DATA_ESCAPED": "Script data escaped",
    "SCRIPT_DATA_ESCAPED_DASH": "Script data escaped dash",
    "SCRIPT_DATA_ESCAPED_DASH_DASH": "Script data escaped dash dash",
    "SCRIPT_DATA_ESCAPED_LESS_THAN_SIGN": "Script data escaped less-than sign",
    "SCRIPT_DATA_ESCAPED_END_TAG_OPEN": "Script data escaped end tag open",
    "SCRIPT_DATA_ESCAPED_END_TAG_NAME": "Script data escaped end tag name",
    "SCRIPT_DATA_DOUBLE_ESCAPE_START": "Script data double escape start",
    "SCRIPT_DATA_DOUBLE_ESCAPED": "Script data double escaped",
    "SCRIPT_DATA_DOUBLE_ESCAPED_DASH": "Script data double escaped dash",
    "SCRIPT_DATA_DOUBLE_ESCAPED_DASH_DASH": "Script data double escaped dash dash",
    "SCRIPT_DATA_DOUBLE_ESCAPED_LESS_THAN_SIGN": "Script data double escaped less-than sign",
    "SCRIPT_DATA_DOUBLE_ESCAPE_END": "Script data double escape end",
    "BEFORE_ATTRIBUTE_NAME": "Before attribute name",
    "ATTRIBUTE_NAME": "Attribute name",
    "AFTER_ATTRIBUTE_NAME": "After attribute name",
    "BEFORE_ATTRIBUTE_VALUE": "Before attribute value",
    "ATTRIBUTE_VALUE_DOUBLE_QUOTED": "Attribute value (double-quoted)",
    "ATTRIBUTE_VALUE_SINGLE_QUOTED": "Attribute value (single-quoted)",
    "ATTRIBUTE_VALUE_UNQUOTED": "Attribute value (unquoted)",
    "CHARACTER_REFERENCE_IN_ATTRIBUTE_VALUE": "Character reference in attribute value",
    "AFTER_ATTRIBUTE_VALUE_QUOTED": "After attribute value (quoted)",
    "SELF_CLOSING_START_TAG": "Self-closing start tag",
    "BOGUS_COMMENT": "Bogus comment",
    "MARKUP_DECLARATION_OPEN": "Markup declaration open",
    "COMMENT_START": "Comment start",
    "COMMENT_START_DASH": "Comment start dash",
    "COMMENT": "Comment",
    "COMMENT_END_DASH": "Comment end dash",
    "COMMENT_END": "Comment end",
    "COMMENT_END_BANG": "Comment end bang",
    "DOCTYPE": "DOCTYPE",
    "BEFORE_DOCTYPE_NAME": "Before DOCTYPE name",
    "DOCTYPE_NAME": "DOCTYPE name",
    "AFTER_DOCTYPE_NAME": "After DOCTYPE name",
    "AFTER_DOCTYPE_PUBLIC_KEYWORD": "After DOCTYPE public keyword",
    "BEFORE_DOCTYPE_PUBLIC_IDENTIFIER": "Before DOCTYPE public identifier",
    "DOCTYPE_PUBLIC_IDENTIFIER_DOUBLE_QUOTED": "DOCTYPE public identifier (double-quoted)",
    "DOCTYPE_PUBLIC_IDENTIFIER_SINGLE_QUOTED": "DOCTYPE public identifier (single-quoted)",
    "AFTER_DOCTYPE_PUBLIC_IDENTIFIER": "After DOCTYPE public identifier",
    "BETWEEN_DOCTYPE_PUBLIC_AND_SYSTEM_IDENTIFIERS": "Between DOCTYPE public and system identifiers",
    "AFTER_DOCTYPE_SYSTEM_KEYWORD": "After DOCTYPE system keyword",
    "BEFORE_DOCTYPE_SYSTEM_IDENTIFIER": "Before DOCTYPE system identifier",
    "DOCTYPE_SYSTEM_IDENTIFIER_DOUBLE_QUOTED": "DOCTYPE system identifier (double-quoted)",
    "DOCTYPE_SYSTEM_IDENTIFIER_SINGLE_QUOTED": "DOCTYPE system identifier (single-quoted)",
    "AFTER_DOCTYPE_SYSTEM_IDENTIFIER": "After DOCTYPE system identifier",
    "BOGUS_DOCTYPE": "Bogus DOCTYPE",
    "CDATA_SECTION": "CDATA section",
}

_NUL = "err=unexpected-null-character"
_BAD = "�"
_COMMENT_EOF = "eof: err=eof-in-comment flush halt"
_TAG_EOF = "eof: err=eof-in-tag halt"
_DOCTYPE_EOF = "eof: err=eof-in-doctype quirks flush halt"
_NO_DOCTYPE_EOF = "eof: err=eof-in-doctype new=doctype quirks flush halt"
_SCRIPT_EOF = "eof: err=eof-in-script-html-comment-like-text halt"


def _text(less_than: str, reference: str = "") -> str:
    """Text up to an angle bracket and, where they count, references."""
    return f"'<': > {less_than}\n" + (f"'&': > {reference}\n" if reference else "") + f"nul: {_NUL} emit\neof: halt\n*: emit"


def _open(name: str, back: str) -> str:
    """After `</` in text that only its own end tag ends."""
    return f"alpha: new=end low=tag clear add=buffer > {name}\neof: emit=</ > {back}\n*: emit=</ > ^{back}"


def _dashes(inside: str, dash: str, less_than: str, bracket: str) -> dict[str, str]:
    """Escaped script text: after no dash, one, and two or more."""

    def rest(back: str) -> str:
        return f"'<': {bracket} > {less_than}\nnul: {_NUL} emit{back}\n{_SCRIPT_EOF}\n*: emit{back}"

    return {
        inside: f"'-': emit > {dash}\n" + rest(""),
        dash: f"'-': emit > {dash}_DASH\n" + rest(f" > {inside}"),
        f"{dash}_DASH": "'-': emit\n'>': emit > SCRIPT_DATA\n" + rest(f" > {inside}"),
    }


def _value(quote: str) -> str:
    return f"{quote}: > AFTER_ATTRIBUTE_VALUE_QUOTED\n'&': > CHARACTER_REFERENCE_IN_ATTRIBUTE_VALUE\nnul: {_NUL} put=value~{_BAD}\n{_TAG_EOF}\n*: add=value"


def _keyword(which: str, field: str, then: str) -> dict[str, str]:
    """What follows PUBLIC or SYSTEM, and the identifiers."""
    up = which.upper()
    quotes = "\"\\\"\": {e} set={f}~ > DOCTYPE_{u}_IDENTIFIER_DOUBLE_QUOTED\n\"'\": {e} set={f}~ > DOCTYPE_{u}_IDENTIFIER_SINGLE_QUOTED\n"
    tail = f"'>': err=missing-doctype-{which}-identifier quirks flush > DATA\n{_DOCTYPE_EOF}\n*: err=missing-quote-before-doctype-{which}-identifier quirks > ^BOGUS_DOCTYPE"
    inside = f"nul: {_NUL} put={field}~{_BAD}\n'>': err=abrupt-doctype-{which}-identifier quirks flush > DATA\n{_DOCTYPE_EOF}\n*: add={field}"
    return {
        f"AFTER_DOCTYPE_{up}_KEYWORD": f"ws: > BEFORE_DOCTYPE_{up}_IDENTIFIER\n" + quotes.format(e=f"err=missing-whitespace-after-doctype-{which}-keyword", f=field, u=up) + tail,
        f"BEFORE_DOCTYPE_{up}_IDENTIFIER": "ws:\n" + quotes.format(e="", f=field, u=up) + tail,
        f"DOCTYPE_{up}_IDENTIFIER_DOUBLE_QUOTED": f"\"\\\"\": > {then}\n{inside}",
        f"DOCTYPE_{up}_IDENTIFIER_SINGLE_QUOTED": f"\"'\": > {then}\n{inside}",
    }


_SYSTEM_QUOTES = "\"\\\"\": {e} set=system~ > DOCTYPE_SYSTEM_IDENTIFIER_DOUBLE_QUOTED\n\"'\": {e} set=system~ > DOCTYPE_SYSTEM_IDENTIFIER_SINGLE_QUOTED\n'>': flush > DATA\n" + f"{_DOCTYPE_EOF}\n*: err=missing-quote-before-doctype-system-identifier quirks > ^BOGUS_DOCTYPE"

RULES: dict[str, str] = {
    "DATA": _text("TAG_OPEN", "CHARACTER_REFERENCE_IN_DATA"),
    "RCDATA": _text("RCDATA_LESS_THAN_SIGN", "CHARACTER_REFERENCE_IN_RCDATA"),
    "RAWTEXT": _text("RAWTEXT_LESS_THAN_SIGN"),
    "SCRIPT_DATA": _text("SCRIPT_DATA_LESS_THAN_SIGN"),
    "PLAINTEXT": f"nul: {_NUL} emit\neof: halt\n*: emit",
    "TAG_OPEN": "'!': > MARKUP_DECLARATION_OPEN\n'/': > END_TAG_OPEN\nalpha: new=start > ^TAG_NAME\n'?': err=unexpected-question-mark-instead-of-tag-name new=comment > ^BOGUS_COMMENT\neof: err=invalid-first-character-of-tag-name emit=< > DATA\n*: err=invalid-first-character-of-tag-name emit=< > ^DATA",
    "END_TAG_OPEN": "alpha: new=end > ^TAG_NAME\n'>': err=missing-end-tag-name > DATA\neof: err=eof-before-tag-name emit=</ > DATA\n*: err=invalid-first-character-of-tag-name new=comment > ^BOGUS_COMMENT",
    "TAG_NAME": f"ws: > BEFORE_ATTRIBUTE_NAME\n'/': > SELF_CLOSING_START_TAG\n'>': flush > DATA\nupper: low=tag\nnul: {_NUL} put=tag~{_BAD}\n{_TAG_EOF}\n*: add=tag",
    "RCDATA_LESS_THAN_SIGN": "peek\n'/': clear > RCDATA_END_TAG_OPEN\neof: emit=< > RCDATA\n*: emit=< > ^RCDATA",
    "RAWTEXT_LESS_THAN_SIGN": "peek\n'/': clear > RAWTEXT_END_TAG_OPEN\neof: emit=< > RAWTEXT\n*: emit=< > ^RAWTEXT",
    "SCRIPT_DATA_LESS_THAN_SIGN": "peek\n'/': clear > SCRIPT_DATA_END_TAG_OPEN\n'!': emit=<! > SCRIPT_DATA_ESCAPE_START\neof: emit=< > SCRIPT_DATA\n*: emit=< > ^SCRIPT_DATA",
    "RCDATA_END_TAG_OPEN": _open("RCDATA_END_TAG_NAME", "RCDATA"),
    "RAWTEXT_END_TAG_OPEN": _open("RAWTEXT_END_TAG_NAME", "RAWTEXT"),
    "SCRIPT_DATA_END_TAG_OPEN": _open("SCRIPT_DATA_END_TAG_NAME", "SCRIPT_DATA"),
    "SCRIPT_DATA_ESCAPED_END_TAG_OPEN": _open("SCRIPT_DATA_ESCAPED_END_TAG_NAME", "SCRIPT_DATA_ESCAPED"),
    "SCRIPT_DATA_ESCAPE_START": "peek\n'-': emit > SCRIPT_DATA_ESCAPE_START_DASH\neof: > SCRIPT_DATA\n*: > ^SCRIPT_DATA",
    "SCRIPT_DATA_ESCAPE_START_DASH": "peek\n'-': emit > SCRIPT_DATA_ESCAPED_DASH_DASH\neof: > SCRIPT_DATA\n*: > ^SCRIPT_DATA",
    **_dashes("SCRIPT_DATA_ESCAPED", "SCRIPT_DATA_ESCAPED_DASH", "SCRIPT_DATA_ESCAPED_LESS_THAN_SIGN", ""),
    **_dashes("SCRIPT_DATA_DOUBLE_ESCAPED", "SCRIPT_DATA_DOUBLE_ESCAPED_DASH", "SCRIPT_DATA_DOUBLE_ESCAPED_LESS_THAN_SIGN", "emit"),
    "SCRIPT_DATA_ESCAPED_LESS_THAN_SIGN": "peek\n'/': clear > SCRIPT_DATA_ESCAPED_END_TAG_OPEN\nalpha: clear emit=< > ^SCRIPT_DATA_DOUBLE_ESCAPE_START\neof: emit=< > SCRIPT_DATA_ESCAPED\n*: emit=< > ^SCRIPT_DATA_ESCAPED",
    "SCRIPT_DATA_DOUBLE_ESCAPED_LESS_THAN_SIGN": "peek\n'/': clear emit > SCRIPT_DATA_DOUBLE_ESCAPE_END\neof: > SCRIPT_DATA_DOUBLE_ESCAPED\n*: > ^SCRIPT_DATA_DOUBLE_ESCAPED",
    "BEFORE_ATTRIBUTE_NAME": "ws:\n'/': > SELF_CLOSING_START_TAG\n'>': flush > DATA\n'=': err=unexpected-equals-sign-before-attribute-name attr add=attr > ATTRIBUTE_NAME\neof: attr > ATTRIBUTE_NAME\n*: attr > ^ATTRIBUTE_NAME",
    "ATTRIBUTE_NAME": f"ws: named > AFTER_ATTRIBUTE_NAME\n'/': named > ^AFTER_ATTRIBUTE_NAME\n'>': named > ^AFTER_ATTRIBUTE_NAME\neof: named > AFTER_ATTRIBUTE_NAME\n'=': named > BEFORE_ATTRIBUTE_VALUE\nupper: low=attr\nnul: {_NUL} put=attr~{_BAD}\n" + "\"\\\"\": err=unexpected-character-in-attribute-name add=attr\n\"'\": err=unexpected-character-in-attribute-name add=attr\n'<': err=unexpected-character-in-attribute-name add=attr\n*: add=attr",
    "AFTER_ATTRIBUTE_NAME": f"ws:\n'/': > SELF_CLOSING_START_TAG\n'=': > BEFORE_ATTRIBUTE_VALUE\n'>': flush > DATA\n{_TAG_EOF}\n*: attr > ^ATTRIBUTE_NAME",
    "BEFORE_ATTRIBUTE_VALUE": "ws:\n\"\\\"\": > ATTRIBUTE_VALUE_DOUBLE_QUOTED\n\"'\": > ATTRIBUTE_VALUE_SINGLE_QUOTED\n'>': err=missing-attribute-value flush > DATA\neof: > ATTRIBUTE_VALUE_UNQUOTED\n*: > ^ATTRIBUTE_VALUE_UNQUOTED",
    "ATTRIBUTE_VALUE_DOUBLE_QUOTED": _value('"\\""'),
    "ATTRIBUTE_VALUE_SINGLE_QUOTED": _value("\"'\""),
    "ATTRIBUTE_VALUE_UNQUOTED": f"ws: > BEFORE_ATTRIBUTE_NAME\n'&': > CHARACTER_REFERENCE_IN_ATTRIBUTE_VALUE\n'>': flush > DATA\nnul: {_NUL} put=value~{_BAD}\n{_TAG_EOF}\n*: add=value",
    "AFTER_ATTRIBUTE_VALUE_QUOTED": f"ws: > BEFORE_ATTRIBUTE_NAME\n'/': > SELF_CLOSING_START_TAG\n'>': flush > DATA\n{_TAG_EOF}\n*: err=missing-whitespace-between-attributes > ^BEFORE_ATTRIBUTE_NAME",
    "SELF_CLOSING_START_TAG": f"'>': closing flush > DATA\n{_TAG_EOF}\n*: err=unexpected-solidus-in-tag > ^BEFORE_ATTRIBUTE_NAME",
    "BOGUS_COMMENT": f"'>': flush > DATA\neof: flush halt\nnul: {_NUL} put=data~{_BAD}\n*: add=data",
    "COMMENT_START": "'-': > COMMENT_START_DASH\n'>': err=abrupt-closing-of-empty-comment flush > DATA\neof: > COMMENT\n*: > ^COMMENT",
    "COMMENT_START_DASH": f"'-': > COMMENT_END\n'>': err=abrupt-closing-of-empty-comment flush > DATA\n{_COMMENT_EOF}\n*: put=data~- > ^COMMENT",
    "COMMENT": f"'-': > COMMENT_END_DASH\nnul: {_NUL} put=data~{_BAD}\n{_COMMENT_EOF}\n*: add=data",
    "COMMENT_END_DASH": f"'-': > COMMENT_END\n{_COMMENT_EOF}\n*: put=data~- > ^COMMENT",
    "COMMENT_END": f"'>': flush > DATA\n'!': > COMMENT_END_BANG\n'-': put=data~-\n{_COMMENT_EOF}\n*: put=data~-- > ^COMMENT",
    "COMMENT_END_BANG": f"'-': put=data~--! > COMMENT_END_DASH\n'>': err=incorrectly-closed-comment flush > DATA\n{_COMMENT_EOF}\n*: put=data~--! > ^COMMENT",
    "DOCTYPE": f"ws: > BEFORE_DOCTYPE_NAME\n{_NO_DOCTYPE_EOF}\n*: err=missing-whitespace-before-doctype-name > ^BEFORE_DOCTYPE_NAME",
    "BEFORE_DOCTYPE_NAME": f"ws:\nupper: new=doctype low=name > DOCTYPE_NAME\nnul: {_NUL} new=doctype put=name~{_BAD} > DOCTYPE_NAME\n'>': err=missing-doctype-name new=doctype quirks flush > DATA\n{_NO_DOCTYPE_EOF}\n*: new=doctype add=name > DOCTYPE_NAME",
    "DOCTYPE_NAME": f"ws: > AFTER_DOCTYPE_NAME\n'>': flush > DATA\nupper: low=name\nnul: {_NUL} put=name~{_BAD}\n{_DOCTYPE_EOF}\n*: add=name",
    **_keyword("public", "public", "AFTER_DOCTYPE_PUBLIC_IDENTIFIER"),
    **_keyword("system", "system", "AFTER_DOCTYPE_SYSTEM_IDENTIFIER"),
    "AFTER_DOCTYPE_PUBLIC_IDENTIFIER": "ws: > BETWEEN_DOCTYPE_PUBLIC_AND_SYSTEM_IDENTIFIERS\n" + _SYSTEM_QUOTES.format(e="err=missing-whitespace-between-doctype-public-and-system-identifiers"),
    "BETWEEN_DOCTYPE_PUBLIC_AND_SYSTEM_IDENTIFIERS": "ws:\n" + _SYSTEM_QUOTES.format(e=""),
    "AFTER_DOCTYPE_SYSTEM_IDENTIFIER": f"ws:\n'>': flush > DATA\n{_DOCTYPE_EOF}\n*: err=unexpected-character-after-doctype-system-identifier > ^BOGUS_DOCTYPE",
    "BOGUS_DOCTYPE": f"'>': flush > DATA\nnul: {_NUL}\neof: flush halt\n*:",
}

#: Start tag -> state of the text that follows; also the first state of a fragment in that element.
TEXT_STATES = {"textarea": "RCDATA", "title": "RCDATA", "style": "RAWTEXT", "xmp": "RAWTEXT", "script": "SCRIPT_DATA", "plaintext": "PLAINTEXT"}
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
