"""The exact lexer: a small machine that runs the rules of states.py over one document.

Runs of ordinary characters are taken at once by a compiled regex, so Python's cost is for
each token and not for each character. In driven mode a tree builder listens and sets the
state after a start tag, before the next character is read.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable

from ..functions.charref import decode_at
from .states import RULES, TEXT_STATES, TITLES, VOID

WS, ALPHA = "\t\n\f ", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CLASSES = {"ws": WS, "upper": ALPHA[26:], "alpha": ALPHA, "nul": "\0"}
_LOWER = {ord(c): c.lower() for c in ALPHA[26:]}
#: Which end-tag-name state gives its text back to which state.
END_NAMES = {"RCDATA_END_TAG_NAME": "RCDATA", "RAWTEXT_END_TAG_NAME": "RAWTEXT", "SCRIPT_DATA_END_TAG_NAME": "SCRIPT_DATA", "SCRIPT_DATA_ESCAPED_END_TAG_NAME": "SCRIPT_DATA_ESCAPED"}
CHARREFS = {"CHARACTER_REFERENCE_IN_DATA": "DATA", "CHARACTER_REFERENCE_IN_RCDATA": "RCDATA"}


def fold(s: str) -> str:
    """A-Z lowered, nothing else."""
    return s.translate(_LOWER)


def units(s: str) -> int:
    """UTF-16 units."""
    return len(s) + sum(c > "￿" for c in s) if not s.isascii() else len(s)


class Tree:
    """Elements, texts and comments of one document, numbered as they open; pre and post come from one counter."""

    def __init__(self):
        self.nodes: list[dict] = []
        self.clock = 0
        self.doctype: dict | None = None
        self.open: list[int] = []
        self.kids: list[int] = []  # children so far of each open node
        self.text: list[int | None] = []  # its last child, if that is a text
        self.push("document", None, None)

    def add(self, kind: str, tag: str | None, attrs: list | None, data: str | None = None) -> int:
        node, self.clock = len(self.nodes), self.clock + 1
        parent = self.open[-1] if self.open else None
        self.nodes.append({"node": node, "parent": parent, "depth": len(self.open), "sib": self.kids[-1] if self.open else 0, "pre": self.clock - 1, "post": None, "kind": kind, "tag": tag, "attrs": attrs, "data": data})
        if self.open:
            self.kids[-1] += 1
            self.text[-1] = None
        return node

    def close(self, node: int) -> None:
        self.nodes[node]["post"], self.clock = self.clock, self.clock + 1

    def push(self, kind: str, tag: str | None, attrs: list | None) -> None:
        self.open.append(self.add(kind, tag, attrs))
        self.kids.append(0)
        self.text.append(None)

    def pop(self) -> None:
        self.close(self.open.pop())
        self.kids.pop()
        self.text.pop()

    def characters(self, s: str) -> None:
        if self.text[-1] is None:
            self.close(at := self.add("text", None, None, []))
            self.text[-1] = at
        self.nodes[self.text[-1]]["data"].append(s)

    def leaf(self, kind: str, tag: str | None = None, attrs: list | None = None, data: str | None = None) -> None:
        self.close(self.add(kind, tag, attrs, data))

    def end(self, tag: str) -> None:
        """Pops down to the innermost open element of that name; without one, nothing."""
        for at in range(len(self.open) - 1, 0, -1):
            if self.nodes[self.open[at]]["tag"] == tag:
                while len(self.open) > at:
                    self.pop()
                return

    def finish(self) -> list[dict]:
        while self.open:
            self.pop()
        for n in self.nodes:
            if n["kind"] == "text":
                n["data"] = "".join(n["data"])
        return self.nodes


class Machine:
    def __init__(self, text: str, state: str = "DATA", last_start_tag: str | None = None, *, driven: bool = False, trace: int = 0, steps: int | None = None):
        self.text, self.pos, self.state, self.last = text, 0, state, last_start_tag
        self.tokens: list[dict] = []
        self.errors: list[tuple[str, str]] = []
        self.trace: list[tuple[str, int]] = []
        self.cap, self.steps, self.halted = trace, steps, False
        self.kind: str | None = None  # of the current token
        self.fields: dict[str, str] = {}
        self.attrs: list[list[str]] = []
        self.attr = ["", ""]
        self.buffer = ""
        self.quirks = self.closing = False
        self.back = ""  # where a reference in a value returns to
        self.run: list[str] | None = None
        self.tree = Tree() if driven else None
        self.started: str | None = None

    # --- what operations do

    def error(self, code: str) -> None:
        self.errors.append((self.state, code))

    def emit(self, s: str, n: int | None = None) -> None:
        last = self.tokens[-1] if self.tokens else None
        if last is None or last["kind"] != "Character" or last["emit_state"] != self.state:
            last = {"kind": "Character", "emit_state": self.state, "data": [], "n_chars": 0}
            self.tokens.append(last)
        last["data"].append(s)
        last["n_chars"] += units(s) if n is None else n
        if self.tree:
            self.tree.characters(s)

    def new(self, kind: str) -> None:
        self.kind, self.fields, self.attrs, self.quirks, self.closing = kind, {}, [], False, False

    def put(self, field: str, s: str) -> None:
        if field == "value":
            self.attr[1] += s
        elif field == "attr":
            self.attr[0] += s
        elif field == "buffer":
            self.buffer += s
        else:
            self.fields[field] = self.fields.get(field, "") + s

    def new_attr(self) -> None:
        self.attr = ["", ""]

    def named(self) -> None:
        if any(a[0] == self.attr[0] for a in self.attrs):
            self.error("duplicate-attribute")
        else:
            self.attrs.append(self.attr)

    def flush(self, as_start: bool = True) -> None:
        kind, f = self.kind, self.fields
        token: dict = {"emit_state": self.state}
        if kind in ("start", "end"):
            token |= {"kind": "StartTag" if kind == "start" else "EndTag", "tag": f.get("tag", ""), "self_closing": self.closing, "attrs": self.attrs}
        elif kind == "comment":
            token |= {"kind": "Comment", "data": f.get("data", "")}
        else:
            token |= {"kind": "DOCTYPE", "dt_name": f.get("name"), "dt_public": f.get("public"), "dt_system": f.get("system"), "force_quirks": self.quirks}
        self.tokens.append(token)
        if kind == "start" and as_start:
            self.last = token["tag"]
        self.kind = None
        if self.tree:
            self.build(token)

    def build(self, token: dict) -> None:
        kind, tree = token["kind"], self.tree
        if kind == "DOCTYPE":
            tree.doctype = {"name": token["dt_name"], "public_id": token["dt_public"], "system_id": token["dt_system"], "force_quirks": token["force_quirks"]}
        elif kind == "Comment":
            tree.leaf("comment", data=token["data"])
        elif kind == "EndTag":
            tree.end(token["tag"])
        elif token["self_closing"] or token["tag"] in VOID:
            tree.leaf("element", token["tag"], token["attrs"])
        else:
            tree.push("element", token["tag"], token["attrs"])
            self.started = token["tag"]

    def halt(self) -> None:
        self.tokens.append({"kind": "EOF", "emit_state": self.state})
        self.halted = True

    # --- states that look further than one character

    def reference(self, back: str, in_value: bool = False) -> None:
        c = self.text[self.pos : self.pos + 1]
        quote = {"ATTRIBUTE_VALUE_DOUBLE_QUOTED": '"', "ATTRIBUTE_VALUE_SINGLE_QUOTED": "'"}.get(self.back) if in_value else None
        decoded, errors = None, []
        if c and c not in WS + "<&" and c != quote:
            decoded, self.pos, errors = decode_at(self.text, self.pos, in_value)
        self.errors += [(self.state, e) for e in errors]
        s = "&" if decoded is None else decoded
        if in_value:
            self.attr[1] += s
        else:
            self.emit(s, 1)
        self.state = back

    def markup(self) -> None:
        if self.text.startswith("--", self.pos):
            self.pos += 2
            self.new("comment")
            self.state = "COMMENT_START"
        elif fold(self.text[self.pos : self.pos + 7]) == "doctype":
            self.pos += 7
            self.state = "DOCTYPE"
        elif self.text.startswith("[CDATA[", self.pos):
            self.pos += 7
            self.state = "CDATA_SECTION"
        else:
            self.error("incorrectly-opened-comment")
            self.new("comment")
            self.state = "BOGUS_COMMENT"

    def cdata(self) -> None:
        if self.text.startswith("]]>", self.pos):
            self.pos += 3
            self.state = "DATA"
        elif self.pos >= len(self.text):
            self.error("eof-in-cdata")
            self.halt()
        else:
            if not self.cap and (m := _PLAIN_CDATA.match(self.text, self.pos)):
                s = m[0]
            else:
                s = self.text[self.pos]
            if s == "\0":
                self.error("unexpected-null-character")
            self.pos += len(s)
            self.emit(s)

    def after_doctype_name(self) -> None:
        c = self.text[self.pos : self.pos + 1]
        if c and c in WS:
            self.pos += 1
        elif c == ">":
            self.pos += 1
            self.flush()
            self.state = "DATA"
        elif not c:
            self.pos += 1
            self.error("eof-in-doctype")
            self.quirks = True
            self.flush()
            self.halt()
        elif (word := fold(self.text[self.pos : self.pos + 6])) in ("public", "system"):
            self.pos += 6
            self.state = f"AFTER_DOCTYPE_{word.upper()}_KEYWORD"
        else:
            self.error("invalid-character-sequence-after-doctype-name")
            self.quirks = True
            self.state = "BOGUS_DOCTYPE"

    def end_name(self, back: str) -> None:
        """Only an end tag of the element that opened this text ends it; else all of it was text."""
        c = self.text[self.pos : self.pos + 1]
        self.pos += 1
        if self.fields["tag"] == self.last and c and c in WS + "/>":
            if c == ">":
                self.flush()
                self.state = "DATA"
            else:
                self.state = "SELF_CLOSING_START_TAG" if c == "/" else "BEFORE_ATTRIBUTE_NAME"
        elif c and c in ALPHA:
            self.put("tag", fold(c))
            self.buffer += c
        else:
            self.emit("</" + self.buffer)
            self.kind, self.state = None, back
            self.pos -= bool(c)

    def double_escape(self, same: str, other: str) -> None:
        c = self.text[self.pos : self.pos + 1]
        self.pos += 1
        if c and c in WS + "/>":
            self.state = same if self.buffer == "script" else other
            self.emit(c)
        elif c and c in ALPHA:
            self.buffer += c
            self.emit(c)
        else:
            self.state = "SCRIPT_DATA_ESCAPED" if same == "SCRIPT_DATA_DOUBLE_ESCAPED" else "SCRIPT_DATA_DOUBLE_ESCAPED"
            self.pos -= bool(c)

    # --- the loop

    def go(self) -> Machine:
        text, n = self.text, len(self.text)
        while not self.halted:
            if self.steps is not None:
                if not self.steps:
                    break
                self.steps -= 1
            state = self.state
            if len(self.trace) < self.cap:
                self.trace.append((state, self.pos))
            if code := _CODE.get(state):
                code(self)
            else:
                rules, other, eof, span, field, peek = _TABLE[state]
                if span and not self.cap and self.steps is None and (m := span.match(text, self.pos)):
                    self.pos = m.end()
                    if field == "emit":
                        self.emit(m[0])
                    elif field != "skip":
                        self.put(field, m[0])
                if self.pos < n:
                    c = text[self.pos]
                    ops, follow, again = rules.get(c, other)
                    self.pos += not again
                else:
                    c = ""
                    ops, follow, again = eof
                    self.pos += not peek
                if follow == "CHARACTER_REFERENCE_IN_ATTRIBUTE_VALUE":
                    self.back = state
                for op in ops:
                    op(self, c)
                if follow:
                    self.state = follow
            if self.started is not None:
                self.enter(self.started)
                self.started = None
        for t in self.tokens:
            if t["kind"] == "Character":
                t["data"] = "".join(t["data"])
        return self

    def enter(self, tag: str) -> None:
        """The tree's answer to a start tag."""
        if state := TEXT_STATES.get(tag):
            self.state = state
            if tag != "plaintext":
                self.last = tag


_PLAIN_CDATA = re.compile(r"[^\]\0]+")

_CODE: dict[str, Callable[[Machine], None]] = {
    **{s: (lambda m, b=b: m.reference(b)) for s, b in CHARREFS.items()},
    "CHARACTER_REFERENCE_IN_ATTRIBUTE_VALUE": lambda m: m.reference(m.back, True),
    "MARKUP_DECLARATION_OPEN": Machine.markup,
    "CDATA_SECTION": Machine.cdata,
    "AFTER_DOCTYPE_NAME": Machine.after_doctype_name,
    **{s: (lambda m, b=b: m.end_name(b)) for s, b in END_NAMES.items()},
    "SCRIPT_DATA_DOUBLE_ESCAPE_START": lambda m: m.double_escape("SCRIPT_DATA_DOUBLE_ESCAPED", "SCRIPT_DATA_ESCAPED"),
    "SCRIPT_DATA_DOUBLE_ESCAPE_END": lambda m: m.double_escape("SCRIPT_DATA_ESCAPED", "SCRIPT_DATA_DOUBLE_ESCAPED"),
}


def _operation(word: str) -> Callable[[Machine, str], None]:
    name, _, arg = word.partition("=")
    field, _, given = arg.partition("~")
    return {
        "emit": (lambda m, c: m.emit(arg)) if arg else (lambda m, c: m.emit(c)),
        "err": lambda m, c: m.error(arg),
        "new": lambda m, c: m.new(arg),
        "add": lambda m, c: m.put(field, c),
        "low": lambda m, c: m.put(field, fold(c)),
        "put": lambda m, c: m.put(field, given),
        "set": lambda m, c: m.fields.__setitem__(field, given),
        "attr": lambda m, c: m.new_attr(),
        "named": lambda m, c: m.named(),
        "flush": lambda m, c: m.flush(),
        "quirks": lambda m, c: setattr(m, "quirks", True),
        "closing": lambda m, c: setattr(m, "closing", True),
        "clear": lambda m, c: setattr(m, "buffer", ""),
        "halt": lambda m, c: m.halt(),
    }[name]


def _compile(source: str) -> tuple:
    """Rules of one state: character -> (operations, next state, give back), the rule for others, for the end, the regex of a run, its field, peek."""
    rules: dict[str, tuple] = {}
    other = eof = None
    peek, span_ops = False, ""
    for line in reversed(source.split("\n")):  # what stands first wins
        if line == "peek":
            peek = True
            continue
        m = re.match(r"('(?:[^'\\]|\\.)+'|\"(?:[^\"\\]|\\.)+\"|[a-z*]+):(.*)$", line)
        key, rest = m[1], m[2]
        words, _, follow = rest.rpartition(" > ") if " > " in rest else (rest, "", "")
        follow = follow.strip()
        rule = (tuple(map(_operation, words.split())), follow.lstrip("^") or None, follow.startswith("^"))
        if key == "eof":
            eof = rule
        elif key == "*":
            other = rule
            span_ops = "" if follow else words.strip() or "skip"
        else:
            for c in _CLASSES.get(key) or ast.literal_eval(key):
                rules[c] = rule
    span = field = None
    if span_ops and (span_ops in ("emit", "skip") or span_ops.startswith("add=")):
        span, field = re.compile("[^" + re.escape("".join(rules)) + "]+"), span_ops.removeprefix("add=")
    return rules, other, eof, span, field, peek


_TABLE = {state: _compile(source) for state, source in RULES.items()}
assert not set(_TABLE) & set(_CODE) and set(_TABLE) | set(_CODE) == set(TITLES)


def initial_state(context: str | None) -> str:
    """The first state of a fragment in that element."""
    return TEXT_STATES.get(context or "", "DATA")


def as_units(text: str) -> str:
    """A string with a character for each UTF-16 unit, so that positions count units."""
    if text.isascii() or not any(c > "￿" for c in text):
        return text
    raw = text.encode("utf-16-le", "surrogatepass")
    return "".join(chr(raw[i] | raw[i + 1] << 8) for i in range(0, len(raw), 2))


def lex(text: str, *, state: str | None = None, last_start_tag: str | None = None, driven: bool = False, context: str | None = None, trace: int = 0, steps: int | None = None) -> Machine:
    """Runs the machine over one preprocessed document and returns it, halted (or after `steps` steps).

    state and last_start_tag force the start; context parses a fragment of that element.
    trace: how many (state, position) entries to keep, positions in UTF-16 units; that run
    goes character by character.
    """
    if context is not None:
        state, last_start_tag = state or initial_state(context), context if last_start_tag is None else last_start_tag
    m = Machine(text, state or "DATA", last_start_tag, driven=driven, steps=steps).go()
    if trace:
        m.trace = Machine(as_units(text), state or "DATA", last_start_tag, driven=driven, trace=trace, steps=steps).go().trace
    return m
