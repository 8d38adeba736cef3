import re

from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.functions.charref import NAMED, WINDOWS_1252, decode_all, decode_at
from pagemill.operators.kernel import lex, units
from pagemill.operators.states import RULES, TITLES

CODES = set(re.findall(r"err=([a-z-]+)", "\n".join(RULES.values())))
BESIDES = {"duplicate-attribute", "eof-in-cdata", "incorrectly-opened-comment", "invalid-character-sequence-after-doctype-name", "null-character-reference", "character-reference-outside-unicode-range", "surrogate-character-reference", "control-character-reference", "absence-of-digits-in-numeric-character-reference", "missing-semicolon-after-character-reference"}


def codes(html, **options):
    return [c for _, c in lex(html, **options).errors]


def test_counts_of_states_references_and_codes():
    assert len(TITLES) == 68
    assert len(NAMED) == 26
    assert len(WINDOWS_1252) == 27
    assert len(CODES | BESIDES) == 38


def test_error_codes():
    cases = {
        "&amp b": "missing-semicolon-after-character-reference",
        "&#65b": "missing-semicolon-after-character-reference",
        "&#;": "absence-of-digits-in-numeric-character-reference",
        "&#0;": "null-character-reference",
        "&#1114112;": "character-reference-outside-unicode-range",
        "&#99999999999999999999999;": "character-reference-outside-unicode-range",
        "&#55296;": "surrogate-character-reference",
        "&#128;": "control-character-reference",
        "<di": "eof-in-tag",
        "</>": "missing-end-tag-name",
        "</": "eof-before-tag-name",
        "<1": "invalid-first-character-of-tag-name",
        "<?x>": "unexpected-question-mark-instead-of-tag-name",
        '<a b="1" b="2">': "duplicate-attribute",
        '<a b="1"c="2">': "missing-whitespace-between-attributes",
        "<a =x>": "unexpected-equals-sign-before-attribute-name",
        "<a b'c>": "unexpected-character-in-attribute-name",
        "<a b=>": "missing-attribute-value",
        "<a / b>": "unexpected-solidus-in-tag",
        "<!x>": "incorrectly-opened-comment",
        "<!-->": "abrupt-closing-of-empty-comment",
        "<!--x--!>": "incorrectly-closed-comment",
        "<!--x": "eof-in-comment",
        "<!DOCTYPEhtml>": "missing-whitespace-before-doctype-name",
        "<!DOCTYPE >": "missing-doctype-name",
        "<!DOCTYPE html": "eof-in-doctype",
        "<!DOCTYPE html FOO>": "invalid-character-sequence-after-doctype-name",
        '<!DOCTYPE html PUBLIC"x">': "missing-whitespace-after-doctype-public-keyword",
        "<!DOCTYPE html PUBLIC>": "missing-doctype-public-identifier",
        "<!DOCTYPE html PUBLIC x>": "missing-quote-before-doctype-public-identifier",
        '<!DOCTYPE html PUBLIC "x>': "abrupt-doctype-public-identifier",
        '<!DOCTYPE html PUBLIC "x""y">': "missing-whitespace-between-doctype-public-and-system-identifiers",
        '<!DOCTYPE html SYSTEM"x">': "missing-whitespace-after-doctype-system-keyword",
        "<!DOCTYPE html SYSTEM>": "missing-doctype-system-identifier",
        "<!DOCTYPE html SYSTEM x>": "missing-quote-before-doctype-system-identifier",
        '<!DOCTYPE html SYSTEM "x>': "abrupt-doctype-system-identifier",
        '<!DOCTYPE html SYSTEM "x" y>': "unexpected-character-after-doctype-system-identifier",
        "<![CDATA[x": "eof-in-cdata",
        "a\0": "unexpected-null-character",
    }
    for html, code in cases.items():
        assert code in codes(html), html
    assert codes("", state="SCRIPT_DATA_ESCAPED") == ["eof-in-script-html-comment-like-text"]
    assert set(cases.values()) | {"eof-in-script-html-comment-like-text"} == CODES | BESIDES


def test_reference_errors_carry_the_reference_state():
    assert lex("&#0;").errors == [("CHARACTER_REFERENCE_IN_DATA", "null-character-reference")]


def test_eof_in_before_attribute_name_is_one_error():
    assert lex("<a  ").errors == [("AFTER_ATTRIBUTE_NAME", "eof-in-tag")]


def test_last_start_tag():
    assert lex("<div></span>").last == "div"
    assert lex("</span>").last is None
    assert lex("<textarea><b></textarea>").last == "b"


def test_characters_count_utf16_units_and_references_once():
    runs = [t for t in lex("😀&#128512;x").tokens if t["kind"] == "Character"]
    assert [(t["data"], t["n_chars"]) for t in runs] == [("😀", 2), ("😀", 1), ("x", 1)]


def test_trace_counts_units_and_is_capped():
    trace = lex("a😀b", trace=4000).trace
    assert trace == [("DATA", 0), ("DATA", 1), ("DATA", 2), ("DATA", 3), ("DATA", 4)]
    assert len(lex("x" * 50, trace=10).trace) == 10


def test_deep_trees_need_no_recursion():
    nodes = lex("<b>" * 20_000 + "x", driven=True).tree.finish()
    assert nodes[-1]["depth"] == 20_001 and nodes[0]["post"] == 2 * len(nodes) - 1


def test_plaintext_keeps_the_last_start_tag_of_its_own():
    assert lex("<plaintext></plaintext>", driven=True).tree.finish()[-1]["data"] == "</plaintext>"


PIECES = st.lists(st.sampled_from(["<", ">", "/", "!", "--", "a", "B", " ", "=", '"', "'", "&", "&amp;", "&#65", "script", "</script>", "<script>", "<title>", "<!--", "-->", "<![CDATA[", "]]>", "<!DOCTYPE ", "PUBLIC", "\0", "😀", "é", "?"]), max_size=25).map("".join)


@settings(max_examples=300, deadline=None)
@given(PIECES)
def test_runs_and_single_steps_agree(html):
    """Taking runs at once changes nothing: the traced run goes character by character."""
    from pagemill.operators.kernel import Machine

    fast, slow = Machine(html).go(), Machine(html, trace=10**9).go()
    assert fast.tokens == slow.tokens and fast.errors == slow.errors
    assert [t["kind"] for t in fast.tokens].count("EOF") == 1 and fast.tokens[-1]["kind"] == "EOF"
    driven = Machine(html, driven=True).go()
    texts = "".join(t["data"] for t in driven.tokens if t["kind"] == "Character")
    assert "".join(n["data"] for n in driven.tree.finish() if n["kind"] == "text") == texts


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="&#xX;ampltgquo019AF é", max_size=20))
def test_references_decode_alike_in_columns_and_in_text(s):
    got = "".join(t["data"] for t in lex(s).tokens if t["kind"] == "Character")
    assert decode_all(s) == got


def test_decode_at():
    assert decode_at("amp=", 0, True) == (None, 0, [])
    assert decode_at("amp=", 0, False) == ("&", 3, ["missing-semicolon-after-character-reference"])
    assert units("a😀é") == 4
