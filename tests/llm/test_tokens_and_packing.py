import collections
import math
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.llm import packing, tokens
from pagemill.llm.queries import op8_token_counts, op9_harmonic_packing

SF = "/root/testdata/sf0.01"
TOK = tokens.load(tokens.tokenizer_path(tokens.BYTE_BPE))


def ids(text):
    return TOK.encode(text or "", add_special_tokens=False).ids


def test_counts_of_the_whole_table(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op8_token_counts(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = len(ids(texts[r["doc_id"]]))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 1024)


ODD = ["a" * 500, " " * 300, "\n" * 200 + "x", "<|endoftext|>", "é" * 90, "字" * 70, "it's we'll", "123456", "!!??", "\t \n", "😀", "end<|endof", "text|>", " ", " word"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(ODD), max_size=12).map("".join), st.sampled_from([16, 40, 100]), st.sampled_from([2, 8, 30]))
def test_splices_give_the_ids_of_the_whole(text, chunk, overlap):
    assert tokens.encode_whole(TOK, text, chunk, overlap) == ids(text)


def test_splices_of_long_texts():
    rng = random.Random(0)
    for joiner in (" ", "", "\n", "<|endoftext|>"):
        text = joiner.join("".join(rng.choice("abcé .,'s\n0<|") for _ in range(rng.randrange(1, 30))) for _ in range(8000))
        assert tokens.encode_whole(TOK, text) == ids(text)
    assert tokens.encode_whole(TOK, "x" * 100_000) == ids("x" * 100_000)


def test_counting_edges(frame):
    rows = [(1, None), (2, ""), (3, "a<|endoftext|>b"), (3, "a<|endoftext|>b"), (None, "hello"), (4, "word " * 40_000)]
    got = sorted((r["doc_id"] or -1, r["n_tokens"]) for r in tokens.count_tokens(frame(rows)).collect())
    assert got == [(-1, 1), (1, 0), (2, 0), (3, 3), (3, 3), (4, len(ids("word " * 40_000)))]
    assert tokens.count_tokens(frame(rows).limit(0)).count() == 0


def test_both_libraries_agree_on_plain_characters():
    encode = tokens.encoder(tokens.BYTE_BPE)
    for c in map(chr, range(tokens.PLAIN_TO)):
        for text in (c, f"a{c}b", f" {c} {c}{c}", f"1{c}2", f"'{c}s", f"\n{c}\n", f"{c}'re", f"x{c} ", f".{c}!", f"  {c}  "):
            assert encode(text) == ids(text), (hex(ord(c)), text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x24F), max_size=60))
def test_both_libraries_agree_on_plain_texts(text):
    assert tokens.encoder(tokens.BYTE_BPE)(text) == ids(text)


def check_packing(rows, texts, capacity=2048):
    """rows: pieces; texts: all documents. Whole and gapless; the padding in all."""
    pieces, bins = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append(r)
    have = collections.Counter()
    for i, own in pieces.items():
        want = collections.Counter(tuple(ids(t)) + (1,) for j, t in texts if j == i)
        for doc, times in want.items():
            a = np.array(doc, "<u4")
            at = 0
            got = collections.defaultdict(list)
            for r in own:
                if r["doc_tokens"] == len(doc):
                    got[r["start"]].append(r)
            while at < len(doc):
                assert len(got[at]) >= times
                for r in got[at]:
                    if len([d for d in want if len(d) == len(doc)]) == 1:
                        assert r["ids_crc32"] == zlib.crc32(a[at : at + r["length"]].tobytes())
                at += got[at][0]["length"]
            assert at == len(doc)
            have[i] += times
    assert have == collections.Counter(j for j, _ in texts)
    padding = 0
    for own in bins.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= capacity
        padding += capacity - at
    return padding


def test_packing_of_the_whole_table(spark):
    """Little padding, and most documents whole."""
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = op9_harmonic_packing(spark, SF).collect()
    padding, total = check_packing(rows, texts), sum(r["length"] for r in rows)
    sequences = len({r["sequence_id"] for r in rows})
    assert padding <= 0.01 * total + 2048 * len({r["sequence_id"] >> 40 for r in rows})
    assert len(rows) <= len(texts) + 2 * sequences
    short = {r["doc_id"]: r["length"] == r["doc_tokens"] for r in rows if r["doc_tokens"] <= 2048}
    assert sum(short.values()) >= 0.8 * len(short)


@pytest.mark.parametrize("capacity, lengths", [(2048, [1100] * 7 + [700] * 9 + [500] * 13), (12, list(range(1, 40))), (2048, [3] * 2000), (100, [1, 99, 100, 101, 50, 51, 34, 33, 200])])
def test_classes_take_a_fixed_number_whole(capacity, lengths):
    bins = packing.Bins(capacity, 0)
    rows = [r for i, n in enumerate(lengths) for r in bins.add(i, np.arange(n, dtype="<u4"))]
    held = {k: len(v) for k, v in bins.waiting.items()}
    assert all(n < k or k == packing.CLASSES for k, n in held.items())
    rows += bins.rest()
    got = collections.defaultdict(list)
    for doc, start, length, crc, n, seq, offset in rows:
        assert n == lengths[doc] and crc == zlib.crc32(np.arange(start, start + length, dtype="<u4").tobytes())
        got[seq].append((offset, length))
    assert sum(r[2] for r in rows) == sum(lengths)
    fill = sorted(sum(length for _, length in own) for own in got.values())
    assert all(f <= capacity for f in fill) and len(fill) <= math.ceil(sum(lengths) / capacity * (1 + 1 / packing.GAPS)) + 1


@pytest.mark.parametrize("capacity", [1, 16, 1000, 2048])
def test_packing_edges(frame, capacity):
    rows = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "hello"), (4, "word " * 5000), (5, "字<|endoftext|>")]
    check_packing(packing.pack_documents(frame(rows), capacity=capacity).collect(), [(r[0], r[1] or "") for r in rows], capacity)
    assert packing.pack_documents(frame(rows).limit(0)).count() == 0


def test_other_vocabularies(frame):
    import sentencepiece

    texts = ["Hello world <|endoftext|>", "é 字", "", "word " * 9000]
    docs = frame(list(enumerate(texts)))
    pieces = sentencepiece.SentencePieceProcessor(model_file=tokens.tokenizer_path("piece_bpe_32k.model"))
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(docs, tokenizer="piece_bpe_32k.model").collect()}
    assert got == {i: len(pieces.encode(t)) for i, t in enumerate(texts)}
    words = tokens.load(tokens.tokenizer_path("word_bpe_49k.json"))
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(docs, tokenizer="word_bpe_49k.json").collect()}
    assert got == {i: len(words.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
