"""Token counts and ids of whole texts, huge ones in overlapping chunks that are spliced at proven boundaries."""

from __future__ import annotations

import base64
import bisect
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pick, rows_of, small_batches, trimmed

#: Texts beyond CHUNK characters are encoded in chunks; neighbours overlap by OVERLAP characters at first.
CHUNK, OVERLAP = 32_768, 512
BYTE_BPE = "byte_bpe_50k.json"
#: tiktoken is used for texts below this code point and without longer runs than PLAIN_RUN; tests hold both libraries against each other there.
PLAIN_TO, PLAIN_RUN = 0x250, 2000
_ODD = re.compile(rf"[^\x00-{chr(PLAIN_TO - 1)}]|\S{{{PLAIN_RUN}}}|\s{{{PLAIN_RUN}}}")


def tokenizer_path(name: str) -> str:
    """The vocabulary file of that name, or name itself if it is a path."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def load(path: str):
    """A tokenizers.Tokenizer without truncation and padding, on one thread; one a worker process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def boundaries(encoding, base: int) -> dict[int, int]:
    """Character position -> index of the token, where a pre-token starts.

    Pre-tokenization scans from left to right and keeps no state, so two encodings that
    both start a pre-token at a position agree on all that follows, as far as both see the
    same text. Byte-level tokens may share a character; a pre-token never starts inside one.
    """
    words, offsets = encoding.word_ids, encoding.offsets
    return {base + offsets[i][0]: i for i in range(len(words)) if words[i] is None or i == 0 or words[i] != words[i - 1]}


def reliable_end(encoding, base: int, margin: int) -> int:
    """Boundaries up to here can't change when the text goes on: the last two pre-tokens and `margin` characters are left off.

    The last pre-token may grow, the one before it may be white space that would give a
    character to it, and `margin` covers a special string cut in two.
    """
    words, offsets = encoding.word_ids, encoding.offsets
    i, seen, last = len(words) - 1, 0, object()
    while i >= 0:
        if words[i] is None or words[i] != last:
            seen, last = seen + 1, words[i]
        if seen > 2:
            return min(base + offsets[i][1], base + offsets[-1][1] - margin)
        i -= 1
    return base


def encode_whole(tok, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """The ids of tok.encode(text, add_special_tokens=False), in memory for one chunk at a time.

    Neighbouring chunks share `overlap` characters. The splice is at a position where both
    start a pre-token and the left one is reliable. Where there is none, the right chunk
    starts earlier by twice the overlap, and where it would start before the left one, the
    left one is made longer; a text without any boundary is encoded whole in the end.
    """
    if len(text) <= chunk:
        return tok.encode(text, add_special_tokens=False).ids
    margin = max([0, *(len(t.content) for t in tok.get_added_tokens_decoder().values())])
    out: list[int] = []
    start, size = 0, chunk  # the left chunk starts at a proven boundary
    while True:
        end = min(len(text), start + size)
        left = tok.encode(text[start:end], add_special_tokens=False)
        if end == len(text):
            return out + left.ids
        mine, safe = boundaries(left, start), reliable_end(left, start, margin)
        inside = sorted(p for p in mine if start < p <= safe)
        at, back = None, overlap
        while at is None and inside and back < size:
            lo = end - back
            right = boundaries(tok.encode(text[lo : end + margin], add_special_tokens=False), lo)
            at = next((p for p in reversed(inside[bisect.bisect_right(inside, lo) :]) if p in right), None)
            back *= 2
        if at is None:
            size *= 2
            continue
        out += left.ids[: mine[at]]
        start, size = at, chunk


def encoder(name: str, most: int | None = None, chunk: int = CHUNK):
    """text -> ids of the tokenizer file `name`.

    For the byte-level vocabulary that comes in both forms, plain texts of up to `most`
    characters take tiktoken, three times as fast; all others take the tokenizers library, huge
    ones in chunks. A .model file takes sentencepiece, each text whole.
    """
    if name.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        pieces = SentencePieceProcessor(model_file=tokenizer_path(name))
        return lambda text: pieces.encode(text, num_threads=1) if text else []
    tok = lambda: load(tokenizer_path(name))  # noqa: E731  loaded when first needed
    if name != BYTE_BPE:
        return lambda text: encode_whole(tok(), text, chunk)
    import public_tokenizers
    import tiktoken

    with open(tokenizer_path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(tokenizer_path(name), encoding="utf-8") as f:
        special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    fast = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: encode_whole(tok(), text, chunk) if (most and len(text) > most) or _ODD.search(text) else fast.encode(text, allowed_special="all")


def count_tokens(docs: DataFrame, *, tokenizer: str = BYTE_BPE, limit: int = 1024, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of every whole text.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows, null ids and other columns
    change nothing; an empty table gives no rows. One narrow pass without a shuffle. The
    vocabulary is read on each worker from `tokenizer`, a path or a public tokenizer's name.
    """
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, chunk, chunk)
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                texts = [t or "" for t in part.column("text").to_pylist()]
                n = [len(encode(t)) for t in texts]
                sizes = [len(t.encode()) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return pick(docs, doc_id="doc_id", text="text").mapInArrow(trimmed(count), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def ids_in_batch(docs: Iterator[pa.RecordBatch], encode) -> Iterator[tuple]:
    for doc_id, text in rows_of(docs, "doc_id", "text"):
        yield doc_id, encode(text or "")
