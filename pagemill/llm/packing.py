"""Harmonic packing of token ids into sequences of a fixed capacity."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import pick, small_batches, trimmed
from .tokens import BYTE_BPE, encoder, ids_in_batch

END = 1
#: Remainders up to capacity / CLASSES are one class, packed one after another. Gaps below capacity / GAPS are left as padding, and OPEN bins with a larger one wait for what fits.
CLASSES, GAPS, OPEN = 16, 128, 32
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Piece(NamedTuple):
    doc_id: int | None
    start: int
    ids: np.ndarray
    doc_tokens: int


class Bins:
    """The bins of one worker.

    A remainder of length n is of class k = capacity // n, so capacity / (k + 1) < n <= capacity / k,
    and a bin of class k takes k of them, whole. What a bin has left waits for documents that fit
    whole, the closest first. Cut are documents beyond the capacity, and one that comes while
    OPEN bins wait: its first part fills the largest gap. At most k - 1 remainders of class k wait.
    """

    def __init__(self, capacity: int, worker: int):
        if capacity < 1:
            raise ValueError("the capacity must be positive")
        self.capacity, self.next = capacity, worker << 40
        self.waiting: dict[int, list[Piece]] = {}
        self.open: list[tuple[int, list[Piece]]] = []  # gaps and bins, by gap

    def close(self, pieces: list[Piece]) -> list[tuple]:
        at, out = 0, []
        for p in pieces:
            out.append((p.doc_id, p.start, len(p.ids), zlib.crc32(p.ids.tobytes()), p.doc_tokens, self.next, at))
            at += len(p.ids)
        self.next += 1
        return out

    def keep(self, gap: int, pieces: list[Piece]) -> list[tuple]:
        """A bin with that much left: open, or closed if it's too little."""
        if gap * GAPS < self.capacity:
            return self.close(pieces)
        bisect.insort(self.open, (gap, pieces), key=lambda o: o[0])
        return []

    def add(self, doc_id: int | None, ids: np.ndarray) -> list[tuple]:
        """The rows of all bins that this document closes."""
        out, at, n = [], 0, len(ids)
        take = lambda k: Piece(doc_id, at, ids[at : at + k], n)
        if self.open and (n > self.capacity or len(self.open) >= OPEN) and self.open[-1][0] < n:
            gap, pieces = self.open.pop()
            out += self.close([*pieces, take(gap)])
            at = gap
        while n - at >= self.capacity:
            out += self.close([take(self.capacity)])
            at += self.capacity
        return out + self.put(take(n - at)) if at < n else out

    def put(self, piece: Piece) -> list[tuple]:
        n = len(piece.ids)
        if (i := bisect.bisect_left(self.open, n, key=lambda o: o[0])) < len(self.open):
            gap, pieces = self.open.pop(i)
            return self.keep(gap - n, [*pieces, piece])
        k = min(self.capacity // n, CLASSES)
        held = self.waiting.setdefault(k, [])
        held.append(piece)
        gap = self.capacity - sum(len(p.ids) for p in held)
        if (len(held) < k) if k < CLASSES else (gap * CLASSES >= self.capacity):
            return []
        return self.keep(gap, self.waiting.pop(k))

    def rest(self) -> list[tuple]:
        """What still waits, one after another, cut where a sequence ends."""
        left = [p for _, held in sorted(self.waiting.items()) for p in held] + [p for _, held in self.open for p in held]
        out, now, room = [], [], self.capacity
        for p in left:
            while len(p.ids):
                now.append(p._replace(ids=p.ids[:room]))
                p = p._replace(start=p.start + len(now[-1].ids), ids=p.ids[room:])
                room -= len(now[-1].ids)
                if not room:
                    out += self.close(now)
                    now, room = [], self.capacity
        self.waiting, self.open = {}, []
        return out + self.close(now) if now else out


def pack_documents(docs: DataFrame, *, capacity: int = 2048, tokenizer: str = BYTE_BPE, end: int = END) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's full stretches of `capacity` ids are sequences of their own; what remains is
    packed whole by harmonic classes, and seldom cut, to fill a gap. Each task packs its own
    rows with its own bins (no shuffle, no state between workers; memory: less than one open
    bin a class, OPEN bins and one document's ids), and lays what still waits at its end one after another,
    so a task leaves one short sequence at most. sequence_id has the task's number in its upper
    bits. A null or empty text is the end id alone; very long texts are cut into full sequences;
    repeated rows are packed as documents of their own; null ids stay null; other columns are
    ignored; an empty table gives no rows.
    """

    small_batches(docs.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, bins, rows = encoder(tokenizer), Bins(capacity, TaskContext.get().partitionId()), []

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            names = [c.split()[0] for c in PIECES.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

        for doc_id, ids in ids_in_batch(batches, encode):
            rows += bins.add(doc_id, np.array([*ids, end], "<u4"))
            if len(rows) >= 20_000:
                yield batch(rows)
                rows = []
        if rows := rows + bins.rest():
            yield batch(rows)

    return pick(docs, doc_id="doc_id", text="text").mapInArrow(trimmed(pack), PIECES)
