import base64
import hashlib
import os
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from pagemill.llm import warc
from pagemill.llm.queries import op7_warc_roundtrip

SF = "/root/testdata/sf0.01"


def brute(pages):
    first = {}
    for i, h in pages:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, h in pages:
        b = (h or "").encode()
        f = first.get(h or "")
        again = i is not None and f is not None and i > f
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", f if again else None))
    return sorted(out, key=str)


def roundtrip(pages, **options):
    spark = pages.sparkSession
    rows = warc.read_archives(spark, warc.write_archives(warc.plan_records(pages), **options))
    return sorted(((None if r["record_id"] is None else int(r["record_id"]), r["payload_length"], r["payload_digest"], r["record_type"], None if r["refers_to"] is None else int(r["refers_to"])) for r in rows.collect()), key=str)


def test_whole_table(spark):
    pages = [(r["page_id"], r["html"]) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    got = sorted((tuple(r) for r in op7_warc_roundtrip(spark, SF).collect()), key=str)
    assert got == brute(pages)


def test_copies_nulls_empty_and_long_pages_in_small_archives(spark):
    pages = [(3, "a"), (1, "a"), (2, "a"), (5, None), (4, ""), (6, "é" * 200_000), (7, "\r\n\r\nWARC/1.1\r\n"), (None, "a"), (8, "b\0c")]
    pages += [(100 + i, f"<p>{i}</p>" * 50) for i in range(40)]
    df = spark.createDataFrame([(*p, "http://x/ y\n", "z") for p in pages], "page_id long, html string, url string, digest string")
    assert roundtrip(df, archive_size=4000) == brute(pages)
    assert roundtrip(df.limit(0)) == []
    twice = df.where("page_id IN (1, 2)").union(df.where("page_id = 1"))
    assert [r[3] for r in roundtrip(twice)] == ["response", "response", "revisit"]


def test_payloads_come_back_whole(spark):
    texts = {i: f"<html>{i} é</html>" * (i + 1) for i in range(30)}
    df = spark.createDataFrame(list(texts.items()), "page_id long, html string").withColumn("url", F.lit(None).cast("string"))
    rows = warc.read_archives(spark, warc.write_archives(warc.plan_records(df)), payload=True).collect()
    assert {int(r["record_id"]): bytes(r["payload"]).decode() for r in rows} == texts


RECORDS = [warc.record_bytes(str(i), "http://x/", "response", b"p" * i, base64.b32encode(hashlib.sha1(b"p" * i).digest()).decode(), None) for i in range(30)]


@pytest.mark.parametrize("size", [0, 50, 70_000, 300_000])
def test_frames_of_all_sizes(size):
    body = os.urandom(size) + b"a" * size
    sha = base64.b32encode(hashlib.sha1(body).digest()).decode()
    data = warc.archive_bytes([warc.record_bytes("1", "u", "response", body, sha, None), RECORDS[3]], b"")
    got = list(warc.archive_records(data))
    assert [r["payload_length"] for r in got] == [size * 2, 3] and got[0]["payload"] == body


def test_dictionary_plain_or_compressed_and_other_skippable_frames():
    d = warc.trained([r * 3 for r in RECORDS] * 10)
    assert d
    data = warc.archive_bytes(RECORDS, d)
    assert data[:4] == struct.pack("<I", 0x184D2A5D)
    assert [r["payload_length"] for r in warc.archive_records(data)] == list(range(30))
    packed = zstandard.ZstdCompressor().compress(d)
    body = data[8 + len(d) :]
    note = struct.pack("<II", 0x184D2A50, 3) + b"abc"
    again = struct.pack("<II", 0x184D2A5D, len(packed)) + packed + note + body + note
    assert [r["error"] for r in warc.archive_records(again)] == [None] * 30


@pytest.mark.parametrize(
    "change",
    [
        lambda r: r.replace(b"WARC/1.1", b"WARC/9.9"),
        lambda r: r.replace(b"WARC-Date", b"X-Date"),
        lambda r: r.replace(b"WARC-Record-ID", b"X"),
        lambda r: r.replace(b"ppp", b"pqp"),
        lambda r: r[:-2],
        lambda r: r + b"x",
        lambda r: r.replace(b"http;msgtype=response\r\nContent-Length: ", b"http\r\nContent-Length: 1"),
        lambda r: r.replace(b"utf-8\r\nContent-Length: ", b"utf-8\r\nContent-Length: 1"),
        lambda r: b"",
    ],
)
def test_bad_records_are_told_and_the_next_one_is_read(change):
    got = list(warc.archive_records(warc.archive_bytes([change(RECORDS[5]), RECORDS[6]], b"")))
    assert got[0]["error"] and got[1]["error"] is None and got[1]["payload_length"] == 6


def test_cut_archives():
    data = warc.archive_bytes(RECORDS[:3], b"")
    for cut in (len(data) - 1, len(data) - 60, 3):
        assert list(warc.archive_records(data[:cut]))[-1]["error"]
    assert list(warc.archive_records(b"")) == []


def test_strict_reading_ends_the_query(spark, tmp_path):
    (tmp_path / "a.warc.zst").write_bytes(warc.archive_bytes([RECORDS[1], b"junk"], b""))
    assert [bool(r["error"]) for r in warc.read_archives(spark, str(tmp_path), strict=False).collect()] == [False, True]
    with pytest.raises(Exception, match="no WARC version"):
        warc.read_archives(spark, str(tmp_path)).collect()
