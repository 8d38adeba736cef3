"""WARC records in Zstandard archives: a dictionary in a leading skippable frame, then one frame a record."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, pick, rows_of

#: Magic of the skippable frame that holds a dictionary, of other skippable frames (the low 4 bits vary), and of a frame.
DICT_MAGIC, SKIP_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0x184D2A50, 0xFD2FB528
SUFFIX = ".warc.zst"
#: An archive is closed beyond ARCHIVE_BYTES; its dictionary has DICT_BYTES at most and is trained on the archive's first SAMPLES payloads.
ARCHIVE_BYTES, DICT_BYTES, SAMPLES, SAMPLE_BYTES = 8 << 20, 16 << 10, 200, 4 << 10
#: Keys that the pages of one payload are spread over.
SALTS = 16
DATE = "2024-01-01T00:00:00Z"


class BadRecord(ValueError):
    """A frame or record that isn't what the format asks for."""


# --- writing


def record_bytes(record_id: str, url: str, kind: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A response with its payload, or a revisit: the HTTP header alone, which tells the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{record_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def trained(samples: list[bytes]) -> bytes:
    """A dictionary from the samples; b"" if they are too few or too plain for one."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, [s[:SAMPLE_BYTES] for s in samples if s]).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def archive_bytes(records: list[bytes], dictionary: bytes, level: int = 3) -> bytes:
    """A whole archive."""
    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    c = zstandard.ZstdCompressor(level=level, dict_data=data, write_checksum=True, write_content_size=True)
    head = struct.pack("<II", DICT_MAGIC, len(dictionary)) + dictionary if dictionary else b""
    return head + b"".join(map(c.compress, records))


def plan_records(pages: DataFrame, *, least: int = 0) -> DataFrame:
    """page_id, url, html, digest (SHA-1, hex), refers_to: null for a response, else the smallest page_id with an equal payload of at least `least` bytes.

    Only ids and digests are grouped and joined; the pages are dealt by (page_id, digest),
    which is even whatever the groups of copies. Rows that share the smallest id are all
    responses; a null html is an empty payload; very long pages are records like others. An empty
    table gives no rows.
    """
    p = pick(pages, page_id="page_id", url="url", html="html").withColumn("digest", F.sha1(F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))))
    ids = p.where(F.coalesce(F.octet_length("html"), F.lit(0)) >= least).select("page_id", "digest")
    first = ids.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # one payload may be that of a third of all pages, so its pages are spread over SALTS keys
    salted = ids.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    later = salted.join(first, ["digest", "salt"]).where("page_id > first").select(F.col("page_id").alias("i"), F.col("digest").alias("d"), F.col("first").alias("refers_to")).distinct()
    return p.join(later, (F.col("page_id") == F.col("i")) & (F.col("digest") == F.col("d")), "left").drop("i", "d")


class Archive:
    """A folder of archives and the list of those that belong to it (files of lost attempts don't)."""

    def __init__(self, path: str, files: DataFrame, n_files: int):
        self.path, self.files, self.n_files = path, files, n_files


def write_archives(records: DataFrame, path: str | None = None, *, archive_size: int = ARCHIVE_BYTES) -> Archive:
    """Writes page_id, url, html, digest, refers_to as archives to a folder that all machines share.

    Each task streams its rows into files named after itself and the attempt, and Spark's own
    commit of the list of files decides which attempt counts. An archive is one buffer of
    about archive_size in memory, or of one record where that is longer. No rows give no archive.
    The folder's URI must be of a file system that pyarrow knows (local, HDFS, S3, GCS).
    """
    spark = records.sparkSession
    path = path or new_path(spark, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pafs.FileSystem.from_uri(path)
        attempt, made = uuid.uuid4().hex, []
        held: list[bytes] = []
        samples: list[bytes] = []
        size = 0

        def close() -> None:
            name = f"{attempt}-{len(made):05d}{SUFFIX}"
            data = archive_bytes(held, trained(samples))
            fs.create_dir(folder, recursive=True)
            with fs.open_output_stream(f"{folder}/{name}", compression=None) as f:
                f.write(data)
            made.append((name, len(held), len(data)))
            held.clear()
            samples.clear()

        for page_id, url, html, digest, refers_to in rows_of(batches, "page_id", "url", "html", "digest", "refers_to"):
            payload = (html or "").encode()
            sha = base64.b32encode(bytes.fromhex(digest)).decode()
            uri = " ".join((url or "").split())
            held.append(record_bytes("" if page_id is None else str(page_id), uri, "response" if refers_to is None else "revisit", payload, sha, refers_to))
            if len(samples) < SAMPLES:
                samples.append(held[-1])
            size += len(held[-1])
            if size >= archive_size:
                close()
                size = 0
        if held:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64())], ["name", "n_records", "n_bytes"])

    listing = f"{path}.files"
    schema = "name string, n_records long, n_bytes long"
    records.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(write, schema).write.parquet(listing)
    files = spark.read.schema(schema).parquet(listing)
    return Archive(path, files, files.count())


# --- reading


def skippable(data: memoryview, at: int) -> tuple[int, memoryview] | None:
    """(magic, content) if a skippable frame starts here."""
    if at + 8 > len(data):
        raise BadRecord("the archive ends inside a frame's header")
    magic, length = struct.unpack_from("<II", data, at)
    if magic & 0xFFFFFFF0 != SKIP_MAGIC:
        return None
    if at + 8 + length > len(data):
        raise BadRecord("a skippable frame is cut off")
    return magic, data[at + 8 : at + 8 + length]


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame at `at` ends, from its header and its blocks' headers."""
    if bytes(data[at : at + 4]) != struct.pack("<I", FRAME_MAGIC):
        raise BadRecord("no frame where one should start")
    try:
        flags = data[at + 4]
        single = flags >> 5 & 1
        size_bytes = (1 if single else 0, 2, 4, 8)[flags >> 6]
        pos = at + 5 + (0 if single else 1) + (0, 1, 2, 4)[flags & 3] + size_bytes
        while True:
            block = data[pos] | data[pos + 1] << 8 | data[pos + 2] << 16
            pos += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
            if block & 1:
                break
    except IndexError:
        raise BadRecord("a frame is cut off") from None
    pos += 4 * (flags >> 2 & 1)
    if pos > len(data):
        raise BadRecord("a frame is cut off")
    return pos


def parse_record(raw: bytes) -> dict:
    """The record of one frame; BadRecord where a header is missing or a length or digest is off."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not sep or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise BadRecord("no WARC version line or no end of the header")
    h = {}
    for line in lines[1:]:
        k, colon, v = line.partition(b":")
        if not colon:
            raise BadRecord(f"a header line without a colon: {line[:40]!r}")
        h[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
    for k in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if k not in h:
            raise BadRecord(f"no {k}")
    if not h["content-length"].isdigit() or len(rest) != int(h["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise BadRecord("Content-Length isn't the block's length")
    kind, block = h["warc-type"], rest[:-4]
    out = {"record_id": named(h["warc-record-id"]), "record_type": kind, "url": h.get("warc-target-uri"), "refers_to": None, "payload": None, "payload_length": None, "payload_digest": h.get("warc-payload-digest", "").removeprefix("sha1:") or None}
    if kind not in ("response", "revisit"):
        return out | {"payload": block, "payload_length": len(block)}
    http, sep, payload = block.partition(b"\r\n\r\n")
    told = [x.split(b":", 1)[1].strip() for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")]
    if not sep or len(told) != 1 or not told[0].isdigit():
        raise BadRecord("the HTTP header has no end or no single Content-Length")
    if kind == "revisit":
        if payload or "warc-refers-to" not in h:
            raise BadRecord("a revisit with a payload or without WARC-Refers-To")
        return out | {"refers_to": named(h["warc-refers-to"]), "payload_length": int(told[0])}
    if len(payload) != int(told[0]):
        raise BadRecord("the payload isn't as long as its HTTP header tells")
    if base64.b32encode(hashlib.sha1(payload).digest()).decode() != out["payload_digest"]:
        raise BadRecord("the payload's digest is another")
    return out | {"payload": payload, "payload_length": len(payload)}


def named(uri: str) -> str | None:
    return uri.strip("<>").removeprefix("urn:page:") or None


def archive_records(data: bytes, most: int | None = None) -> Iterator[dict]:
    """The records of an archive, one in memory at a time; a bad one comes as {"offset", "error"}, and the next frame follows. A record beyond `most` bytes is a bad one, if that is given."""
    view, at, dictionary = memoryview(data).cast("B"), 0, None
    try:
        lead = skippable(view, 0) if len(data) else None
    except BadRecord as e:
        yield {"offset": 0, "error": str(e)}
        return
    if lead:
        if lead[0] == DICT_MAGIC and len(lead[1]):
            content = bytes(lead[1])
            if content[:4] == struct.pack("<I", FRAME_MAGIC):
                content = zstandard.ZstdDecompressor().decompress(content)
            dictionary = zstandard.ZstdCompressionDict(content)
    d = zstandard.ZstdDecompressor(dict_data=dictionary, max_window_size=1 << 27)
    while at < len(data):
        try:
            if lead := skippable(view, at):
                at += 8 + len(lead[1])
                continue
            end = frame_end(view, at)
        except BadRecord as e:
            yield {"offset": at, "error": str(e)}
            return
        try:
            size = zstandard.frame_content_size(view[at:end])
            if most is not None and size > most:
                raise BadRecord("a record is longer than allowed")
            raw = d.decompress(view[at:end]) if size >= 0 else d.decompressobj().decompress(view[at:end])
            yield parse_record(raw) | {"offset": at, "error": None}
        except (BadRecord, zstandard.ZstdError) as e:
            yield {"offset": at, "error": str(e)}
        at = end


RECORD = "archive string, offset long, record_id string, record_type string, url string, payload_length long, payload_digest string, refers_to string, payload binary, error string"


def read_archives(spark: SparkSession, archive: Archive | str, *, payload: bool = False, strict: bool = True) -> DataFrame:
    """A row for each record: archive, offset, record_id, record_type, url, payload_length, payload_digest, refers_to, payload, error.

    Spark's binaryFile source reads the archives from any store. strict: a bad record ends the
    query; else its row has the error and nulls. payload: whether to return payloads too.
    An archive without records, or a folder without archives, gives no rows.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [c.split() for c in RECORD.split(", ")]
        schema = pa.schema([(n, {"long": pa.int64(), "binary": pa.binary()}.get(t, pa.string())) for n, t in fields])
        for b in batches:
            for i in range(b.num_rows):
                name, rows, size = b.column("path")[i].as_py(), [], 0
                for r in archive_records(b.column("content")[i].as_buffer()):
                    if strict and r["error"]:
                        raise BadRecord(f"{name} at {r['offset']}: {r['error']}")
                    r["archive"] = name
                    if not payload:
                        r["payload"] = None
                    rows.append(r)
                    size += len(r.get("payload") or b"")
                    if len(rows) >= 5000 or size >= 16 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    path = archive if isinstance(archive, str) else archive.path
    if isinstance(archive, Archive) and not archive.n_files:
        return spark.createDataFrame([], RECORD)
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").load(path).select("path", "content")
    if isinstance(archive, Archive):
        names = archive.files.select("name")
        names = F.broadcast(names) if archive.n_files <= 50_000 else names
        files = files.join(names, F.element_at(F.split("path", "/"), -1) == F.col("name"), "left_semi")
    return files.mapInArrow(read, RECORD)
