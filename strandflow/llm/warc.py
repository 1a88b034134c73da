"""WARC archives with per-archive Zstandard dictionaries, and a reader for them.

Each archive starts with a skippable frame that holds its dictionary, built from the archive's first HELD_BYTES of records; then each
record is one independent Zstandard frame, so a reader can start at any record given its offset. A writer task
holds those first records (or one larger record) and streams the others until the archive has ARCHIVE_BYTES of them. Files get unique
names; only names that committed tasks returned are read, so retried or speculative tasks leave unread files at most.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, staged, table

ARCHIVE_BYTES, HELD_BYTES, DICTIONARY_BYTES, SAMPLE_BYTES, SAMPLE_PIECE, LEVEL = 1 << 30, 12 << 20, 64 << 10, 4 << 20, 128 << 10, 3
DICTIONARY_MAGIC = 0x184D2A5D
LEAST_REVISIT = 100
_ID = "urn:strandflow:record:"


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _header(fields: list[tuple[str, str]]) -> bytes:
    clean = ((k, v.replace("\r", "%0D").replace("\n", "%0A")) for k, v in fields)
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in clean) + "\r\n").encode()


def record_bytes(record_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit that names the record that has it."""
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{_ID}{record_id}>"), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if url is not None:
        fields.append(("WARC-Target-URI", url))
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<{_ID}{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(len(payload)))]
    block = http + payload if refers_to is None else http
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return _header(fields) + block + b"\r\n\r\n"


def build_dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary trained on whole records spread evenly over those given, about SAMPLE_BYTES of them in pieces of SAMPLE_PIECE. Where these are
    too few or too alike to train on, the records' own first bytes are the dictionary, so every archive has one."""
    step = max(1, sum(map(len, records)) // SAMPLE_BYTES)
    samples = [r[k : k + SAMPLE_PIECE] for r in records[::step] for k in range(0, len(r), SAMPLE_PIECE)]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 10)), samples)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(records)[:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def begin_archive(records: list[bytes]) -> tuple[bytes, zstandard.ZstdCompressor]:
    """The leading skippable frame, which holds the dictionary of the records, and the compressor for the archive's records."""
    d = build_dictionary(records)
    raw = d.as_bytes()
    return struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw, zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=True)


def read_archive(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of an open archive, one after another."""
    head = stream.read(8)
    d = None
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == DICTIONARY_MAGIC:
        d = zstandard.ZstdCompressionDict(stream.read(struct.unpack("<I", head[4:])[0]))
        head = b""

    class Rest:
        def read(self, n: int) -> bytes:
            nonlocal head
            out, head = head, b""
            return out + stream.read(max(0, n - len(out)))

    reader = zstandard.ZstdDecompressor(dict_data=d).stream_reader(Rest(), read_across_frames=True)
    buf = b""

    def fill(n: int) -> bool:
        nonlocal buf
        parts, have = [buf], len(buf)
        while have < n:
            got = reader.read(max(1 << 16, n - have))
            if not got:
                break
            parts.append(got)
            have += len(got)
        buf = b"".join(parts)
        return have >= n

    while True:
        while (at := buf.find(b"\r\n\r\n")) < 0:
            if not fill(len(buf) + 1):
                if buf:
                    raise ValueError("truncated record header")
                return
        lines = buf[:at].decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        n = int(fields["Content-Length"])
        if not fill(at + 4 + n + 4):
            raise ValueError("truncated record block")
        yield fields, buf[at + 4 : at + 4 + n]
        buf = buf[at + 8 + n :]


def mark_revisits(pages: DataFrame, key: str, html: str, least: int = LEAST_REVISIT) -> DataFrame:
    """pages with digest and refers_to: of rows with equal payloads of at least `least` bytes the smallest key is
    the response and the others refer to it. Only keys and digests are grouped; payloads move once, by key."""
    p = pages.select(F.col(key).alias("key"), "url", F.coalesce(html, F.lit("")).alias("html")).withColumn("digest", F.sha2("html", 256))
    keys = p.select("key", "digest", F.octet_length("html").alias("n")).where(F.col("n") >= least)
    firsts = keys.groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    again = keys.join(firsts, "digest").where("key <> first").select("key", "digest", F.col("first").alias("refers_to")).distinct()
    return p.join(again, ["key", "digest"], "left")


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_REVISIT, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record for each row of pages into archives under folder, of about archive_bytes of records or a task's; returns (path, records) of the archives.

    Repeated rows give a record each. Null html is an empty payload, a null url gives no target URI; a null key gives the record id `null`. Other columns are ignored."""
    named = pages.select(F.col(key), F.col(url).alias("url"), F.col(html).alias("html"))
    rows = mark_revisits(named, key, "html", least)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number, out, name, c = [], 0, 0, None, "", None

        def begin() -> None:
            nonlocal out, name, c
            fs, root = open_fs(folder)
            fs.create_dir(root, recursive=True)
            name = f"{uuid.uuid4().hex}.warc.zst"
            out = fs.open_output_stream(f"{root}/{name}", compression=None)
            frame, c = begin_archive(held)
            out.write(frame)
            for r in held:
                out.write(c.compress(r))
            held.clear()

        def end() -> pa.RecordBatch:
            nonlocal out, size, number
            if out is None:
                begin()
            out.close()
            done = pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([number], pa.int64())], names=["path", "records"])
            out, size, number = None, 0, 0
            return done

        for b in batches:
            cols = [b.column(b.schema.get_field_index(x)) for x in ("key", "url", "html", "digest", "refers_to")]
            for i in range(b.num_rows):
                k, u, text, digest, to = (x[i].as_py() for x in cols)
                r = record_bytes("null" if k is None else str(k), u, text.encode(), digest, None if to is None else str(to))
                size, number = size + len(r), number + 1
                if out is None:
                    held.append(r)
                    if size >= HELD_BYTES:
                        begin()
                else:
                    out.write(c.compress(r))
                if size >= archive_bytes:
                    yield end()
        if number:
            yield end()

    return staged(rows.select("key", "url", "html", "digest", "refers_to").mapInArrow(write, "path string, records long"), "archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """(record_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of each record of the archives.

    payload is null for revisits. The digest and size of a response are of the bytes read and must equal its header."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_id", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary())])
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, name = open_fs(path)
                rows, size = [], 0
                with fs.open_input_stream(name, compression=None) as f:
                    for fields, block in read_archive(f):
                        said, n = fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["X-Payload-Length"])
                        body = block[block.index(b"\r\n\r\n") + 4 :] if fields["WARC-Type"] == "response" else None
                        if body is not None and (hashlib.sha256(body).hexdigest() != said or len(body) != n):
                            raise ValueError(f"record {fields['WARC-Record-ID']} of {path} is damaged")
                        to = fields.get("WARC-Refers-To")
                        rows.append({"record_id": fields["WARC-Record-ID"][1 + len(_ID) : -1], "url": fields.get("WARC-Target-URI"), "payload_bytes": n, "payload_digest": said, "record_type": fields["WARC-Type"], "refers_to": to[1 + len(_ID) : -1] if to else None, "payload": body})
                        size += n
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    paths = archives.select("path").repartition(F.col("path"))
    return paths.mapInArrow(read, "record_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = read_archives(write_archives(table(spark, sf_dir, "pages"), new_path(spark, "warc")))
    return back.select(F.expr("try_cast(record_id as bigint)").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT *, CASE WHEN n >= {LEAST_REVISIT} THEN min(page_id) OVER (PARTITION BY digest) ELSE page_id END AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM f
"""
