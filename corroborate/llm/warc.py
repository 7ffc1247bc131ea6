"""WARC archives: a writer with revisit records, and a reader that splits gzip archives by byte ranges."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroborate.llm.common import query, table
from corroborate.session import checkpoint_dir, stage

#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC = b"\x1f\x8b\x08"
_END = b"\r\n\r\n"
_WINDOW = 1 << 20
_FEED = 1 << 16
_ROLL = 1 << 29
_BATCH = 1 << 22

RECORDS = "path string, at long, record_type string, record_id string, target_uri string, refers_to string, payload_bytes long, payload_digest string, payload binary"
_SCHEMA = pa.schema([("path", pa.string()), ("at", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def encode_record(record_id: str, uri: str | None, payload: bytes, payload_digest: str, refers_to: str | None, date: str) -> bytes:
    """One gzip member: a response, or where ``refers_to`` is given a revisit without the payload but with its length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to else http + payload
    fields = [("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date)]
    if uri is not None:
        fields.append(("WARC-Target-URI", quote(uri, safe="!#$%&'()*+,/:;=?@[]~")))
    fields.append(("WARC-Payload-Digest", f"sha1:{payload_digest}"))
    if refers_to:
        fields += [("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", PROFILE)]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    head = VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + b"\r\n"
    gzip = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gzip.compress(head + block + _END) + gzip.flush()


def mark_revisits(pages: DataFrame, id_col: str, payload: Column, least: int = 0) -> DataFrame:
    """``pages`` with ``_payload``, ``_sha1`` and ``_first``: the smallest id with the same payload, null for that row and for single ones.

    Payloads under ``least`` bytes are never compared. Digests are counted
    within tasks before the shuffle; only those found twice are joined back, so
    Spark can split the rows of a hot payload.
    """
    rows = pages.withColumn("_payload", payload).withColumn("_sha1", F.sha1("_payload"))
    repeated = rows.where(F.length("_payload") >= least).groupBy("_sha1").agg(F.min(id_col).alias("_low"), F.count("*").alias("_n")).where("_n > 1 and _low is not null")
    joined = rows.join(stage(repeated.select(F.col("_sha1").alias("_key"), "_low"), "revisits"), F.col("_sha1") == F.col("_key"), "left")
    first = F.when(~F.col(id_col).eqNullSafe(F.col("_low")), F.col("_low"))
    return joined.select(*pages.columns, "_payload", "_sha1", first.alias("_first"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row into gzip archives under ``folder``, a new name per task; returns their ``(path, bytes)``.

    Only the returned files count: what a failed or doubled task left behind is
    in no row. ``folder`` must be reachable from all executors. Null html is an
    empty payload, a null address gives no target, a null id is written as
    ``null``. Rows alike in id and payload are responses all.
    """
    rows = mark_revisits(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")), "id", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")), least)

    def name(value) -> str:
        return f"urn:page:{'null' if value is None else value}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = _open(folder)
        system.create_dir(top, recursive=True)
        out = path = None
        size = 0

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([f"{folder.rstrip('/')}/{path}"]), pa.array([size], pa.int64())], names=["path", "bytes"])

        for batch in batches:
            for k in range(batch.num_rows):
                page, url, body, sha, first = (c[k].as_py() for c in batch.columns)
                if out is None:
                    path, size = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{top}/{path}", compression=None)
                hashed = base64.b32encode(bytes.fromhex(sha)).decode()
                member = encode_record(name(page), url, body, hashed, None if first is None else name(first), date)
                out.write(member)
                size += len(member)
                if size >= _ROLL:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return rows.select("id", "url", "_payload", "_sha1", "_first").mapInArrow(run, "path string, bytes long")


class Ranges:
    """Reads an archive from any place; members are decoded one after the other."""

    def __init__(self, path: str):
        system, self.at = _open(path)
        self.file = system.open_input_file(self.at)
        self.size = self.file.size()

    def read(self, start: int, length: int) -> bytes:
        return self.file.read_at(min(length, max(0, self.size - start)), start)

    def members(self, start: int) -> Iterator[tuple[bytes, int]]:
        """Decoded pieces from ``start`` on, with the end of the member once it is reached, else -1; stops at what is no member."""
        while start < self.size:
            gzip, at = zlib.decompressobj(31), start
            while not gzip.eof:
                fed = self.read(at, _FEED)
                if not fed:
                    return
                at += len(fed)
                try:
                    piece = gzip.decompress(fed)
                except zlib.error:
                    return
                end = at - len(gzip.unused_data) if gzip.eof else -1
                yield piece, end
            start = end

    def record(self, start: int) -> tuple[dict[str, str], bytes, int] | None:
        """Fields, block and end of the record whose first member starts here; None if none does.

        The decoded member must begin as a record, its block must be whole, and
        what follows it must be a member or the end of the file.
        """
        data = bytearray()
        head, length, fields = -1, 0, {}
        for piece, end in self.members(start):
            data += piece
            if len(data) >= 5 and not data.startswith(b"WARC/"):
                return None
            if head < 0 and (head := data.find(_END)) >= 0:
                for line in bytes(data[:head]).split(b"\r\n")[1:]:
                    key, _, value = line.partition(b":")
                    fields[key.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
                if not fields.get("content-length", "").isdigit():
                    return None
                length = int(fields["content-length"])
            if head >= 0 and len(data) >= head + 4 + length and end >= 0:
                if end < self.size and self.read(end, 3) != MAGIC:
                    return None
                return fields, bytes(data[head + 4 : head + 4 + length]), end
        return None

    def owned(self, start: int, stop: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
        """Records that start in ``[start, stop)``: candidates are the places of the gzip magic."""
        at, stop = start, min(stop, self.size)
        while at < stop:
            window = self.read(at, min(_WINDOW, stop - at) + len(MAGIC) - 1)
            found = window.find(MAGIC)
            if found < 0:
                at += max(1, len(window) - len(MAGIC) + 1)
                continue
            record = self.record(at + found)
            if record is None:
                at += found + 1
                continue
            yield at + found, record[0], record[1]
            at = record[2]


def _payload(fields: dict[str, str], block: bytes) -> tuple[bytes, int]:
    """Payload of a record and the length of the full one, which a revisit has in its HTTP header."""
    if not fields.get("content-type", "").startswith("application/http"):
        return block, len(block)
    head, _, body = block.partition(_END)
    if fields.get("warc-type") != "revisit":
        return body, len(body)
    length = re.search(rb"(?i)\r\nContent-Length:\s*(\d+)", head)
    return body, int(length[1]) if length else 0


def read_archives(files: DataFrame, split: int = 1 << 26, payloads: bool = True, tasks: int = 100_000) -> DataFrame:
    """Records of the archives in ``files(path, bytes)``; see ``RECORDS`` for the columns.

    A task takes a byte range, looks for the gzip magic, takes a place for a
    record's start only if a WARC header can be decoded there, and owns the
    records that start in its range, reading on beyond its end for the last. So
    any split gives each record once. The digest of a response is computed from
    its payload; that of a revisit is the one it carries.

    Ranges are dealt to a task each, up to ``tasks``: their rows are tiny, so
    Spark would else read any number of bytes in one task. An empty file has no
    record.
    """
    ranges = files.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split).cast("long"))).alias("start"))
    number = files.agg(F.sum(F.ceil(F.col("bytes") / split))).first()[0] or 1
    ranges = ranges.repartition(min(tasks, int(number)))

    def bare(value: str | None) -> str | None:
        return None if value is None else value.strip("<>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for at, fields, block in Ranges(path).owned(start, start + split):
                    body, length = _payload(fields, block)
                    kind = fields.get("warc-type")
                    hashed = fields.get("warc-payload-digest", "").rpartition(":")[2] or None
                    if kind == "response":
                        hashed = digest(body)
                    rows.append((path, at, kind, bare(fields.get("warc-record-id")), bare(fields.get("warc-target-uri")), bare(fields.get("warc-refers-to")), length, hashed, body if payloads and kind != "revisit" else None))
                    held += len(body) + 500
                    if held > _BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)

    return ranges.select("path", "start").mapInArrow(run, RECORDS)


#: Base 32 in SQL: five bits of the digest at a time, from its bits as text.
WARC_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
f AS (SELECT payload, min(page_id) AS low, sha1(payload) AS hex FROM p GROUP BY payload),
d AS (
    SELECT payload, low, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(substr(bits, 5 * i + 1, 5)::BIT::INT AS INT), 1), '' ORDER BY i) AS payload_digest
    FROM (SELECT payload, low, from_hex(hex)::BIT::VARCHAR AS bits, unnest(range(32)) AS i FROM f) GROUP BY payload, low)
SELECT page_id, octet_length(p.payload)::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN low <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN low <> page_id THEN low END AS refers_to
FROM p JOIN d USING (payload)
"""


@query("op6_warc", WARC_SQL)
def op6_warc(spark, sf_dir):
    folder = f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    files = stage(write_archives(table(spark, sf_dir, "pages"), folder), "warc-files")
    found = read_archives(files, payloads=False)
    page = F.regexp_extract("record_id", r"(-?\d+)$", 1)
    other = F.regexp_extract("refers_to", r"(-?\d+)$", 1)
    return found.select(
        F.when(page != "", page.cast("long")).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.when(other != "", other.cast("long")).alias("refers_to"),
    )
