"""WARC records in ZIP archives: a writer, and a reader that ranges into stored members.

Writing: each task packs its rows into archives. An archive is a ZIP file of
stored (uncompressed) members: `archive/data.warc.gz`, whose records are gzip
members of their own, `indexes/index.cdxj`, a line a record with its offset and
length in that member, and `datapackage.json`. It is written under a temporary
name and renamed, so a lost task leaves nothing that a reader lists.

Equal payloads (by SHA-256) of at least `least_bytes` are kept once: the record
with the largest page_id is a `response`, the others are `revisit` records that
name its page and carry headers only.

Reading: the end record and, if it points to one, the ZIP64 record are found by a
range read at the file's end; the central directory (with ZIP64 extra fields)
locates the members; the index member is range-read and gives a row a record;
records are then dealt to tasks, which range-read and inflate each by itself.
Nothing is extracted.

Files are reached by pyarrow's filesystem for the shared folder's URI.

Defined cases: null html is an empty payload; null url is an empty URI; a null
page_id is smaller than all others and is written as `-`; rows that repeat are
records of their own, responses if they have the largest page_id of their
payload; an empty table makes no archive.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize, workdir

ARCHIVE_BYTES = 32 << 20
#: A table of payloads that occur more than once is broadcast up to this many rows of about 100 bytes; of a larger one,
#: those that make up more than a share of 1 / HOT of its rows are, and the rest is joined by an exchange.
BROADCAST_ROWS, HOT = 50_000, 1_000
#: Adjacent records are fetched in one range read of about this size.
RANGE_BYTES = 1 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_DATE = "2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _number(page_id: int | None) -> str:
    return "-" if page_id is None else str(page_id)


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC/1.1 record; a revisit has the response's headers as its block."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{_number(page_id)}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {url.translate({13: '%0D', 10: '%0A'})}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{_number(refers_to)}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers and block of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length"))
    return {"headers": headers, "payload": payload, "payload_bytes": size}


class ArchiveWriter:
    """Builds one archive in memory; `add` returns the bytes so far."""

    def __init__(self):
        self.body, self.lines = io.BytesIO(), []

    def add(self, page_id, url: str, payload: bytes, refers_to, revisit: bool) -> int:
        at = self.body.tell()
        self.body.write(gzip.compress(record(page_id, url, payload, refers_to, revisit), 4, mtime=0))
        entry = {"url": url, "digest": "sha1:" + digest(payload), "offset": at, "length": self.body.tell() - at, "type": "revisit" if revisit else "response"}
        self.lines.append(f"{_number(page_id)} {json.dumps(entry)}")
        return self.body.tell()

    def finish(self) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            stamp = (2024, 1, 1, 0, 0, 0)
            z.writestr(zipfile.ZipInfo(DATA, stamp), self.body.getvalue())
            z.writestr(zipfile.ZipInfo(INDEX, stamp), "".join(x + "\n" for x in sorted(self.lines)))
            z.writestr(zipfile.ZipInfo("datapackage.json", stamp), json.dumps({"profile": "data-package", "resources": [{"path": DATA}, {"path": INDEX}]}))
        return out.getvalue()


class RangeFile:
    """Range reads of one file."""

    def __init__(self, uri: str):
        filesystem, path = pafs.FileSystem.from_uri(uri)
        self.file = filesystem.open_input_file(path)
        self.size = self.file.size()

    def read(self, at: int, n: int) -> bytes:
        return self.file.read_at(n, at)

    def close(self) -> None:
        self.file.close()


def directory(f) -> dict[str, tuple[int, int, int, int]]:
    """name -> (method, compressed size, size, local header's offset), from the central directory of a ZIP or ZIP64 file."""
    tail_size = min(f.size, 22 + 65_535)
    tail = f.read(f.size - tail_size, tail_size)
    end = len(tail) - 22
    while end >= 0 and not (tail[end : end + 4] == b"PK\5\6" and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] == len(tail)):
        end = tail.rfind(b"PK\5\6", 0, end + 3) if end > 0 else -1
    if end < 0:
        raise ValueError("no end of central directory")
    count, size, start = struct.unpack_from("<HII", tail, end + 10)
    locator_at = f.size - tail_size + end - 20
    if locator_at >= 0 and (locator := f.read(locator_at, 20))[:4] == b"PK\6\7":
        record_at = struct.unpack_from("<Q", locator, 8)[0]
        big = f.read(record_at, 56)
        if big[:4] != b"PK\6\6":
            raise ValueError("no ZIP64 end of central directory")
        count, size, start = struct.unpack_from("<QQQ", big, 32)
    listing, at, out = f.read(start, size), 0, {}
    for _ in range(count):
        if listing[at : at + 4] != b"PK\1\2":
            raise ValueError("damaged central directory")
        flags, method = struct.unpack_from("<HH", listing, at + 8)
        packed, full, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", listing, at + 20)
        offset = struct.unpack_from("<I", listing, at + 42)[0]
        name = listing[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, k = listing[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while k + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, k)
            if tag == 1:  # sizes and offset that don't fit in 32 bits, in this order
                p = k + 4
                if full == 0xFFFFFFFF:
                    full, p = struct.unpack_from("<Q", extra, p)[0], p + 8
                if packed == 0xFFFFFFFF:
                    packed, p = struct.unpack_from("<Q", extra, p)[0], p + 8
                if offset == 0xFFFFFFFF:
                    offset = struct.unpack_from("<Q", extra, p)[0]
            k += 4 + n
        out[name] = (method, packed, full, offset)
        at += 46 + n_name + n_extra + n_comment
    return out


def stored_range(f, entry: tuple[int, int, int, int]) -> tuple[int, int]:
    """(offset, size) of a stored member's bytes in the file."""
    method, packed, _, offset = entry
    if method != 0:
        raise ValueError("the member is not stored")
    head = f.read(offset, 30)
    if head[:4] != b"PK\3\4":
        raise ValueError("damaged local header")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    return offset + 30 + n_name + n_extra, packed


def with_roles(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html, refers_to, revisit: equal payloads refer to the largest page_id among them."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("html"))
    long_enough = F.octet_length("html") >= least_bytes
    same = rows.where(long_enough).groupBy(F.sha2("html", 256).alias("sha")).agg(F.count("*").alias("n"), F.max("page_id").alias("last")).where("n > 1")
    same = materialize(same, "repeated", workdir(pages.sparkSession))
    rows = rows.withColumn("key", F.when(long_enough, F.sha2("html", 256)))
    known = F.col("sha").isNotNull()
    if same.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        out = rows.join(F.broadcast(same.select("sha", "last")), F.col("key") == F.col("sha"), "left")
    else:
        least = same.agg(F.sum("n")).first()[0] / HOT
        hot = same.where(F.col("n") > least).select(F.col("sha").alias("hot_sha"), F.col("last").alias("hot_last"))
        out = rows.join(F.broadcast(hot), F.col("key") == F.col("hot_sha"), "left")  # fewer than HOT rows
        # Rows that need no other partner get keys of their own, so they don't meet in one task.
        done = F.col("hot_sha").isNotNull() | F.col("key").isNull()
        out = out.withColumn("key", F.when(done, F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))).otherwise(F.col("key")))
        cold = same.where(F.col("n") <= least).select("sha", "last")
        out = out.join(cold, F.col("key") == F.col("sha"), "left").withColumn("last", F.coalesce("hot_last", "last"))
        known = known | F.col("hot_sha").isNotNull()
    revisit = known & ~F.col("page_id").eqNullSafe(F.col("last"))
    return out.select("page_id", "url", "html", F.when(revisit, F.col("last")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write (page_id, url, html, refers_to, revisit) rows into archives below `folder`; (path, records, bytes) of each."""

    def run(batches):
        filesystem, base = pafs.FileSystem.from_uri(folder)
        filesystem.create_dir(base, recursive=True)

        def close(writer: ArchiveWriter) -> pa.RecordBatch:
            blob = writer.finish()
            name = f"a-{uuid.uuid4().hex}"
            with filesystem.open_output_stream(f"{base}/.{name}.tmp") as out:
                out.write(blob)
            filesystem.move(f"{base}/.{name}.tmp", f"{base}/{name}.zip")
            return pa.RecordBatch.from_pydict({"path": pa.array([f"{folder}/{name}.zip"]), "records": pa.array([len(writer.lines)], pa.int64()), "bytes": pa.array([len(blob)], pa.int64())})

        writer = ArchiveWriter()
        for b in batches:
            for page_id, url, html, refers_to, revisit in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if writer.add(page_id, url, html, refers_to, revisit) >= archive_bytes:
                    yield close(writer)
                    writer = ArchiveWriter()
        if writer.lines:
            yield close(writer)

    return materialize(rows.select("page_id", "url", "html", "refers_to", "revisit").mapInArrow(run, "path string, records long, bytes long"), "archives", folder + "-list")


def locate(archives: DataFrame) -> DataFrame:
    """(path, at, length): the place in its archive of each indexed record, from the directory and the index member."""

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                f = RangeFile(path)
                members = directory(f)
                data, _ = stored_range(f, members[DATA])
                at, size = stored_range(f, members[INDEX])
                entries = [json.loads(x.split(b" ", 1)[1]) for x in f.read(at, size).splitlines()]
                f.close()
                yield pa.RecordBatch.from_pydict({"path": pa.array([path] * len(entries)), "at": pa.array([data + e["offset"] for e in entries], pa.int64()), "length": pa.array([e["length"] for e in entries], pa.int64())})

    return archives.select("path").mapInArrow(run, "path string, at long, length long")


def _refers(value: str | None) -> int | None:
    x = value and value.removeprefix("<urn:page:").removesuffix(">")
    return int(x) if x and x != "-" else None


def read_records(places: DataFrame, with_payload: bool = True) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload) of each located record.

    A response's payload is checked against its digest.
    """
    fields = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload

    def run(batches):
        f, opened, held, first = None, None, b"", 0
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")}
            payloads = []
            for path, at, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if path != opened:
                    if f is not None:
                        f.close()
                    f, opened, held = RangeFile(path), path, b""
                if not first <= at <= at + n <= first + len(held):
                    held, first = f.read(at, max(n, min(RANGE_BYTES, f.size - at))), at
                r = parse_record(zlib.decompress(held[at - first : at - first + n], 31))
                h = r["headers"]
                want = h["warc-payload-digest"].removeprefix("sha1:")
                if h["warc-type"] == "response" and (digest(r["payload"]) != want or len(r["payload"]) != r["payload_bytes"]):
                    raise ValueError(f"damaged payload in {path}")
                for k, v in zip(out, (_refers(h["warc-record-id"]), h.get("warc-target-uri", ""), r["payload_bytes"], want, h["warc-type"], _refers(h.get("warc-refers-to"))), strict=True):
                    out[k].append(v)
                payloads.append(r["payload"] if h["warc-type"] == "response" else None)
            arrays = [pa.array(v, pa.string() if k in ("url", "payload_digest", "record_type") else pa.int64()) for k, v in out.items()]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(payloads, pa.binary())] * with_payload, [*out] + ["payload"] * with_payload)

    n = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = places.repartition(n, "path", F.expr(f"at div {8 * RANGE_BYTES}")).sortWithinPartitions("path", "at")
    return dealt.mapInArrow(run, fields)


def op2(spark, sf_dir: str) -> DataFrame:
    """Query op2: write a record a page, read the archives back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    archives = write_archives(with_roles(pages), f"{workdir(spark)}/archives")
    return read_records(locate(archives), with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


#: Base32 digits from the two hexadecimal ones that hold their five bits.
OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
m AS (SELECT page_id, url, strlen(html) AS payload_bytes, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(h, (5 * i) // 4 + 1, 2) AS INTEGER) >> CAST(3 - (5 * i) % 4 AS INTEGER)) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to, url
FROM m
"""
