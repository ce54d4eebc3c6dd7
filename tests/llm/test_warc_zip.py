import base64
import hashlib
import io
import struct
import zipfile

import pytest

from docspark.llm import warc_zip as W
from docspark.llm.store import workdir


class Bytes:
    def __init__(self, b):
        self.b, self.size = b, len(b)

    def read(self, at, n):
        return self.b[at : at + n]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, sha string, last string")


def round_trip(spark, rows, least=0, archive_bytes=1 << 20):
    folder = f"{workdir(spark)}/archives"
    archives = W.write_archives(W.with_roles(pages(spark, rows), least), folder, archive_bytes)
    return archives.collect(), W.read_records(W.locate(archives)).collect()


ROWS = [(1, "http://a", "same"), (7, "http://b", "same"), (3, "http://c", "same"), (4, "http://d", "other ü"), (5, None, None), (6, "u", ""), (None, "n", "same"), (None, "m", "alone"), (8, "twice", "t"), (8, "twice", "t"), (9, "line\r\nbreak", "z" * 300_000)]


def test_round_trip_and_roles(spark):
    archives, got = round_trip(spark, ROWS)
    assert sum(a.records for a in archives) == len(ROWS) == len(got)
    by = {}
    for i, _, h in ROWS:
        by.setdefault((h or "").encode(), []).append(-1 if i is None else i)
    for r in got:
        payload = next((h or "").encode() for i, u, h in ROWS if i == r.page_id and ((u or "").translate({13: "%0D", 10: "%0A"}) == r.url))
        top = max(by[payload])
        assert r.payload_bytes == len(payload)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if (-1 if r.page_id is None else r.page_id) == top:
            assert (r.record_type, r.refers_to, bytes(r.payload)) == ("response", None, payload)
        else:
            assert (r.record_type, r.refers_to, r.payload) == ("revisit", top, None)


def test_least_bytes_and_archive_size(spark):
    archives, got = round_trip(spark, ROWS, least=5, archive_bytes=200)
    assert len(archives) > 3
    assert all(r.record_type == "response" for r in got)


def test_empty_table(spark):
    assert round_trip(spark, []) == ([], [])


def test_directory_reads_what_zipfile_writes():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k in range(5):
            z.writestr(f"n{k}/é", b"x" * k)
        z.comment = b"PK\5\6 in a comment"
    f = Bytes(out.getvalue())
    for name, entry in W.directory(f).items():
        at, n = W.stored_range(f, entry)
        assert f.read(at, n) == b"x" * int(name[1])


def test_zip64_directory():
    """A ZIP64 file by hand: sizes, offset and counts in the extra field and the ZIP64 end record."""
    name, data = b"m", b"stored bytes"
    local = struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, 20) + name + struct.pack("<HHQQ", 1, 16, len(data), len(data))
    pad = b"\0" * 100
    start = len(pad)
    extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), start)
    central = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    body = pad + local + data
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, 1, 1, len(central), len(body))
    locator = struct.pack("<4sIQI", b"PK\6\7", 0, len(body) + len(central), 1)
    end = struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    f = Bytes(body + central + end64 + locator + end)
    members = W.directory(f)
    at, n = W.stored_range(f, members["m"])
    assert f.read(at, n) == data


def test_damage_is_an_error():
    with pytest.raises(ValueError):
        W.directory(Bytes(b"nothing"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", b"x" * 1000)
    f = Bytes(out.getvalue())
    with pytest.raises(ValueError):
        W.stored_range(f, W.directory(f)["a"])


@pytest.mark.parametrize("least", [0, 4])
def test_many_repeated_payloads_join_by_exchange(spark, monkeypatch, least):
    """Hot payloads are broadcast, the others exchanged; roles are the same as with a broadcast of all."""
    rows = [(k, f"u{k}", None if k % 3 == 0 else "hot" if k % 3 == 1 else f"payload {k // 9}") for k in range(300)] + [(None, None, "payload 7"), (5, "u", "payload 7")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    plain = sorted(map(str, W.with_roles(pages, least).collect()))
    monkeypatch.setattr(W, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(W, "HOT", 10)
    assert sorted(map(str, W.with_roles(pages, least).collect())) == plain
