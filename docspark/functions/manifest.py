"""The manifest's payload as bytes: written by column expressions, read with every field checked."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the format: most bytes of a field, and lengths of nonces and hashes.
MAX_FIELD, NONCE, HASH = 16 * 1024 * 1024, 24, 32

PAYLOAD = "struct<name:string,plain_len:bigint,plain_hash:binary,key_nonce:binary,wrapped_key:binary,chunks:array<struct<ordinal:int,plain_len:int,nonce:binary,hash:binary,stored_len:int>>>"


def little_endian(value: Column, size: int) -> Column:
    """A whole number in `size` bytes, the lowest first."""
    digits = F.lpad(F.hex(value.cast("bigint")), 2 * size, "0")
    return F.unhex(F.concat(*(F.substring(digits, 2 * k + 1, 2) for k in range(size - 1, -1, -1))))


def _field(value: Column) -> Column:
    n = F.octet_length(value)
    return F.when(n <= MAX_FIELD, F.concat(little_endian(n, 4), value)).otherwise(F.raise_error(F.lit("a manifest field is too large")).cast("binary"))


def _exactly(value: Column, size: int) -> Column:
    return F.when(F.octet_length(value) == size, value).otherwise(F.raise_error(F.lit("a nonce or hash has another length")).cast("binary"))


def padded_nonce(iv: Column) -> Column:
    """A shorter IV, zeros behind it."""
    return F.rpad(iv, NONCE, F.lit(b"\0"))


def encode_payload(name: Column, plain_len: Column, plain_hash: Column, key_nonce: Column, wrapped_key: Column, chunks: Column) -> Column:
    """Bytes of a payload; chunks: array of (ordinal, plain_len, nonce, hash, stored_len) in order."""
    one = F.transform(chunks, lambda c: F.hex(F.concat(little_endian(c["ordinal"], 4), little_endian(c["plain_len"], 4), _exactly(c["nonce"], NONCE), _exactly(c["hash"], HASH), little_endian(c["stored_len"], 4))))
    head = F.concat(_field(name.cast("binary")), little_endian(plain_len, 8), _exactly(plain_hash, HASH), _exactly(key_nonce, NONCE), _field(wrapped_key))
    return F.concat(head, little_endian(F.size(chunks), 4), F.unhex(F.array_join(one, "")))


def parse_payload(raw: bytes) -> dict:
    """The payload's fields; ValueError for one that is cut off, too long, out of order or has bytes behind it."""
    at = 0

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(raw):
            raise ValueError("the manifest is cut off")
        at += n
        return raw[at - n : at]

    def field() -> bytes:
        n = struct.unpack("<I", take(4))[0]
        if n > MAX_FIELD:
            raise ValueError("a manifest field is too large")
        return take(n)

    name = field().decode("utf-8")
    out = {"name": name, "plain_len": struct.unpack("<Q", take(8))[0], "plain_hash": take(HASH), "key_nonce": take(NONCE), "wrapped_key": field(), "chunks": []}
    count = struct.unpack("<I", take(4))[0]
    if count > MAX_FIELD // 64:
        raise ValueError("a manifest has too many chunks")
    for k in range(count):
        ordinal, plain = struct.unpack("<II", take(8))
        if ordinal != k:
            raise ValueError("a manifest's chunks are out of order")
        nonce, name_of, stored = take(NONCE), take(HASH), struct.unpack("<I", take(4))[0]
        out["chunks"].append({"ordinal": ordinal, "plain_len": plain, "nonce": nonce, "hash": name_of, "stored_len": stored})
    if at != len(raw):
        raise ValueError("bytes follow the manifest")
    return out


def decode_payload(raw: Column) -> Column:
    """The payload's fields as a struct; a bad one fails the job."""

    @F.pandas_udf(PAYLOAD)
    def decode(blobs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_payload(bytes(x)) for x in blobs], columns=["name", "plain_len", "plain_hash", "key_nonce", "wrapped_key", "chunks"])

    return decode(raw)
