import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from docspark.functions import manifest as M
from docspark.operators import catalog as C

# Fixed value: a payload of one chunk.
GOLDEN = "01000000610300000000000000010101010101010101010101010101010101010101010101010101010101010102020202020202020202020202020202020202020202020203000000030405010000000000000003000000060606060606060606060606060606060606060606060606070707070707070707070707070707070707070707070707070707070707070713000000"


def encoded(spark, name="a", nonce="06" * 24):
    hexed = lambda x: F.unhex(F.lit(x))
    chunk = F.struct(F.lit(0).alias("ordinal"), F.lit(3).alias("plain_len"), hexed(nonce).alias("nonce"), hexed("07" * 32).alias("hash"), F.lit(19).alias("stored_len"))
    raw = M.encode_payload(F.lit(name), F.lit(3), hexed("01" * 32), hexed("02" * 24), hexed("030405"), F.array(chunk))
    return spark.range(1).select(raw.alias("raw"))


def test_payload_is_the_fixed_one_and_reads_back(spark):
    df = encoded(spark)
    raw = bytes(df.first().raw)
    assert raw.hex() == GOLDEN
    got = df.select(M.decode_payload(F.col("raw")).alias("m")).select("m.*").first()
    assert (got.name, got.plain_len, bytes(got.plain_hash), bytes(got.key_nonce), bytes(got.wrapped_key)) == ("a", 3, b"\1" * 32, b"\2" * 24, b"\3\4\5")
    assert [(c.ordinal, c.plain_len, bytes(c.nonce), bytes(c.hash), c.stored_len) for c in got.chunks] == [(0, 3, b"\6" * 24, b"\7" * 32, 19)]


def test_damaged_payloads_are_refused():
    raw = bytes.fromhex(GOLDEN)
    for bad in (raw[:-1], raw + b"\0", b"\xff\xff\xff\xff" + raw[4:], raw.replace(b"\1\0\0\0\0\0\0\0\3", b"\1\0\0\0\1\0\0\0\3"), raw[:4] + b"\xff" + raw[5:]):
        assert bad != raw
        with pytest.raises(ValueError):
            M.parse_payload(bad)


def test_wrong_lengths_are_refused(spark):
    with pytest.raises(PySparkException):
        encoded(spark, nonce="06" * 12).collect()
    assert bytes(spark.range(1).select(M.padded_nonce(F.unhex(F.lit("06" * 12))).alias("x")).first().x) == b"\6" * 12 + b"\0" * 12


def test_wrapped_keys_open_for_their_purpose_only(spark):
    key = lambda name: F.unhex(F.sha2(F.lit(name), 256))
    wrap = lambda k: C.wrap_key(k, key("master"), F.unhex(F.lit("0a" * 12)), F.lit("content"), F.lit("file 1"), F.lit(2)).alias("w")
    df = spark.range(1).select(wrap(key("content")))
    right = (key("master"), F.lit("content"), F.lit("file 1"), F.lit(2))
    assert df.select(C.unwrap_key(F.col("w"), *right) == key("content")).first()[0]
    for k, other in enumerate((key("another"), F.lit("manifest"), F.lit("file 2"), F.lit(3))):
        with pytest.raises(PySparkException):
            df.select(C.unwrap_key(F.col("w"), *right[:k], other, *right[k + 1 :])).collect()
    with pytest.raises(PySparkException, match="length"):
        spark.range(1).select(wrap(F.lit(b"short"))).select(C.unwrap_key(F.col("w"), *right)).collect()
