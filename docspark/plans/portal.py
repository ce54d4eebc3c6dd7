"""Upload and download as relations: blocks, replicas, manifests, visibility.

An upload is planned (blocks and their IVs stored first), encrypted, copied to
every agent, and visible only if every chunk and the manifest reach the floor of
failure domains and the copies read back have the right hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.operators import catalog as C

VERSION = 1


def plan(files: DataFrame, block: int, secret: Column) -> DataFrame:
    """(upload, ordinal, len, hash, iv): one row a block. Store this before encrypting: a key and IV pair is used once."""
    b = C.blocks(files, "upload", "content", block)
    return b.withColumn("iv", F.unhex(F.substring(F.sha2(F.concat_ws("|", secret, "upload", "ordinal"), 256), 1, 24)))


def encrypted(files: DataFrame, planned: DataFrame, block: int, key: Column) -> DataFrame:
    """Chunks (upload, ordinal, hash of the stored bytes, stored); bound to version, upload, ordinal and length."""
    part = F.substring("content", F.col("ordinal") * block + 1, F.lit(block)).cast("binary")
    stored = C.encrypt(part, key, F.col("iv"), _bound())
    rows = planned.join(files, "upload").select("upload", "ordinal", "len", stored.alias("stored"))
    return rows.withColumn("hash", F.sha2("stored", 256))


def _bound() -> Column:
    return F.concat_ws("|", F.lit(VERSION), "upload", "ordinal", "len").cast("binary")


def replicate(objects: DataFrame, agents: DataFrame, works: Column) -> DataFrame:
    """Copies (hash, stored, agent, domain) on the agents that work; agents are a configured handful."""
    return objects.crossJoin(F.broadcast(agents)).where(works).select("hash", "stored", "agent", "domain")


def manifests(chunks: DataFrame) -> DataFrame:
    """(upload, stored, hash): a JSON manifest of the chunks in order, with their number checked by the reader."""
    one = F.struct("ordinal", "len", "hash")
    body = F.to_json(F.struct(F.lit(VERSION).alias("version"), F.array_sort(F.collect_list(one)).alias("chunks")))
    m = chunks.groupBy("upload").agg(body.cast("binary").alias("stored"))
    return m.withColumn("hash", F.sha2("stored", 256))


MANIFEST = "version int, chunks array<struct<ordinal:int,len:long,hash:string>>"


def read_manifests(m: DataFrame) -> DataFrame:
    """Chunks named by manifests; another version or a gap in the ordinals is an error."""
    x = m.select("upload", F.from_json(F.col("stored").cast("string"), MANIFEST).alias("m"))
    good = (F.col("m.version") == VERSION) & (F.transform("m.chunks", lambda c: c["ordinal"]) == F.transform("m.chunks", lambda c, i: i))
    x = x.select("upload", F.when(good, F.col("m.chunks")).otherwise(F.raise_error(F.lit("bad manifest")).cast("array<struct<ordinal:int,len:long,hash:string>>")).alias("c"))
    return x.select("upload", F.inline("c"))


def visible(uploads: DataFrame, chunks: DataFrame, manifest: DataFrame, copies: DataFrame, floor: int) -> DataFrame:
    """(upload, committable): copies are counted only if their bytes hash to their name, by failure domain.

    An empty file has a manifest and no chunks.
    """
    good = F.sha2("stored", 256) == F.col("hash")
    domains = C.replica_domains(copies, ["hash"], "domain", good)
    zero = lambda df: df.join(domains, "hash", "left").withColumn("domains", F.coalesce("domains", F.lit(0)))
    per_chunk = zero(chunks.select("upload", "hash")).groupBy("upload").agg(F.bool_and(F.col("domains") >= floor).alias("chunks_ok"))
    per_manifest = zero(manifest.select("upload", "hash")).select("upload", (F.col("domains") >= floor).alias("manifest_ok"))
    out = uploads.select("upload").join(per_chunk, "upload", "left").join(per_manifest, "upload", "left")
    return out.select("upload", (F.coalesce("chunks_ok", F.lit(True)) & F.coalesce("manifest_ok", F.lit(False))).alias("committable"))


def download(manifest: DataFrame, copies: DataFrame, key: Column) -> DataFrame:
    """(upload, content): the bytes of every chunk from its first valid copy, decrypted and joined; null if a chunk has none."""
    parts = read_manifests(manifest).join(C.first_valid_replica(copies, "hash", "agent", "stored").select("hash", F.col("content").alias("stored")), "hash", "left")
    plain = parts.withColumn("part", F.when(F.col("stored").isNotNull(), C.decrypt(F.col("stored"), key, _bound())))
    whole = C.assemble(plain.withColumn("missing", F.col("part").isNull()), "upload", "ordinal", "part")
    lost = plain.groupBy("upload").agg(F.bool_or(F.col("part").isNull()).alias("lost"))
    out = manifest.select("upload").join(whole, "upload", "left").join(lost, "upload", "left")
    return out.select("upload", F.when(~F.coalesce("lost", F.lit(False)), F.coalesce("content", F.lit(b""))).alias("content"))
