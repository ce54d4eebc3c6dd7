"""Prepare a corpus: files -> extracted texts -> chunks, incrementally."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from docspark.operators import ingest
from docspark.sources import corpus
from docspark.sources.snapshots import Snapshots


def prepare(spark: SparkSession, root: str, store: str, size: int = 2000, overlap: int = 200, max_bytes: int = corpus.MAX_BYTES) -> dict:
    """Bring the store's files and chunks up to date with a folder; counters of what happened.

    An unchanged extracted file keeps its chunks (its time is refreshed); other
    states are tried again. A walk that failed anywhere changes nothing. Files,
    chunks and the fingerprint of the parameters become visible by one pointer.
    """
    fingerprint = ingest.fingerprint(size, overlap, max_bytes)
    files = Snapshots(spark, f"{store}/files")
    chunks = Snapshots(spark, f"{store}/chunks", files)
    paths = corpus.walk(root)
    now = corpus.read_files(spark, paths, max_bytes).withColumn("file_id", F.xxhash64("path")).persist()
    old, pointer = files.read(), files.pointer()
    same_parameters = F.lit(bool(pointer) and pointer["meta"].get("fingerprint") == fingerprint)
    if old is None:
        old = now.limit(0)
    before = old.select("path", F.col("content_hash").alias("old_hash"), F.col("extract_status").alias("old_status"))
    marked = now.join(before, "path", "left").withColumn("skip", ingest.skippable(F.col("content_hash") == F.col("old_hash"), F.col("old_status"), same_parameters))
    fresh = ingest.chunk(marked.where("not skip and extract_status = 'extracted'"), size, overlap, text_col="extracted_text")
    kept = chunks.read()
    if kept is not None:
        kept = ingest.keep_only(kept, marked.where("skip").select("file_id"), "file_id")
        fresh = kept.unionByName(fresh)
    pruned = old.join(now.select("path"), "path", "left_anti").count()
    n = {r.state: r.n for r in ingest.counters(marked.withColumn("state", F.when(F.col("skip"), "skipped").otherwise(F.col("extract_status")))).collect()}
    files.write(now, {"fingerprint": fingerprint, "root": root}, others={chunks: fresh})
    now.unpersist()
    return {"seen": len(paths), "pruned": pruned, **n}
