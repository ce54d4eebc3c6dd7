"""Streams of catalog operations and of arriving files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def once(log: DataFrame, op_id: str, time: str, remember: str, epoch: str | None = None, current: int = 0) -> DataFrame:
    """Each operation once, as far back as `remember`; operations of an older placement epoch are refused."""
    rows = log.where(F.col(epoch) >= current) if epoch else log
    return rows.withWatermark(time, remember).dropDuplicatesWithinWatermark([op_id])


def fold_batches(log: DataFrame, key: str, seq: str, path: str, checkpoint: str) -> StreamingQuery:
    """Write the last row of a key of each batch below path/batch=N.

    A retried batch overwrites its own folder, so a crash leaves neither gaps
    nor repeats; `current` gives the state.
    """

    def put(batch: DataFrame, n: int) -> None:
        last = batch.groupBy(key).agg(F.max_by(F.struct(*[c for c in batch.columns if c != key]), seq).alias("x")).select(key, "x.*")
        last.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return log.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(batches: DataFrame, key: str, seq: str) -> DataFrame:
    return batches.groupBy(key).agg(F.max_by(F.struct(*[c for c in batches.columns if c not in (key, "batch")]), seq).alias("x")).select(key, "x.*")


def ingest(files: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run an idempotent ingest step on the files of each batch, until all that arrived are done."""
    return files.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def refresh_collections(arrivals: DataFrame, saved: DataFrame, score, threshold: float) -> DataFrame:
    """Smart collections: arriving vectors joined to the saved query vectors (a static, small table) they reach."""
    both = arrivals.crossJoin(F.broadcast(saved))
    return both.withColumn("score", score).where(F.col("score") >= threshold)
