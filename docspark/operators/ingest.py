"""Incremental ingest: classify, chunk, embed what is missing, replace, prune.

Where the reference keeps an old modification time of an untouched file, and old
chunks of a file that failed, this refreshes the time and drops the chunks.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import chain
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions import text as T
from docspark.functions import vectors as V

CHUNKS = "file_id long, ordinal int, text string, char_start int, char_end int"


def fingerprint(size: int, overlap: int, max_bytes: int) -> str:
    """Names the parameters that decide what is stored of a file."""
    return f"chunk={size};overlap={overlap};max={max_bytes}"


def classify(before: DataFrame, now: DataFrame, key: str, same: Column) -> DataFrame:
    """(key, state): new, removed, unchanged (if `same` holds of the rows b and n) or changed, by one full join."""
    b, n = before.alias("b"), now.alias("n")
    state = F.when(F.col(f"b.{key}").isNull(), "new").when(F.col(f"n.{key}").isNull(), "removed").when(same, "unchanged").otherwise("changed")
    return b.join(n, F.col(f"b.{key}") == F.col(f"n.{key}"), "full").select(F.coalesce(f"b.{key}", f"n.{key}").alias(key), state.alias("state"))


def skippable(same_hash: Column, status: Column, same_fingerprint: Column) -> Column:
    """Only extracted files with the same hash and parameters are skipped; other states are tried again."""
    return F.coalesce(same_hash & (status == "extracted") & same_fingerprint, F.lit(False))


def upsert(before: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """Rows of now, and those of before whose key isn't there. Write to a new path, then swap."""
    return now.unionByName(before.join(now.select(key), key, "left_anti"))


def keep_only(rows: DataFrame, visited: DataFrame, key: str) -> DataFrame:
    """Prune what wasn't visited; an empty visit prunes everything."""
    return rows.join(visited.select(key).distinct(), key, "left_semi")


def chunk(files: DataFrame, size: int = 2000, overlap: int = 200, id_col: str = "file_id", text_col: str = "text") -> DataFrame:
    """Overlapping chunks of all texts."""

    def run(batches):
        for b in batches:
            out = {k: [] for k in ("file_id", "ordinal", "text", "char_start", "char_end")}
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for o, t, s, e in T.chunk_text(text, size, overlap):
                    for k, v in zip(out, (i, o, t, s, e), strict=True):
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict({"file_id": pa.array(out["file_id"], pa.int64()), "ordinal": pa.array(out["ordinal"], pa.int32()), "text": pa.array(out["text"], pa.string()), "char_start": pa.array(out["char_start"], pa.int32()), "char_end": pa.array(out["char_end"], pa.int32())})

    return files.select(F.col(id_col).cast("long").alias("file_id"), F.col(text_col).alias("text")).mapInArrow(run, CHUNKS)


def replace_chunks(old: DataFrame, fresh: DataFrame, changed: DataFrame) -> DataFrame:
    """Chunks of changed files are all replaced."""
    return old.join(changed.select("file_id"), "file_id", "left_anti").unionByName(fresh)


def missing(chunks: DataFrame, embeddings: DataFrame, model: str, dims: int, key: str = "chunk_id") -> DataFrame:
    """Chunks without a vector of this model and size."""
    have = embeddings.where((F.col("model") == model) & (F.col("dims") == dims)).select(key)
    return chunks.join(have, key, "left_anti")


class EmbeddingProvider(Protocol):
    """Embeds texts; `identity` names the model's exact state."""

    model: str

    def identity(self) -> str: ...

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashingProvider:
    """Deterministic provider for tests and offline use: signed counts of hashed words."""

    def __init__(self, dims: int = 64, model: str = "hashing"):
        self.model, self.dims = model, dims

    def identity(self) -> str:
        return hashlib.sha256(f"{self.model}:{self.dims}".encode()).hexdigest()

    def embed(self, texts: list[str]) -> list[list[float]]:
        out, of = [], _hashes(self.dims).__getitem__
        for t in texts:
            n = np.bincount(np.fromiter(chain.from_iterable(map(of, t.split())), np.int64), minlength=2 * self.dims)
            out.append((n[: self.dims] - n[self.dims :]).astype(np.float64).tolist())
        return out


class _Hashes(dict):
    """Of a run of other than white space, the components that its words' stems add to; from dims on, they are taken away there."""

    def __init__(self, dims: int):
        super().__init__()
        self.dims = dims

    def __missing__(self, token: str) -> tuple[int, ...]:
        if len(self) >= 1 << 19:
            self.clear()
        plain = token.strip(".,;:!?")
        plain = plain.lower() if plain.isascii() else plain
        if plain != token:
            out = self[plain]
            self[token] = out
            return out
        words = [T.porter_stem(token)] if token.isascii() and token.isalnum() else T.index_terms(token)
        hashes = [int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "big") for w in words]
        out = self[token] = tuple(h % self.dims + (0 if h >> 63 else self.dims) for h in hashes)
        return out


_hashes = lru_cache(maxsize=4)(_Hashes)


def embed(chunks: DataFrame, provider: EmbeddingProvider, dims: int, key: str = "chunk_id", batch: int = 8, concurrency: int | None = None, file_col: str | None = None) -> DataFrame:
    """(key, model, dims, vector): each task sends batches to the provider; `concurrency` tasks at once.

    The provider's vectors are cut to dims and normalized. The chunk's file goes along as file_id if its column is named.
    """

    def run(batches):
        for b in batches:
            ids, texts, file = b.column(0), b.column(1).to_pylist(), b.column(2)
            for a in range(0, len(texts), batch):
                v = provider.embed([t or "" for t in texts[a : a + batch]])
                if len(v) != len(texts[a : a + batch]):
                    raise ValueError("the provider left out a text")
                flat = np.array(v, np.float64)
                v = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel())) if flat.ndim == 2 else pa.array(v, pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([ids.slice(a, batch), v, file.slice(a, batch)], ["key", "v", "file"])

    file = F.col(file_col).cast("long") if file_col else F.lit(None).cast("long")
    rows = chunks.select(F.col(key).cast("long").alias("key"), "text", file.alias("file"))
    rows = rows.repartition(concurrency) if concurrency else rows
    got = rows.mapInArrow(run, "key long, v array<double>, file long")
    along = [F.col("file").alias("file_id")] if file_col else []
    return got.select(F.col("key").alias(key), F.lit(provider.model).alias("model"), F.lit(dims).alias("dims"), V.truncate_and_normalize(F.col("v"), dims).alias("vector"), *along)


def counters(classified: DataFrame, status: str = "state") -> DataFrame:
    return classified.groupBy(status).agg(F.count("*").alias("n"))


def content_fingerprint(files: DataFrame, columns: list[str]) -> DataFrame:
    """One hash of a set of files, whatever their order: hashes of rows, of 256 buckets of them, of the buckets."""
    row = F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256).alias("h")
    per_bucket = files.select(row).groupBy(F.substring("h", 1, 2).alias("b")).agg(F.bit_xor(F.conv(F.substring("h", 3, 15), 16, 10).cast("bigint")).alias("x"), F.sum(F.conv(F.substring("h", 18, 8), 16, 10).cast("bigint")).cast("bigint").alias("s"), F.count("*").alias("n"))
    each = F.concat_ws(":", "b", "x", "s", "n")
    return per_bucket.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(each)), ","), 256).alias("fingerprint"), F.sum("n").alias("files"))


def check_identity(stored: str | None, current: str) -> None:
    """Refuse to mix vectors of two states of a model."""
    if stored is not None and stored != current:
        raise ValueError("stored vectors come from another state of this model; re-embed them")
