"""Corpus of files: discovery, extraction with explicit outcome states, query sets."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions import text as T

# Extensions taken as text, and folders that are never entered.
SUPPORTED = frozenset("txt md markdown rs py ts tsx js jsx go java c h cpp hpp html htm css json yaml yml toml csv pdf".split())
IGNORED = frozenset({".obsidian", ".git", ".trash", "node_modules"})
MAX_BYTES = 8 << 20
LEAST_PDF_CHARS = 40

FILES = "path string, name string, mtime long, size long, content_hash string, extract_status string, extracted_text string, error string"
QUERY_SET = "id string, text string, category string, relevant_file_ids array<bigint>, relevant_path_globs array<string>, grades map<string,int>"


class WalkError(Exception):
    """Folders that could not be read; nothing may be pruned after it."""


def is_supported(path: str) -> bool:
    ext = os.path.splitext(path)[1]
    return ext[1:].lower() in SUPPORTED


def walk(root: str) -> list[str]:
    """Absolute paths of supported regular files, sorted; links are not followed, and ignored names are tested in the whole path."""
    root = os.path.realpath(root)
    problems: list[OSError] = []
    out: list[str] = []
    if IGNORED & set(root.split(os.sep)):
        return out
    for folder, names, files in os.walk(root, onerror=problems.append, followlinks=False):
        names[:] = sorted(n for n in names if n not in IGNORED and not os.path.islink(os.path.join(folder, n)))
        for f in files:
            p = os.path.join(folder, f)
            if is_supported(p) and os.path.isfile(p) and not os.path.islink(p):
                out.append(p)
    if problems:
        raise WalkError("; ".join(map(str, problems)))
    return sorted(out)


@dataclass(frozen=True)
class Extracted:
    status: str
    text: str | None = None
    error: str | None = None


def no_pdf_text(content: bytes) -> str:
    """The pluggable text layer of a PDF; without a library there is none."""
    return ""


def extract(path: str, content: bytes, max_bytes: int = MAX_BYTES, pdf_text: Callable[[bytes], str] = no_pdf_text) -> Extracted:
    """extracted, needs-ocr, excluded or failed, with text or the reason."""
    ext = os.path.splitext(path)[1][1:].lower()
    if len(content) > max_bytes:
        return Extracted("excluded", None, f"larger than {max_bytes} bytes")
    if ext not in SUPPORTED:
        return Extracted("excluded", None, f"unsupported extension {ext!r}")
    if ext == "pdf":
        try:
            text = pdf_text(content)
        except Exception as e:  # noqa: BLE001  whatever the extractor raises, the file waits for OCR
            return Extracted("needs-ocr", None, str(e))
        if len(text.strip(T.WHITE_SPACE)) < LEAST_PDF_CHARS:
            return Extracted("needs-ocr", text, "too little text")
        return Extracted("extracted", text)
    try:
        text = content.decode("utf-8")
    except UnicodeDecodeError as e:
        return Extracted("failed", None, str(e))
    return Extracted("extracted", T.html_text(text) if ext in ("html", "htm") else text)


def read_files(spark: SparkSession, paths: list[str], max_bytes: int = MAX_BYTES, pdf_text: Callable[[bytes], str] = no_pdf_text, partitions: int | None = None) -> DataFrame:
    """The file table of the given paths; an unreadable file is a row with status failed."""

    def run(batches):
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("path", "name", "mtime", "size", "content_hash", "extract_status", "extracted_text", "error")}
            for p in b.column(0).to_pylist():
                try:
                    mtime, size = int(os.stat(p).st_mtime), os.stat(p).st_size
                    with open(p, "rb") as f:
                        content = f.read()
                    x, h = extract(p, content, max_bytes, pdf_text), hashlib.sha256(content).hexdigest()
                except OSError as e:
                    mtime, size, h, x = 0, 0, None, Extracted("failed", None, str(e))
                for k, v in zip(out, (p, os.path.basename(p), mtime, size, h, x.status, x.text, x.error), strict=True):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64() if k in ("mtime", "size") else pa.string()) for k, v in out.items()})

    listed = spark.createDataFrame([(p,) for p in paths], "path string")
    n = partitions or max(1, min(len(paths), spark.sparkContext.defaultParallelism))
    return listed.repartition(n).mapInArrow(run, FILES)


def extract_binary(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The file table of a `binaryFile` read, for stores that only Spark reaches; dot and underscore names are not listed there."""

    def run(batches):
        for b in batches:
            got = [extract(p, c or b"", max_bytes) for p, c in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True)]
            hashes = [hashlib.sha256(c or b"").hexdigest() for c in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {
                    "path": b.column(0),
                    "name": pa.array([p.rsplit("/", 1)[-1] for p in b.column(0).to_pylist()]),
                    "mtime": b.column(1),
                    "size": b.column(2),
                    "content_hash": pa.array(hashes, pa.string()),
                    "extract_status": pa.array([x.status for x in got], pa.string()),
                    "extracted_text": pa.array([x.text for x in got], pa.string()),
                    "error": pa.array([x.error for x in got], pa.string()),
                }
            )

    known = T.extension(F.col("path")).isin(sorted(SUPPORTED)) & ~F.exists(F.split("path", "/"), lambda x: x.isin(sorted(IGNORED)))
    return files.where(known).select("path", F.unix_timestamp("modificationTime").alias("mtime"), "length", "content").mapInArrow(run, FILES)


def load_queries(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of labelled queries with defaults filled in; none at all is an error."""
    q = spark.read.schema(QUERY_SET).json(path, multiLine=True)
    empty = lambda t: F.from_json(F.lit("[]"), t)
    q = q.select("id", "text", T.normalized_category(F.col("category")).alias("category"), F.coalesce("relevant_file_ids", empty("array<bigint>")).alias("relevant_file_ids"), F.coalesce("relevant_path_globs", empty("array<string>")).alias("relevant_path_globs"), F.coalesce("grades", F.from_json(F.lit("{}"), "map<string,int>")).alias("grades"))
    if q.limit(1).count() == 0:
        raise ValueError("the query set is empty")
    return q
