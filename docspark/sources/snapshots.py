"""Tables as immutable snapshots under a pointer: write aside, check, then swap.

Tables that belong together share a pointer: one leads, and its pointer names the
others' data, too, so all change at once or not at all.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def claim(spark: SparkSession, fs, draft, final) -> bool:
    """Give a finished draft its final name unless that is taken: a hard link on POSIX, elsewhere a rename that doesn't overwrite."""
    uri = fs.makeQualified(final).toUri()
    if uri.getScheme() == "file":
        try:
            os.link(fs.makeQualified(draft).toUri().getPath(), uri.getPath())
        except FileExistsError:
            return False
        fs.delete(draft, False)
        return True
    jvm = spark.sparkContext._jvm
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(uri, spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, final, options)
    except Exception:
        if fs.exists(final):
            return False
        raise
    return True


class Snapshots:
    """One table at a path, or one that `lead`'s pointer names; of two writers one fails, readers keep the snapshot they opened."""

    def __init__(self, spark: SparkSession, root: str, lead: Snapshots | None = None):
        self.spark, self.root, self.lead = spark, root.rstrip("/"), lead
        self._jvm = spark.sparkContext._jvm
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{p}")

    def pointer(self) -> dict | None:
        if self.lead is not None:
            p = self.lead.pointer()
            return p and {**p, "data": p["others"][self.root.rpartition("/")[2]]}
        if not self._fs.exists(self._path("pointers")):
            return None
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path("pointers")))
        names = [n for n in names if not n.startswith("_")]
        if not names:
            return None
        f = self._fs.open(self._path(f"pointers/{names[-1]}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(f, "UTF-8"))
        finally:
            f.close()

    def read(self) -> DataFrame | None:
        p = self.pointer()
        return None if p is None else self.spark.read.parquet(f"{self.root}/{p['data']}")

    def stage(self, df: DataFrame, partition_by: list[str] | None = None, check=None) -> str:
        """Store df where no pointer shows it yet; `check(new)` may raise."""
        data = f"data-{uuid.uuid4().hex}"
        w = df.write
        (w.partitionBy(*partition_by) if partition_by else w).parquet(f"{self.root}/{data}")
        if check is not None:
            check(self.spark.read.parquet(f"{self.root}/{data}"))
        return data

    def write(self, df: DataFrame, meta: dict | None = None, partition_by: list[str] | None = None, check=None, others: dict[Snapshots, DataFrame] | None = None) -> dict:
        """Store df, and `others` that this table leads, as the next snapshot; a `check(new)` that raises leaves everything as it was."""
        if self.lead is not None:
            raise ValueError("a table with a lead is written with it")
        last = self.pointer()
        staged = {t.root.rpartition("/")[2]: t.stage(d) for t, d in (others or {}).items()}
        data = self.stage(df, partition_by, check)
        new = {"version": (last["version"] if last else 0) + 1, "data": data, "others": staged, "meta": meta or {}}
        draft, final = self._path(f"pointers/_{data}"), self._path(f"pointers/{new['version']:010d}.json")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        if not claim(self.spark, self._fs, draft, final):
            self._fs.delete(draft, False)
            raise RuntimeError("another writer stored a snapshot")
        return new
