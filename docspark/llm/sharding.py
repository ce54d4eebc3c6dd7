"""Sharding by size-tiered compaction under a versioned manifest.

A store is a folder: `data/` holds immutable Parquet shards, `lists/` files that
name shards, and `manifest/` one small JSON file a version, which names lists.
`append` writes arrivals as small shards, one or more a task, and a list of them.
`compact` looks at the shards smaller than half the target. They fall into tiers,
each FANOUT times the size of the one below; a tier that holds FANOUT runs or more
has its runs merged, up to the target a file, which makes runs of higher tiers, and
so on up; a tier with fewer runs waits. The cascade is planned on sizes first, so a
row is written once for a compaction, and shards of at least half the target are
never touched or listed again.

A version is committed by giving a finished draft the next number's name in a way
that fails if the name is taken: a hard link on a local or POSIX file system, a
rename without overwriting elsewhere (atomic on HDFS; an object store without
conditional writes needs a single writer). The loser of a race takes the winner's
version as its parent and tries again. Readers see the shards of one version only,
so a job that dies leaves the last version untouched; what no version names and is
older than `older_s` is removed by `vacuum`.

The driver handles a row a small shard, and a row for each list of up to
LIST_SHARDS full ones, never a row a document.

Defined cases: nulls, empty texts, repeated rows and extra columns of any name are
stored as they are; shards of equal size are taken in the order of their paths; an
empty table gives a version without shards; a column `shard` is replaced on reading.
"""

from __future__ import annotations

import json
import math
import os
import time
import uuid
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .store import workdir

FANOUT = 4
TARGET_BYTES = 64 << 20
SMALL_ROWS = 20_000
LIST_SHARDS = 10_000
#: Shards up to which their numbers are broadcast, about 150 bytes each.
BROADCAST_SHARDS = 50_000
TRIES = 20
DAY = 86_400
OPTIONS = {"compression": "zstd"}


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _rows_and_path(df: DataFrame, columns: list[str]) -> DataFrame:
    """(row, path): the columns as one struct, whatever their names, and the shard's path below its store."""
    return df.select(F.struct(*(F.col(_quoted(c)) for c in columns)).alias("row"), F.regexp_extract(F.input_file_name(), "^.*/(data/.*)$", 1).alias("path"))


def free_name(columns: list[str], name: str) -> str:
    """`name`, with as many underscores as make it unlike any column's."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


class Store:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES):
        self.spark, self.root, self.target = spark, root.rstrip("/"), target_bytes
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def _path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    def _read(self, name: str) -> str:
        f = self._fs.open(self._path(f"{self.root}/{name}"))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(f, "UTF-8")
        finally:
            f.close()

    def _write(self, name: str, text: str):
        path = self._path(f"{self.root}/{name}")
        out = self._fs.create(path, False)
        out.write(bytearray(text.encode()))
        out.close()
        return path

    def versions(self) -> list[int]:
        d = self._path(f"{self.root}/manifest")
        if not self._fs.exists(d):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(d)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """The given or the last version; version 0 is the empty store."""
        have = self.versions()
        if version is None:
            version = have[-1] if have else 0
        if version == 0:
            return {"version": 0, "schema": None, "lists": [], "next": 0}
        return json.loads(self._read(f"manifest/v{version:08d}.json"))

    def shards(self, manifest: dict, small: bool | None = None) -> list[dict]:
        """The shards (path, rows, bytes, number) of a version; the small or the full ones only if asked for."""
        return [json.loads(x) for one in manifest["lists"] if small is None or one["small"] == small for x in self._read(f"lists/{one['name']}").splitlines()]

    def _listed(self, shards: list[dict]) -> list[dict]:
        """Write lists of the shards, small and full ones apart."""
        out = []
        for small in (True, False):
            mine = sorted((s for s in shards if (s["bytes"] < self.target / 2) == small), key=lambda s: s["path"])
            for a in range(0, len(mine), LIST_SHARDS):
                name = f"l-{uuid.uuid4().hex}.json"
                self._write(f"lists/{name}", "".join(json.dumps(s) + "\n" for s in mine[a : a + LIST_SHARDS]))
                out.append({"name": name, "small": small, "shards": len(mine[a : a + LIST_SHARDS])})
        return out

    def _claim(self, draft, final) -> bool:
        """Give the finished draft its final name, unless that is taken."""
        uri = self._fs.makeQualified(final).toUri()
        if uri.getScheme() == "file":
            try:
                os.link(self._fs.makeQualified(draft).toUri().getPath(), uri.getPath())
            except FileExistsError:
                return False
            self._fs.delete(draft, False)
            return True
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(uri, self._conf).rename(draft, final, options)
        except Exception:
            if self._fs.exists(final):
                return False
            raise
        return True

    def commit(self, parent: int, schema: StructType | None, lists: list[dict], number: int, note: str) -> dict:
        """Make the shards of `lists` the version after `parent`, or raise if that exists already."""
        new = {"version": parent + 1, "parent": parent, "note": note, "schema": schema and schema.jsonValue(), "lists": lists, "next": number}
        draft = self._write(f"manifest/_draft-{uuid.uuid4().hex}", json.dumps(new))
        if not self._claim(draft, self._path(f"{self.root}/manifest/v{parent + 1:08d}.json")):
            self._fs.delete(draft, False)
            raise RuntimeError(f"version {parent + 1} was committed by another writer")
        return new

    def _commit_change(self, schema: StructType, shards: list[dict], change: Callable[[dict], list[dict]], note: str) -> dict:
        """Commit new shards and the lists that `change` keeps of the last version, on top of whichever version is last."""
        for _ in range(TRIES):
            last = self.manifest()
            if last["schema"] and StructType.fromJson(last["schema"]).simpleString() != schema.simpleString():
                raise ValueError("arrivals have another schema than the store")
            kept = change(last)
            numbered = [s | {"number": s.get("number", last["next"] + k)} for k, s in enumerate(shards)]
            try:
                return self.commit(last["version"], schema, kept + self._listed(numbered), last["next"] + len(shards), note)
            except RuntimeError:
                continue
        raise RuntimeError(f"another writer came first {TRIES} times")

    def _written(self, folder: str, schema: StructType) -> list[dict]:
        """Shards of a finished write: path, rows, bytes."""
        sizes, files = {}, self._fs.listFiles(self._path(folder), True)
        while files.hasNext():
            f = files.next()
            sizes[f.getPath().toString().rpartition("/data/")[2]] = f.getLen()
        path = F.regexp_extract(F.input_file_name(), "^.*/data/(.*)$", 1)
        df = self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(folder)
        found = df.select(path.alias("path")).groupBy("path").agg(F.count("*").alias("rows"))
        return [{"path": f"data/{r.path}", "bytes": sizes[unquote(r.path)], "rows": r.rows} for r in found.toLocalIterator()]

    def append(self, docs: DataFrame) -> dict:
        """Commit arrivals as small shards; rows keep their partitions, so nothing is exchanged."""
        last, schema = self.manifest(), docs.schema
        if last["schema"] and StructType.fromJson(last["schema"]).simpleString() != schema.simpleString():
            raise ValueError("arrivals have another schema than the store")
        folder = f"{self.root}/data/a-{uuid.uuid4().hex}"
        docs.write.options(**OPTIONS).option("maxRecordsPerFile", SMALL_ROWS).parquet(folder)
        return self._commit_change(schema, self._written(folder, schema), lambda m: m["lists"], "append")

    def tier(self, size: int) -> int:
        """0 for sizes up to FANOUT^-8 of the target, one more for every FANOUT times that."""
        return max(0, 8 - math.floor(math.log(max(self.target / max(size, 1), 1), FANOUT)))

    def plan(self, shards: list[dict]) -> list[list[dict]]:
        """Groups of shards to merge into a file each: the cascade over the tiers, up to the target."""
        runs = [(s["bytes"], [s]) for s in sorted(shards, key=lambda s: s["path"]) if s["bytes"] < self.target / 2]
        done = False
        while not done:
            done = True
            for t in sorted({self.tier(size) for size, _ in runs}):
                mine = sorted((r for r in runs if self.tier(r[0]) == t and r[0] < self.target / 2), key=lambda r: (-r[0], r[1][0]["path"]))
                if len(mine) < FANOUT:
                    continue
                merged = []
                for size, group in mine:
                    if not merged or merged[-1][0] + size > self.target:
                        merged.append((size, group))
                    else:
                        merged[-1] = (merged[-1][0] + size, merged[-1][1] + group)
                if len(merged) < len(mine):
                    runs = [r for r in runs if r not in mine] + merged
                    done = False
                    break
        return [group for _, group in sorted(runs, key=lambda r: r[1][0]["path"]) if len(group) > 1]

    def compact(self) -> dict:
        """Merge the planned groups in one job and commit the new version; the last one if there is nothing to merge."""
        last = self.manifest()
        small = self.shards(last, small=True)
        groups = self.plan(small)
        if not groups:
            return last
        schema = StructType.fromJson(last["schema"])
        merged = {s["path"] for g in groups for s in g}
        where = self.spark.createDataFrame([(s["path"], k) for k, g in enumerate(groups) for s in g], "path string, file int")
        rows = _rows_and_path(self.spark.read.schema(schema).parquet(*(f"{self.root}/{p}" for p in sorted(merged))), schema.names)
        body = rows.join(F.broadcast(where) if len(merged) <= BROADCAST_SHARDS else where, "path").select("file", "row")
        folder, name = f"{self.root}/data/c-{uuid.uuid4().hex}", free_name(schema.names, "file")
        # A group, of the target's size at most, is one task's; more tasks than groups, so few tasks get two.
        out = body.repartition(4 * len(groups), "file").select(F.col("file").alias(name), "row.*")
        out.write.options(**OPTIONS).partitionBy(name).parquet(folder)
        looked_at = {x["name"] for x in last["lists"] if x["small"]}

        def change(now: dict) -> list[dict]:
            if not looked_at <= {x["name"] for x in now["lists"]}:
                raise ValueError("another compaction has merged these shards")
            return [x for x in now["lists"] if x["name"] not in looked_at]

        return self._commit_change(schema, self._written(folder, schema) + [s for s in small if s["path"] not in merged], change, "compact")

    def read(self, version: int | None = None) -> DataFrame:
        """Rows of a version, with `shard` (its number, which it keeps from version to version) last; a column of that name is replaced."""
        m = self.manifest(version)
        shards = self.shards(m)
        schema = StructType.fromJson(m["schema"]) if m["schema"] else StructType()
        names = [c for c in schema.names if c.lower() != "shard"]
        if not shards:
            return self.spark.createDataFrame([], schema).select(*map(_quoted, names)).withColumn("shard", F.lit(None).cast("int"))
        number = self.spark.createDataFrame([(s["path"], s["number"]) for s in shards], "path string, number int")
        rows = _rows_and_path(self.spark.read.schema(schema).parquet(*(f"{self.root}/{s['path']}" for s in shards)), names)
        rows = rows.join(F.broadcast(number) if len(shards) <= BROADCAST_SHARDS else number, "path")
        return rows.select("row.*", F.col("number").alias("shard"))

    def vacuum(self, keep: int = 1, older_s: float = DAY) -> int:
        """Delete what none of the last `keep` versions names and is older than `older_s`, which running writers must not reach; returns data folders deleted."""
        have, before = self.versions(), (time.time() - older_s) * 1000
        last = [self.manifest(v) for v in have[-keep:]]
        live = {s["path"].split("/")[1] for m in last for s in self.shards(m)} | {x["name"] for m in last for x in m["lists"]}
        gone = 0
        for part in ("data", "lists", "manifest"):
            d = self._path(f"{self.root}/{part}")
            for s in self._fs.listStatus(d) if self._fs.exists(d) else []:
                name = s.getPath().getName()
                version = int(name[1:-5]) if part == "manifest" and name.startswith("v") else None
                if name not in live and version not in have[-keep:] and s.getModificationTime() <= before and (version is None or version < have[-1]):
                    self._fs.delete(s.getPath(), True)
                    gone += part == "data"
        return gone


def shard(docs: DataFrame, target_bytes: int = TARGET_BYTES, root: str | None = None) -> DataFrame:
    """Append, compact and read back: the documents with the shard that holds each. A store of its own, which no other writer knows, is cleaned at once."""
    store = Store(docs.sparkSession, root or workdir(docs.sparkSession), target_bytes)
    store.append(docs)
    store.compact()
    store.vacuum(older_s=DAY if root else 0)
    return store.read()


def op10(spark, sf_dir: str) -> DataFrame:
    """Query op10: all documents in shards of about 64 MB; per document its shard and characters."""
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "source", F.length("text").cast("long").alias("n_chars"), "shard")
