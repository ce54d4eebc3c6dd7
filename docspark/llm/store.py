"""Durable intermediate tables, document blocks and the packet exchange.

Everything that outlives a job is written below the folder that the session
names in spark.checkpoint.dir, which all executors share; a lost executor costs
recomputation of its tasks only.

Blocks: documents packed into rows of a few megabytes, in a table bucketed by
block id, so each further visit of the texts is a scan without an exchange and
the small per-block answers are dealt to them. Packets: a visit sends, for each
range of the 64-bit hash space, one sorted and difference-coded array; the
owner of the range merges them and answers each sender in its own order.
"""

from __future__ import annotations

import math
import re
import struct
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K

#: Bytes of a block and of a hash range's keys where a task has up to 1 GB; both grow with a task's memory, up to 16 times.
BLOCK_BYTES = 4 << 20
PART_BYTES = 3 << 20
#: Rows of megabytes: a row group ends after some, so neither writers nor readers hold a file's worth of them.
LARGE_ROWS = {"parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 2}
#: Bytes of input that a bucket of the block table is meant to hold, buckets that a task writes to, and most buckets that Spark takes.
BUCKET_BYTES, TASK_BUCKETS, MOST_BUCKETS = 128 << 20, 1, 100_000
#: Packets (blocks times ranges) up to which one level of exchange is used, and blocks a group of the second level has.
MOST_PACKETS, GROUP_BLOCKS = 20_000_000, 1024
#: A row's uid is its block id times this plus its place in the block; a block's id is its task's times TASK_BLOCKS plus its number.
#: The product leaves 23 bits for the task.
BLOCK_ROWS = 1 << 16
TASK_BLOCKS = 1 << 24
MOST_TASKS = 1 << 23


def workdir(spark: SparkSession) -> str:
    """The URI of a fresh folder below the shared one that the session names in spark.checkpoint.dir.

    Where none is set, a local session, which is one process, gets a temporary one; a cluster raises.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not root:
        root = f"file://{tempfile.gettempdir()}/docspark-work"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    # Hadoop writes file:/x, other readers of URIs want file:///x.
    whole = "file://" + whole[5:] if whole.startswith("file:/") and not whole.startswith("file://") else whole
    return f"{whole.rstrip('/')}/llm-{uuid.uuid4().hex}"


def drop_dir(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, name: str, where: str | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it back, cutting its lineage."""
    spark = df.sparkSession
    path = f"{where or workdir(spark)}/{name}"
    binary = any(kind == "binary" for _, kind in df.dtypes)
    df.write.options(**LARGE_ROWS if binary else {}).mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def one_row_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield {n: b.column(k)[i] for k, n in enumerate(b.schema.names)}


@dataclass
class Blocks:
    df: DataFrame
    where: str
    n_docs: int
    n_bytes: int
    #: Ranges of the hash space; with `fine`, coarse ones of so many fine ranges each, and groups of blocks.
    parts: int
    fine: int = 0
    groups: int = 0


BLOCK_FIELDS = "block long, n int, size long, ids array<long>, tags array<long>, offs binary, data binary"


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def _bytes(size: str) -> int:
    """Bytes of a size as Spark writes it (1g, 64mb, 4096b)."""
    n, unit = re.fullmatch(r"(\d+)([kmgt]?)b?", size.strip().lower()).groups()
    return int(n) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]


def task_scale(spark: SparkSession) -> int:
    """GB of executor memory a core, from 1 to 16."""
    conf = spark.sparkContext.getConf()
    size, cores = conf.get("spark.executor.memory", "1g"), int(conf.get("spark.executor.cores", "1"))
    return max(1, min(16, _bytes(size + "m" * size.isdigit()) // max(1, cores) >> 30))


def _buckets(docs: DataFrame) -> int:
    """Buckets of about BUCKET_BYTES by Spark's estimate of the input, never fewer than shuffle partitions."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(MOST_BUCKETS, size // BUCKET_BYTES)) if size < 1 << 53 else least  # larger estimates are unknown sizes


def bucket_of(block: np.ndarray, buckets: int) -> np.ndarray:
    """Spark's buckets of longs: their Murmur3 hash (x86, 32 bits, seed 42) modulo the buckets."""
    u = np.uint32
    turn = lambda x, r: x << u(r) | x >> u(32 - r)
    h = np.full(len(block), 42, u)
    for half in (block & 0xFFFFFFFF, block >> 32):
        h ^= turn(half.astype(u) * u(0xCC9E2D51), 15) * u(0x1B873593)
        h = turn(h, 13) * u(5) + u(0xE6546B64)
    h ^= u(8)
    h = (h ^ h >> u(16)) * u(0x85EBCA6B)
    h = (h ^ h >> u(13)) * u(0xC2B2AE35)
    return (h ^ h >> u(16)).view(np.int32) % buckets


def block_ids(task: int, buckets: int) -> Iterator[int]:
    """Ids of a task's blocks, chosen so that they fall into TASK_BUCKETS buckets: a task writes so many files.

    If the ids of these buckets are used up, the others follow.
    """
    if task >= MOST_TASKS:
        raise ValueError("block ids hold 2^23 tasks")
    want = [(task * TASK_BUCKETS + j) % buckets for j in range(TASK_BUCKETS)]
    for mine in (True, False):
        for a in range(0, TASK_BLOCKS, 1 << 16):
            ids = task * TASK_BLOCKS + np.arange(a, a + (1 << 16))
            yield from ids[np.isin(bucket_of(ids, buckets), want) == mine].tolist()
    raise ValueError("a task has more than 2^24 blocks")


def pack(docs: DataFrame, id_col: str, text_col: str, tag: Column | None = None, block_bytes: int | None = None, part_bytes: int | None = None, most_packets: int | None = None, apart: int | None = None) -> Blocks:
    """Pack (id, text) rows into a bucketed block table; `tag` is an integer kept beside each row; rows whose tag is `apart` get blocks of their own."""
    spark = docs.sparkSession
    most_packets = MOST_PACKETS if most_packets is None else most_packets
    block_bytes = BLOCK_BYTES * task_scale(spark) if block_bytes is None else block_bytes
    part_bytes = PART_BYTES * task_scale(spark) if part_bytes is None else part_bytes
    buckets = _buckets(docs.select(text_col))
    # A batch for Python ends with the block that fills it, whatever a bucket holds: lowered for the session, as plans run later.
    if _bytes(spark.conf.get(ARROW_BYTES)) > block_bytes:
        spark.conf.set(ARROW_BYTES, block_bytes)
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), (tag if tag is not None else F.lit(0)).cast("long").alias("tag"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        from pyspark import TaskContext

        free = block_ids(TaskContext.get().partitionId(), buckets)
        open_: dict[bool, list] = {}  # ids, tags, texts, bytes and rows of the blocks being filled

        def row(kind: bool) -> pa.RecordBatch:
            ids, tags, texts, _, _ = open_.pop(kind)
            text = pa.concat_arrays(texts)
            buf, offs = K.text_column(text)
            return pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([next(free)], pa.int64()),
                    "n": pa.array([len(text)], pa.int32()),
                    "size": pa.array([len(buf)], pa.int64()),
                    "ids": pa.array([pa.concat_arrays(ids).to_pylist()], pa.list_(pa.int64())),
                    "tags": pa.array([pa.concat_arrays(tags).to_pylist()], pa.list_(pa.int64())),
                    "offs": pa.array([offs.tobytes()], pa.binary()),
                    "data": pa.array([buf.tobytes()], pa.binary()),
                }
            )

        def kinds(b: pa.RecordBatch):
            if apart is None:
                return [(False, b)]
            mine = pc.fill_null(pc.equal(b.column(1), apart), False)
            return [(True, b.filter(mine)), (False, b.filter(pc.invert(mine)))]

        for batch in batches:
            for kind, b in kinds(batch):
                text = b.column(2)
                _, offs = K.text_column(text)
                a = 0
                while a < b.num_rows:
                    ids, tags, texts, size, rows = now = open_.setdefault(kind, [[], [], [], 0, 0])
                    e = int(np.searchsorted(offs, offs[a] + max(0, block_bytes - size), "right")) - 1
                    e = min(b.num_rows, max(e, a + 1 if not size else a), a + BLOCK_ROWS - rows)
                    if e > a:
                        ids.append(b.column(0).slice(a, e - a))
                        tags.append(b.column(1).slice(a, e - a))
                        texts.append(text.slice(a, e - a).cast(pa.large_binary()))
                        now[3:] = [size + int(offs[e] - offs[a]), rows + e - a]
                        a = e
                    if a < b.num_rows or now[3] >= block_bytes:
                        yield row(kind)
        for kind in sorted(open_):
            yield row(kind)

    where = workdir(spark)
    name = "blocks_" + where[-12:]
    (narrow.mapInArrow(run, BLOCK_FIELDS).write.bucketBy(buckets, "block").option("path", f"{where}/blocks").options(**LARGE_ROWS).format("parquet").mode("overwrite").saveAsTable(name))
    df = spark.table(name)
    n, size, n_blocks = df.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    parts = max(48, -(-size // part_bytes))
    if n_blocks * parts <= most_packets:
        return Blocks(df, where, n, size, parts)
    coarse = math.isqrt(parts - 1) + 1
    return Blocks(df, where, n, size, coarse, -(-parts // coarse), -(-n_blocks // GROUP_BLOCKS))


def block_text(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["data"].as_buffer(), np.uint8), np.frombuffer(row["offs"].as_buffer(), np.int64)


PACKET = "part int, block long, data binary"


def packet_batch(block: int, parts: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"part": pa.array(parts, pa.int32()), "block": pa.array([block] * len(parts), pa.int64()), "data": pa.array(blobs, pa.binary())})


def join_fields(*fields: bytes) -> bytes:
    return struct.pack(f"<{len(fields)}I", *map(len, fields)) + b"".join(fields)


def split_fields(b, n: int) -> list[bytes]:
    b = bytes(b)
    sizes, at, out = struct.unpack_from(f"<{n}I", b), 4 * n, []
    for s in sizes:
        out.append(b[at : at + s])
        at += s
    return out


class Census:
    """What the owners of hash ranges do with packets.

    A packet has `sections` of ascending keys with `values` counts each, and a
    second key a row if `pairs`. Equal keys of all senders are united and their
    counts summed; `answer(section, keys, seconds, sums)` gives arrays of small
    numbers for them, which go back to every sender in its own order.
    `first_only` maps an answer that only one of the senders of a key may get to
    what the others get.
    """

    sections, values, pairs = 1, 1, False
    first_only: dict[int, int] = {}

    def answer(self, section: int, keys: np.ndarray, seconds: np.ndarray | None, sums: list[np.ndarray]) -> list[np.ndarray]:
        raise NotImplementedError

    def extra(self, section: int, keys: np.ndarray, sums: list[np.ndarray]) -> bytes | None:
        """Something about a whole range, to be read as block -1."""
        return None

    def encode(self, tables: list[tuple[np.ndarray, np.ndarray | None, list[np.ndarray]]]) -> bytes:
        fields = []
        for keys, seconds, counts in tables:
            fields += [K.pack_sorted(keys), seconds.tobytes() if self.pairs else b"", *(K.pack_counts(c) for c in counts)]
        return join_fields(*fields)

    def packets(self, block: int, tables: list, parts: int) -> pa.RecordBatch:
        """A packet for every range in which the tables have keys."""
        cuts = [K.cut_by_part(t[0], parts) for t in tables]
        use = [p for p in range(parts) if any(c[p + 1] > c[p] for c in cuts)]
        cut = lambda t, c, p: (t[0][c[p] : c[p + 1]], t[1][c[p] : c[p + 1]] if self.pairs else None, [v[c[p] : c[p + 1]] for v in t[2]])
        return packet_batch(block, use, [self.encode([cut(t, c, p) for t, c in zip(tables, cuts, strict=True)]) for p in use])

    def unite(self, blobs: list) -> list[tuple]:
        """For each section: keys, seconds, sums, place of every sent row, offsets of the senders' rows."""
        wide = 2 + self.values
        fields = [split_fields(b, wide * self.sections) for b in blobs]
        out = []
        for k in range(self.sections):
            keys = [K.unpack_sorted(f[wide * k]) for f in fields]
            offs = np.cumsum([0, *map(len, keys)])
            h = np.concatenate(keys)
            seconds = None
            if self.pairs:
                second = np.concatenate([np.frombuffer(f[wide * k + 1], np.uint64) for f in fields])
                order = np.lexsort((second, h))
                new = np.ones(len(h), bool)
                new[1:] = (h[order][1:] != h[order][:-1]) | (second[order][1:] != second[order][:-1])
                place = np.empty(len(h), np.int64)
                place[order] = np.cumsum(new) - 1
                h, seconds = h[order][new], second[order][new]
            else:
                h, place = np.unique(h, return_inverse=True)
            counts = [np.concatenate([K.unpack_counts(f[wide * k + 2 + j], len(x)) for f, x in zip(fields, keys, strict=True)]) for j in range(self.values)]
            out.append((h, seconds, [np.bincount(place, c, len(h)).astype(np.int64) for c in counts], place, offs))
        return out

    def scattered(self, answers: list[list[np.ndarray]], places: list[np.ndarray], offs: list[np.ndarray]) -> list[bytes]:
        """The answers for each sender, all sections' arrays one after another."""
        rows = []
        for a, place in zip(answers, places, strict=True):
            full = [x[place] for x in a]
            if self.first_only and len(place):
                again = np.ones(len(place), bool)
                again[np.unique(place, return_index=True)[1]] = False
                for one, rest in self.first_only.items():
                    full[0][again & (full[0] == one)] = rest
            rows.append(full)
        return [join_fields(*(K.pack_counts(x[o[i] : o[i + 1]]) for full, o in zip(rows, offs, strict=True) for x in full)) for i in range(len(offs[0]) - 1)]

    def read(self, blob, sizes: list[int], arrays: int = 1) -> list[list[np.ndarray]]:
        """A sender's answers: for each section its arrays."""
        fields = split_fields(blob, arrays * self.sections)
        return [[K.unpack_counts(f, n) for f in fields[k * arrays : (k + 1) * arrays]] for k, n in enumerate(sizes)]

    #: Arrays that `answer` gives for a section.
    arrays = 1


def _group(table: pa.Table) -> tuple[list[int], list]:
    """Senders in ascending order and their blobs."""
    table = table.combine_chunks()
    order = np.argsort(table.column("block").to_numpy(), kind="stable")
    return [int(table.column("block")[int(i)].as_py()) for i in order], [table.column("data")[int(i)].as_buffer() for i in order]


def _packets(part: int, rows: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table({"part": pa.array([part] * len(rows), pa.int32()), "block": pa.array([x[0] for x in rows], pa.int64()), "data": pa.array([x[1] for x in rows], pa.binary())})


def own_range(requests: DataFrame, merge: Callable[[int, list[int], list[bytes]], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """Deal packets to the owners of their ranges; merge(part, blocks, blobs) answers (block, blob)."""

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py() if table.num_rows else 0
        return _packets(part, list(merge(part, *_group(table))))

    return requests.groupBy("part").applyInArrow(run, PACKET)


def exchange(requests: DataFrame, census: Census, blocks: Blocks, name: str, once: bool = False) -> DataFrame:
    """Answers (part, block, data) to packets; written to the shared folder unless they are read `once` only.

    With few packets the owners of the ranges answer the blocks. Beyond
    MOST_PACKETS their number, blocks times ranges, is brought down by a second
    level: coarse ranges of a group of blocks are united first, and only these
    unions go to the owners of the fine ranges.
    """

    def merge(part, senders, blobs):
        united = census.unite(blobs)
        answers = []
        for k, (keys, seconds, sums, _, _) in enumerate(united):
            answers.append(census.answer(k, keys, seconds, sums))
            extra = census.extra(k, keys, sums)
            if extra is not None:
                yield -1, extra
        yield from zip(senders, census.scattered(answers, [u[3] for u in united], [u[4] for u in united]), strict=True)

    if not blocks.fine:
        answers = own_range(requests, merge)
        return answers if once else materialize(answers, name, blocks.where)
    fine, groups, parts = blocks.fine, blocks.groups, blocks.parts

    def union(table: pa.Table) -> pa.Table:
        """Row part -1 keeps what the group needs to hand answers on; the others are packets for fine ranges."""
        part, group = table.column("part")[0].as_py(), table.column("grp")[0].as_py()
        senders, blobs = _group(table)
        united = census.unite(blobs)
        me = part * groups + group
        keep = join_fields(np.array(senders, np.int64).tobytes(), *(x for _, _, _, place, offs in united for x in (place.astype(np.int64).tobytes(), offs.astype(np.int64).tobytes())))
        low, high = (part << 64) // parts, ((part + 1) << 64) // parts
        edges = np.array([low + (high - low) * f // fine for f in range(1, fine)], dtype=object).astype(np.uint64) if fine > 1 else np.zeros(0, np.uint64)
        cuts = [np.concatenate(([0], np.searchsorted(u[0], edges), [len(u[0])])) for u in united]
        rows = [(-1, keep)]
        for f in range(fine):
            if any(c[f + 1] > c[f] for c in cuts):
                rows.append((part * fine + f, census.encode([(u[0][c[f] : c[f + 1]], u[1][c[f] : c[f + 1]] if census.pairs else None, [v[c[f] : c[f + 1]] for v in u[2]]) for u, c in zip(united, cuts, strict=True)])))
        return pa.table({"part": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([me] * len(rows), pa.int64()), "data": pa.array([r[1] for r in rows], pa.binary())})

    coarse = requests.withColumn("grp", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"))
    united = materialize(coarse.groupBy("part", "grp").applyInArrow(union, PACKET), f"{name}_united", blocks.where)
    answered = materialize(own_range(united.where("part >= 0"), merge), f"{name}_fine", blocks.where)

    def hand_on(batches):
        for row in one_row_batches(batches):
            me = row["block"].as_py()
            part = me // groups
            kept = split_fields(row["data"].as_buffer(), 1 + 2 * census.sections)
            senders = np.frombuffer(kept[0], np.int64).tolist()
            places = [np.frombuffer(kept[1 + 2 * k], np.int64) for k in range(census.sections)]
            offs = [np.frombuffer(kept[2 + 2 * k], np.int64) for k in range(census.sections)]
            found = sorted(answers_of(row).items())
            arrays = census.arrays
            fields = [split_fields(blob, arrays * census.sections) for _, blob in found]
            answers = [[np.concatenate([_counts(f[k * arrays + j]) for f in fields]) for j in range(arrays)] for k in range(census.sections)]
            yield packet_batch_of(part, senders, census.scattered(answers, places, offs))

    back = united.where("part = -1").select("block", "data").join(answered.where("block >= 0").groupBy("block").agg(F.collect_list(F.struct("part", "data")).alias("answers")), "block")
    out = back.mapInArrow(hand_on, PACKET).union(answered.where("block = -1").select("part", "block", "data"))
    return out if once else materialize(out, name, blocks.where)


def _counts(b: bytes) -> np.ndarray:
    """Counts of `pack_counts` whose number isn't known: a byte each, and eight more for every 255."""
    raw = np.frombuffer(b, np.uint8)
    # n bytes, m of them 255, and 8 m more: n + 8 m = len(b); m is found by counting from the front.
    n, full = len(raw), np.cumsum(raw == 255)
    at = np.flatnonzero(np.arange(1, n + 1) + 8 * full == n)
    return K.unpack_counts(b, int(at[0]) + 1) if len(at) else np.zeros(0, np.int64)


def packet_batch_of(part: int, blocks: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"part": pa.array([part] * len(blocks), pa.int32()), "block": pa.array(blocks, pa.int64()), "data": pa.array(blobs, pa.binary())})


def visit(blocks: Blocks, answers: DataFrame | None, keep_all: bool = True) -> DataFrame:
    """Blocks with their answers (column `answers`: the packets by part); only answers move."""
    if answers is None:
        return blocks.df.withColumn("answers", F.lit(None).cast("array<struct<part:int,data:binary>>"))
    got = answers.where("block >= 0").groupBy("block").agg(F.collect_list(F.struct("part", "data")).alias("answers"))
    return blocks.df.join(got, "block", "left" if keep_all else "inner")


def answers_of(row: dict) -> dict[int, bytes]:
    a = row["answers"]
    return {x["part"]: x["data"] for x in a.as_py()} if a.is_valid else {}
