"""Embedding near-duplicates by NN-descent.

1. Equal vectors form one node with a multiplicity; invalid ones (null, zero,
   null or non-finite components) take no part. Vectors of different lengths
   never link.
2. A first graph joins the nearest of a bucket in several tables of random
   hyperplane codes; a bucket is cut into pieces of about PIECE nodes. The tables
   grow with log n, so that a pair at the threshold meets with probability `recall`.
3. Descent, until the lists no longer change (fewer than STOP of their entries are
   new): every node introduces its neighbours, forward and reverse, to each other, of
   whom at least one is new in a list; a pair that beats either one's worst neighbour
   enters its list of K. Long reverse lists are cut into pieces, too. Links among
   nodes that met count outside the lists of K as well: each piece keeps a spanning
   forest.
4. Nodes whose K neighbours all reach the threshold are saturated, and so are their
   components. The recall of links is audited by brute force as the mean over nodes
   that have links, apart for nodes outside saturated components (OUTSIDE x AUDIT
   of them in hash order, four times as many while fewer than LINKED of them have
   links and more nodes are left), for such nodes with a link found, and inside
   (AUDIT); the least counts. Below `recall`,
   more tables and rounds follow, up to ROUNDS of them; then every node's component
   is taken as saturated, which makes the result exact. So no result is below
   `recall` as audited.
5. Saturated components are compared with one another exactly, block by block;
   blocks whose balls (a member and the largest angle to it) are too far apart to
   link are left out. Then lists are enlarged to the whole component: its members
   are dealt to tiles of up to TILE x TILE, each pair of blocks once, that keep counts
   only. A member of a component of m is sent to m / TILE tiles.

Cosines are computed in double precision. Defined cases: an empty table gives an
empty result; rows that repeat are vectors of their own, linked to each other; a
null vec_id takes part but is never a smallest id, and its row is not kept;
labels and other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .store import materialize, workdir

THRESHOLD = 0.95
NEIGHBOURS = 8
TABLES = 6
PIECE = 128
BLOCK = 1024
AUDIT, RECALL, ROUNDS = 256, 0.97, 4
OUTSIDE, LINKED = 16, 64
#: Bytes of audited vectors that the driver sends along.
AUDIT_BYTES = 32 << 20
STOP = 0.005
TILE, TILE_BYTES = 4096, 4 << 20
#: Sizes of large components that are broadcast, 16 bytes each.
BROADCAST_SIZES = 100_000
#: Balls larger than this many bytes are compared in slices.
BALL_BYTES = 32 << 20

#: tree: an edge of a piece's spanning forest of links, not of the lists.
GRAPH = "src long, dst long, sim double, tree boolean"


def unit_rows(v: pa.Array, dtype: str) -> np.ndarray:
    """Matrix of unit rows in double precision from a column of raw vectors of one length."""
    if isinstance(v, pa.ChunkedArray):
        v = v.combine_chunks()
    x = np.frombuffer(b"".join(x.as_buffer() for x in v), dtype).reshape(len(v), -1).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (child, parent) of a spanning forest of the symmetric relation `near`."""
    child, parent = [], []
    left = near.any(1)
    while left.any():
        front = np.array([left.argmax()])
        left[front] = False
        while len(front):
            reach = near[front]
            new = np.flatnonzero(reach.any(0) & left)
            child.append(new)
            parent.append(front[reach[:, new].argmax(0)])
            left[new] = False
            front = new
    none = np.zeros(0, np.int64)
    return np.concatenate(child or [none]), np.concatenate(parent or [none])


def _table(uid, a, b, s, threshold: float) -> pa.Table:
    """Edges of the lists, a to b, and the spanning forest of all links of the similarities s."""
    near = s >= threshold
    np.fill_diagonal(near, False)
    x, y = _forest(near)
    src, dst = np.concatenate((a, x)), np.concatenate((b, y))
    tree = np.arange(len(src)) >= len(a)
    return pa.table({"src": pa.array(uid[src], pa.int64()), "dst": pa.array(uid[dst], pa.int64()), "sim": pa.array(s[src, dst], pa.float64()), "tree": pa.array(tree)})


EMPTY = pa.table({"src": pa.array([], pa.int64()), "dst": pa.array([], pa.int64()), "sim": pa.array([], pa.float64()), "tree": pa.array([], pa.bool_())})


def raw_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, str]:
    """(uid, vec_id, v, dim): v is null for vectors that link with nothing; and the numpy type of v."""
    kind = vectors.schema[vector_col].dataType.simpleString()
    dtype = "<f4" if kind == "array<float>" else "<f8"
    rows = vectors.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>" if dtype == "<f4" else "array<double>").alias("v"))

    def run(batches):
        for b in batches:
            out, dim = [], []
            for x in b.column(2):
                y = None
                if x.is_valid and not x.values.null_count:
                    a = x.values.to_numpy(zero_copy_only=False).astype(dtype)
                    if len(a) and np.isfinite(a).all() and a.any():
                        y = (a + 0).tobytes()  # -0 becomes 0
                out.append(y)
                dim.append(len(x) if x.is_valid else 0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary()), pa.array(dim, pa.int32())], ["uid", "vec_id", "v", "dim"])

    return rows.mapInArrow(run, "uid long, vec_id long, v binary, dim int"), dtype


def code_bits(n: int) -> int:
    return max(0, min(30, round(math.log2(max(n, 1) / (PIECE / 2)))))


def tables_needed(n: int, threshold: float, recall: float) -> int:
    """Tables in which a pair at the threshold shares a bucket at least once with probability `recall`; TABLES at least."""
    meets = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** code_bits(n)
    if meets >= 1 or recall >= 1:
        return TABLES
    return max(TABLES, math.ceil(math.log(1 - recall) / math.log(1 - meets)))


def bucket_graph(nodes: DataFrame, dtype: str, n: int, tables: range, k: int, threshold: float) -> DataFrame:
    """Edges to the nearest k / 2 of each piece of each bucket, to the nearest k if they are links, and the links' forest."""
    bits = code_bits(n)

    def code(batches):
        for b in batches:
            if not b.num_rows:
                continue
            dims = b.column("dim").to_numpy()
            for d in np.unique(dims):
                mine = b.filter(pa.array(dims == d))
                x = unit_rows(mine.column("v"), dtype)
                for t in tables:
                    planes = np.random.Generator(np.random.PCG64([t, int(d)])).standard_normal((int(d), bits))
                    key = ((x @ planes > 0) @ (1 << np.arange(bits))).astype(np.int64) if bits else np.zeros(len(x), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), mine.column("dim"), pa.array(key), mine.column("uid"), mine.column("v")], ["t", "dim", "code", "uid", "v"])

    coded = nodes.select("uid", "v", "dim").mapInArrow(code, "t int, dim int, code long, uid long, v binary")
    #: Only buckets that must be cut are looked up; there are at most rows / PIECE of them.
    sizes = coded.groupBy("t", "dim", "code").agg(F.count("*").alias("size")).where(f"size > {PIECE}")
    cut = F.coalesce(F.pmod(F.xxhash64("uid", "t"), F.ceil(F.col("size") / PIECE)), F.lit(0))
    pieces = coded.join(sizes, ["t", "dim", "code"], "left").withColumn("piece", cut)

    def nearest(table: pa.Table) -> pa.Table:
        uid, x = table.column("uid").to_numpy(), unit_rows(table.column("v"), dtype)
        m = min(k, len(uid) - 1)
        if m < 1:
            return EMPTY
        s = x @ x.T
        np.fill_diagonal(s, -2)
        top = np.argpartition(-s, m - 1, axis=1)[:, :m]
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1), 1)
        rows, rank = np.indices(top.shape)
        keep = (rank < k // 2) | (s[rows, top] >= threshold)
        return _table(uid, rows[keep], top[keep], s, threshold)

    return pieces.groupBy("t", "dim", "code", "piece").applyInArrow(nearest, GRAPH)


def best(edges: DataFrame, k: int) -> DataFrame:
    """The k best distinct neighbours of each node; `new` stays unless one of the equal edges is old."""
    w = Window.partitionBy("src").orderBy(F.desc("sim"), "dst")
    return edges.groupBy("src", "dst").agg(F.max("sim").alias("sim"), F.min("new").alias("new")).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


def descend(graph: DataFrame, nodes: DataFrame, dtype: str, k: int, threshold: float) -> DataFrame:
    """New edges found by introducing each node's neighbours to one another, one of whom is new, and the forest of their links."""
    worst = graph.groupBy("src").agg(F.when(F.count("*") >= k, F.min("sim")).otherwise(-2.0).alias("worst"))
    meet = graph.select(F.col("src").alias("u"), F.col("dst").alias("w"), "new").union(graph.select("dst", "src", "new")).groupBy("u", "w").agg(F.max("new").alias("new"))
    # Of nodes without a new neighbour no one is introduced.
    meet = meet.join(graph.where("new").select(F.explode(F.array("src", "dst")).alias("u")).distinct(), "u", "left_semi")
    degree = meet.groupBy("u").agg(F.count("*").alias("size")).where(f"size > {PIECE}")
    meet = meet.join(degree, "u", "left").withColumn("piece", F.coalesce(F.pmod(F.xxhash64("w"), F.ceil(F.col("size") / PIECE)), F.lit(0)))
    who = nodes.select(F.col("uid").alias("w"), "v").join(worst.withColumnRenamed("src", "w"), "w", "left").withColumn("worst", F.coalesce("worst", F.lit(-2.0)))
    guests = meet.select("u", "piece", "w", "new").join(who, "w")

    def introduce(table: pa.Table) -> pa.Table:
        uid, worst = table.column("w").to_numpy(), table.column("worst").to_numpy()
        if len(uid) < 2:
            return EMPTY
        x = unit_rows(table.column("v"), dtype)
        s = x @ x.T
        new = np.array(table.column("new").to_pylist(), bool)
        a, b = np.nonzero((s > worst[:, None] + 1e-12) & (new[:, None] | new[None, :]) & ~np.eye(len(uid), dtype=bool))
        return _table(uid, a, b, s, threshold)

    return guests.groupBy("u", "piece").applyInArrow(introduce, GRAPH)


def true_links(nodes: DataFrame, queries: list[tuple[int, bytes]], dtype: str, threshold: float) -> DataFrame:
    """Brute-force links (src, dst) of a bounded set of query nodes."""
    by_dim: dict[int, list[tuple[int, bytes]]] = {}
    for q in queries:
        by_dim.setdefault(len(q[1]), []).append(q)
    mats = {d: (np.array([i for i, _ in q]), unit_rows(pa.array([v for _, v in q], pa.binary()), dtype)) for d, q in by_dim.items()}

    def run(batches):
        for b in batches:
            sizes = np.array([len(x.as_buffer()) for x in b.column("v")])
            for d, (ids, m) in mats.items():
                mine = np.flatnonzero(sizes == d)
                if len(mine):
                    uid = b.column("uid").to_numpy()[mine]
                    x = unit_rows(b.column("v").take(pa.array(mine)), dtype).T
                    for a in range(0, len(ids), AUDIT):
                        q, j = np.nonzero(m[a : a + AUDIT] @ x >= threshold)
                        src = ids[a + q]
                        keep = src != uid[j]
                        yield pa.RecordBatch.from_pydict({"src": pa.array(src[keep]), "dst": pa.array(uid[j][keep])})

    return nodes.select("uid", "v").mapInArrow(run, "src long, dst long")


def audit(nodes: DataFrame, comp: DataFrame, saturated: DataFrame, links: DataFrame, dtype: str, threshold: float, where: str) -> float | None:
    """Mean recall over audited nodes with links; the least of those outside and inside saturated components and of those with a link found; None if no link is seen.

    Saturated components will be compared with one another, so links between their members count as found.
    """
    inside = comp.join(saturated, "comp", "left_semi").select(F.col("node").alias("uid"), F.lit(True).alias("sat"))
    has = links.select(F.col("src").alias("uid")).distinct().withColumn("linked", F.lit(True))
    placed = nodes.select("uid", "v", "sha").join(inside, "uid", "left").join(has, "uid", "left")
    placed = materialize(placed.select("uid", "v", F.xxhash64("sha").alias("first"), F.coalesce("sat", F.lit(False)).alias("sat"), F.coalesce("linked", F.lit(False)).alias("linked")), "placed", where)
    longest = placed.agg(F.max(F.length("v"))).first()[0] or 1

    def chosen(which: str, most: int) -> list[tuple[int, bytes]]:
        most = max(1, min(most, AUDIT_BYTES // longest))
        return [(r.uid, bytes(r.v)) for r in placed.where(which).orderBy("first", "uid").limit(most).select("uid", "v").toLocalIterator()]

    def asked(which: str, most: int, name: str):
        """(audited nodes, those of them with links, their mean recall)."""
        queries = chosen(which, most)
        truth = materialize(true_links(nodes, queries, dtype, threshold), name, where)
        both = truth.join(placed.select(F.col("uid").alias("src"), F.col("sat").alias("ss")), "src").join(placed.select(F.col("uid").alias("dst"), F.col("sat").alias("ds")), "dst")
        both = both.join(links.withColumn("hit", F.lit(True)), ["src", "dst"], "left")
        found = F.when(F.coalesce("hit", F.lit(False)) | (F.col("ss") & F.col("ds")), 1.0).otherwise(0.0)
        linked, r = both.groupBy("src").agg(F.avg(found).alias("r")).agg(F.count("*"), F.avg("r")).first()
        return len(queries), linked, r

    rates, most, last = [asked("sat", AUDIT, "truth_inside")[2], asked("linked and not sat", OUTSIDE * AUDIT, "truth_linked")[2]], OUTSIDE * AUDIT, -1
    while True:
        seen, linked, rate = asked("not sat", most, f"truth_{most}")
        if linked >= LINKED or seen < most or seen == last:
            break
        most, last = 4 * most, seen
    rates = [r for r in [*rates, rate] if r is not None]
    return min(rates) if rates else None


def _placed(members: DataFrame) -> DataFrame:
    """Members with `blocks`, the number of their component's blocks, and their own block `at`."""
    size = members.groupBy("comp").agg(F.ceil(F.count("*") / (BLOCK // 2)).cast("int").alias("blocks"))
    return members.join(size, "comp").withColumn("at", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))


def cross_links(members: DataFrame, dtype: str, threshold: float, where: str) -> DataFrame:
    """A link (src, dst) of every two blocks of different components of (comp, uid, v) that have any, exactly."""
    placed = materialize(_placed(members).select("comp", "at", "uid", "v"), "placed", where)
    pivot = placed.groupBy("comp", "at").agg(F.min_by("v", "uid").alias("c"))

    def angles(batches):
        for b in batches:
            size = np.array([len(x.as_buffer()) for x in b.column("c")])
            for d in np.unique(size):  # one length a component
                mine = b.filter(pa.array(size == d))
                s = (unit_rows(mine.column("c"), dtype) * unit_rows(mine.column("v"), dtype)).sum(1)
                yield pa.RecordBatch.from_arrays([mine.column("comp"), mine.column("at"), pa.array(np.arccos(np.clip(s, -1, 1)))], ["comp", "at", "r"])

    radius = placed.join(pivot, ["comp", "at"]).select("comp", "at", "c", "v").mapInArrow(angles, "comp long, at int, r double").groupBy("comp", "at").agg(F.max("r").alias("r"))
    balls = materialize(pivot.join(radius, ["comp", "at"]), "balls", where)
    slices = max(1, -(-(balls.agg(F.sum(F.length("c"))).first()[0] or 0) * 2 // BALL_BYTES))
    #: Angles from cosines near 1 are off by up to about 1e-8.
    reach = math.acos(max(-1.0, min(1.0, threshold))) + 1e-6

    def near(part: pa.Table) -> DataFrame:
        mats = {}
        size = np.array([len(x.as_buffer()) for x in part.column("c").combine_chunks()])
        for d in np.unique(size):
            mine = part.filter(pa.array(size == d))
            mats[int(d)] = (mine.column("comp").to_numpy(), mine.column("at").to_numpy(), mine.column("r").to_numpy(), unit_rows(mine.column("c"), dtype))

        def run(batches):
            for b in batches:
                size = np.array([len(x.as_buffer()) for x in b.column("c")])
                for d, (comp, at, r, m) in mats.items():
                    mine = b.filter(pa.array(size == d))
                    if not mine.num_rows:
                        continue
                    x, xr, xc, xa = unit_rows(mine.column("c"), dtype), mine.column("r").to_numpy(), mine.column("comp").to_numpy(), mine.column("at").to_numpy()
                    for a in range(0, len(x), AUDIT):
                        far = np.cos(np.minimum(xr[a : a + AUDIT, None] + r[None, :] + reach, math.pi))
                        i, j = np.nonzero((x[a : a + AUDIT] @ m.T >= far) & (xc[a : a + AUDIT, None] < comp[None, :]))
                        yield pa.RecordBatch.from_pydict({"comp": pa.array(xc[a + i]), "at": pa.array(xa[a + i]), "comp2": pa.array(comp[j]), "at2": pa.array(at[j])})

        return balls.mapInArrow(run, "comp long, at int, comp2 long, at2 int")

    pairs = None
    for s in range(slices):
        part = near(balls.where(F.pmod(F.xxhash64("comp", "at"), F.lit(slices)) == s).toArrow())
        pairs = part if pairs is None else pairs.union(part)
    pairs = materialize(pairs, "ball_pairs", where)
    key = ["comp", "at", "comp2", "at2"]
    left = pairs.join(placed, ["comp", "at"]).select(*key, F.lit(True).alias("row"), "uid", "v")
    right = pairs.join(placed.select(F.col("comp").alias("comp2"), F.col("at").alias("at2"), "uid", "v"), ["comp2", "at2"]).select(*key, F.lit(False).alias("row"), "uid", "v")

    def run(table: pa.Table) -> pa.Table:
        row = np.array(table.column("row").to_pylist(), bool)
        uid, x = table.column("uid").to_numpy(), unit_rows(table.column("v"), dtype)
        a, b = np.nonzero(x[row] @ x[~row].T >= threshold)
        return pa.table({"src": pa.array(uid[row][a[:1]], pa.int64()), "dst": pa.array(uid[~row][b[:1]], pa.int64())})

    return left.union(right).groupBy(*key).applyInArrow(run, "src long, dst long")


def tile_rows(bytes_a_vector: int) -> int:
    return max(256, min(TILE, TILE_BYTES // max(1, bytes_a_vector)))


def _exact_counts(members: DataFrame, dtype: str, threshold: float, tile: int) -> DataFrame:
    """(uid, n): multiplicities that each node of (comp, uid, v, mult) links to in its component, itself excluded."""
    #: Only components of more than a tile are looked up; there are at most rows / tile of them.
    size = members.groupBy("comp").agg(F.count("*").alias("k")).where(f"k > {tile}").select("comp", F.ceil(F.col("k") / tile).cast("int").alias("blocks"))
    size = F.broadcast(size) if size.limit(BROADCAST_SIZES + 1).count() <= BROADCAST_SIZES else size
    placed = members.join(size, "comp", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("at", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
    #: Every pair of blocks i <= j once: a member is a row of the tiles (at, j) and a column of (i, at).
    rows = placed.select("comp", F.col("at").alias("i"), F.explode(F.expr("sequence(at, blocks - 1)")).alias("j"), F.lit(True).alias("row"), "uid", "v", "mult")
    columns = placed.where("at > 0").select("comp", F.explode(F.expr("sequence(0, at - 1)")).alias("i"), F.col("at").alias("j"), F.lit(False).alias("row"), "uid", "v", "mult")

    def run(table: pa.Table) -> pa.Table:
        row = np.array(table.column("row").to_pylist(), bool)
        uid, mult = table.column("uid").to_numpy(), table.column("mult").to_numpy()
        x = unit_rows(table.column("v"), dtype)
        n = np.zeros(len(uid), np.int64)
        same = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        mine, others = np.flatnonzero(row), np.flatnonzero(row if same else ~row)
        for a in range(0, len(mine), AUDIT):
            r = mine[a : a + AUDIT]
            near = x[r] @ x[others].T >= threshold
            if same:
                near &= uid[r][:, None] != uid[others][None, :]
            n[r] += near @ mult[others]
            if not same:
                n[others] += mult[r] @ near
        return pa.table({"uid": pa.array(uid), "n": pa.array(n)})

    return rows.union(columns).groupBy("comp", "i", "j").applyInArrow(run, "uid long, n long").groupBy("uid").agg(F.sum("n").alias("n"))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, k: int = NEIGHBOURS, recall: float = RECALL) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id (smallest vec_id reachable by links), kept, audited_recall (null if no audited vector has a link)."""
    spark = vectors.sparkSession
    where = workdir(spark)
    rows, dtype = raw_vectors(vectors, id_col, vector_col)
    rows = materialize(rows, "rows", where).withColumn("sha", F.sha2("v", 256))
    nodes = rows.where("v is not null").groupBy("sha").agg(F.min("uid").alias("uid"), F.min("vec_id").alias("least"), F.first("v").alias("v"), F.first("dim").alias("dim"), F.count("*").alias("mult"))
    nodes = materialize(nodes, "nodes", where)
    n = nodes.count()
    tables = tables_needed(n, threshold, recall)
    longest = nodes.agg(F.max(F.length("v"))).first()[0] or 1
    graph, trees, measured = None, None, None

    def enter(found: DataFrame, name: str) -> None:
        """Take found edges into the lists, and the links' forest."""
        nonlocal graph, trees
        found = materialize(found, f"edges_{name}", where)
        lists, tree = found.where("not tree").select("src", "dst", "sim", F.lit(True).alias("new")), found.where("tree").select("src", "dst")
        graph = materialize(best(lists if graph is None else graph.withColumn("new", F.lit(False)).union(lists), k), f"graph_{name}", where)
        trees = tree if trees is None else trees.union(tree)

    for step in range(ROUNDS):
        enter(bucket_graph(nodes, dtype, n, range(step * tables, (step + 1) * tables), k, threshold), f"{step}")
        turn = 0
        while graph.where("new").count() > STOP * k * n:
            enter(descend(graph, nodes, dtype, k, threshold), f"{step}_{turn}")
            turn += 1
        links = graph.where(F.col("sim") >= threshold)
        #: A saturated node's whole component will be compared, so its links count as found.
        full = links.groupBy("src").agg(F.count("*").alias("c")).where(f"c >= {k}").select("src")
        links = links.select("src", "dst").union(trees)
        links = materialize(links.union(links.select("dst", "src")).distinct(), f"links_{step}", where)
        comp = components(links, f"{where}/cc_{step}")
        saturated = materialize(comp.join(full, comp.node == full.src, "left_semi").select("comp").distinct(), f"saturated_{step}", where)
        measured = audit(nodes, comp, saturated, links, dtype, threshold, f"{where}/audit_{step}")
        if measured is None or measured >= recall:
            break
    exact_all = measured is not None and measured < recall
    if exact_all:
        comp = nodes.select(F.col("uid").alias("node")).join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        comp = materialize(comp, "comp_all", where)
        saturated, measured = comp.select("comp").distinct(), 1.0
    member = comp.join(nodes, comp.node == nodes.uid).select("comp", "uid", "v", "mult", "least")
    met = materialize(cross_links(member.join(saturated, "comp", "left_semi"), dtype, threshold, where), "cross", where)
    if exact_all or met.limit(1).count():
        #: A component goes on as its star; nodes without any link drop out.
        star = comp.where("node <> comp").select(F.col("node").alias("src"), F.col("comp").alias("dst"))
        old, comp = comp, components(star.union(met), f"{where}/cc")
        saturated = materialize(comp.join(old.join(saturated, "comp", "left_semi").select("node"), "node", "left_semi").select("comp").distinct(), "saturated", where)
        member = comp.join(nodes, comp.node == nodes.uid).select("comp", "uid", "v", "mult", "least")
    some = member.join(saturated, "comp", "left_anti").select("uid")
    exact = _exact_counts(member.join(saturated, "comp", "left_semi"), dtype, threshold, tile_rows(longest * (2 if dtype == "<f4" else 1)))
    plain = links.join(some, links.src == some.uid, "left_semi").join(nodes.select(F.col("uid").alias("dst"), "mult"), "dst").groupBy(F.col("src").alias("uid")).agg(F.sum("mult").alias("n"))
    counts = materialize(exact.union(plain), "counts", where)
    name = member.groupBy("comp").agg(F.min("least").alias("component"))
    per_node = nodes.join(counts, "uid", "left").join(comp.withColumnRenamed("node", "uid"), "uid", "left").join(name, "comp", "left")
    per_node = materialize(per_node.select("sha", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "least").alias("component")), "per_node", where)
    out = rows.select("vec_id", "sha").join(per_node, "sha", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"), F.lit(measured).cast("double").alias("audited_recall"))


def op8(spark, sf_dir: str) -> DataFrame:
    """Query op8: all embeddings at cosine 0.95."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).select("vec_id", "n_links", "component_id", "kept")


OP8_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM v),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_dot_product(a.v, b.v) >= 0.95::DOUBLE * a.n * b.n),
reach AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT r.vec_id, links.b FROM reach r JOIN links ON links.a = r.other),
c AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id)
SELECT e.vec_id, coalesce(k.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.vec_id = e.vec_id LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) k ON k.a = e.vec_id
"""
