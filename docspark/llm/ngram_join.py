"""Near duplicates by an exact Jaccard join of word-shingle sets.

Prefix filtering under several global orders. Two sets can only reach the
threshold if their prefixes (the first n - ceil(t n) + 1 members) share a member
under every global order of the shingles. Order 1 is by document frequency over
the whole corpus, rarest first, and makes the candidates; orders 2 and 3 are
independent hash orders. A set without a member known to others in any of its
prefixes has no partner and drops out at once; a candidate pair must share a member
of the prefixes of both hash orders, which is tested on the prefixes alone, before
any whole set is sent for verification.

Work stays linear around hot groups: equal sets form one class; the holders of
one prefix member are first verified against one of them only; connected
components are formed, and holders outside their list's main component meet a
few other members, until the pairs of holders in different components are few.
Those are enumerated exhaustively, so no link between components is missed while
pairs inside a component are not emitted.

Shingles are compared by 64-bit hash. Defined cases: null or empty text has an
empty set and links with nothing; fewer words than a shingle make one shingle
of the whole sequence; repeated rows are documents of one class; a null doc_id
takes part but is never a smallest id; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .components import components
from .store import BLOCK_ROWS, PACKET, Blocks, Census, answers_of, block_text, exchange, materialize, one_row_batches, pack, visit

#: Rounds in which holders meet chosen members only, while the pairs left exceed a few a posting and keep falling.
HUB_ROUNDS = 4
#: 64-bit words of the bitmaps that bound the difference of two sets.
WORDS = 8
#: Salts of the hash orders after the frequency order.
ORDERS = (np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0x3C79AC492BA7B653))


def shingles(buf: np.ndarray, offs: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(document index, hash) of the distinct shingles, sorted within each document."""
    buf = K.LOWER[buf]
    starts, ends, at = K.word_spans(buf, offs)
    h = K.Rolling(buf).spans(starts, ends)
    count = np.diff(at)
    doc = np.repeat(np.arange(len(count)), count)
    g = K.grams(h, words)
    whole = np.flatnonzero(np.arange(len(g)) + words <= at[doc[: len(g)] + 1]) if len(g) else np.zeros(0, np.int64)
    docs, hashes = [doc[whole]], [g[whole]]
    for n in range(1, words):
        short = np.flatnonzero(count == n)
        if len(short):
            docs.append(short)
            hashes.append(K.mix(K.grams(h, n)[at[short]] ^ np.uint64(n)))
    d, x = np.concatenate(docs), np.concatenate(hashes)
    if len(docs) > 1:
        order = np.argsort(d, kind="stable")
        d, x = d[order], x[order]
    return K.distinct_sorted(d, x)


def _needed(n, percent: int):
    """Least overlap that a set of n needs with any set it links to."""
    return -(-percent * n // 100)


def _set_keys(blocks: Blocks, words: int) -> DataFrame:
    def run(batches):
        for row in one_row_batches(batches):
            buf, offs = block_text(row)
            block, ids, tags = row["block"].as_py(), pa.array(row["ids"].values), pa.array(row["tags"].values)
            for a, b, part, po in K.chunks(buf, offs):
                d, h = shingles(part, po, words)
                n = np.bincount(d, minlength=b - a)
                keys = []
                for salt in (np.uint64(0), np.uint64(0x5851F42D4C957F2D)):
                    s = np.zeros(b - a, np.uint64)
                    if len(d):
                        first = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
                        s[d[first]] = np.add.reduceat(K.mix(h ^ salt) if salt else h, first)
                    keys.append(pa.array(s.view(np.int64)))
                uid = block * BLOCK_ROWS + np.arange(a, b)
                yield pa.RecordBatch.from_pydict({"uid": pa.array(uid), "id": ids.slice(a, b - a), "text_hash": tags.slice(a, b - a), "n": pa.array(n.astype(np.int64)), "k1": keys[0], "k2": keys[1]})

    return blocks.df.select("block", "ids", "tags", "offs", "data").mapInArrow(run, "uid long, id long, text_hash long, n long, k1 long, k2 long")


def _chosen(row: dict, words: int):
    """Distinct shingles of the block's class representatives, by chunk."""
    buf, offs = block_text(row)
    reps = np.zeros(len(offs) - 1, bool)
    reps[np.array(row["reps"].as_py(), np.int64)] = True
    for a, b, part, po in K.chunks(buf, offs):
        if reps[a:b].any():
            d, h = shingles(part, po, words)
            use = reps[a:b][d]
            yield a, d[use], h[use]


def _block_counts(row: dict, words: int) -> tuple[np.ndarray, np.ndarray]:
    found = [h for _, _, h in _chosen(row, words)]
    return np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


class Frequencies(Census):
    """Classes that hold a shingle, 255 for more."""

    def answer(self, section, keys, seconds, sums):
        return [np.minimum(sums[0], 255)]


FREQUENCIES = Frequencies()


def parity_bitmap(x: np.ndarray) -> np.ndarray:
    """Bits by hash, each the parity of its members: two sets differ in at least as many members as their bitmaps in bits."""
    bits = np.bincount((K.mix(x ^ ORDERS[0]) & np.uint64(64 * WORDS - 1)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def _survivors(reps: DataFrame, parts: int, words: int, percent: int) -> DataFrame:
    """Sets that can have a partner, with their prefixes under the three orders: members seen in no other class are misses for all and left out."""

    def run(batches):
        for row in one_row_batches(batches):
            got = answers_of(row)
            known, _ = _block_counts(row, words)
            cut = K.cut_by_part(known, parts)
            df = np.concatenate([FREQUENCIES.read(got[p], [int(cut[p + 1] - cut[p])])[0][0] for p in range(parts) if cut[p + 1] > cut[p]] or [np.zeros(0, np.int64)])
            block = row["block"].as_py()
            out = {k: [] for k in ("uid", "n", "members", "prefix", "places", "bitmap", "second", "third")}
            for a, d, h in _chosen(row, words):
                f = df[np.searchsorted(known, h)]
                bounds = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1], [True])))
                alone = np.add.reduceat((f == 1).astype(np.int64), bounds[:-1])
                size = np.diff(bounds)
                for k in np.flatnonzero(alone <= size - _needed(size, percent)):
                    x, g = h[bounds[k] : bounds[k + 1]], f[bounds[k] : bounds[k + 1]]
                    n = len(x)
                    p = n - _needed(n, percent) + 1
                    others = [hash_prefix(x, g > 1, salt, p) for salt in ORDERS]
                    if not all(map(len, others)):
                        continue
                    out["second"].append(others[0])
                    out["third"].append(others[1])
                    place = np.argsort(g, kind="stable")[:p]
                    shared = np.flatnonzero(g[place] > 1)
                    out["uid"].append(block * BLOCK_ROWS + a + int(d[bounds[k]]))
                    out["n"].append(n)
                    out["members"].append(x.tobytes())
                    out["prefix"].append(x[place[shared]].view(np.int64))
                    out["places"].append(shared.astype(np.int32))
                    out["bitmap"].append(parity_bitmap(x))
            yield pa.RecordBatch.from_pydict(
                {
                    "uid": pa.array(out["uid"], pa.int64()),
                    "n": pa.array(out["n"], pa.int64()),
                    "members": pa.array(out["members"], pa.binary()),
                    "prefix": pa.array(out["prefix"], pa.list_(pa.int64())),
                    "places": pa.array(out["places"], pa.list_(pa.int32())),
                    "bitmap": pa.array(out["bitmap"], pa.list_(pa.int64())),
                    "second": pa.array(out["second"], pa.list_(pa.int32())),
                    "third": pa.array(out["third"], pa.list_(pa.int32())),
                }
            )

    return reps.mapInArrow(run, "uid long, n long, members binary, prefix array<long>, places array<int>, bitmap array<long>, second array<int>, third array<int>")


def hash_prefix(x: np.ndarray, known: np.ndarray, salt: np.uint64, p: int) -> np.ndarray:
    """Half the bits of the first p members in a hash order, of those that are `known` elsewhere."""
    y = K.mix(x ^ salt)
    first = np.argpartition(y, p - 1)[:p] if p < len(y) else np.arange(len(y))
    return y[first[known[first]]].astype(np.uint32).view(np.int32)


def shared_under_all_orders(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose prefixes share a member under the second and under the third order, too."""
    one = sets.select(F.col("uid").alias("b"), F.col("second").alias("y2"), F.col("third").alias("y3"))
    two = sets.select(F.col("uid").alias("a"), F.col("second").alias("x2"), F.col("third").alias("x3"))
    return pairs.select("a", "b").join(one, "b").join(two, "a").where(F.arrays_overlap("x2", "y2") & F.arrays_overlap("x3", "y3")).select("a", "b")


def verify(pairs: DataFrame, sets: DataFrame, percent: int, name: str, where: str) -> DataFrame:
    """Links (src, dst) of the candidate pairs (a, b): the filters of all orders first, then the whole sets of what is left."""

    def run(batches):
        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            keep = np.zeros(batch.num_rows, bool)
            xs, ys = batch.column("x"), batch.column("y")
            for i in range(batch.num_rows):
                x = np.frombuffer(xs[i].as_buffer(), np.uint64)
                y = np.frombuffer(ys[i].as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_pydict({"src": pa.array(a[keep]), "dst": pa.array(b[keep])})

    # Written, so Spark knows the size and leaves the sets where they are if there are few pairs.
    left = materialize(shared_under_all_orders(pairs, sets), f"candidates_{name}", where)
    one = sets.select(F.col("uid").alias("b"), F.col("members").alias("y"))
    two = sets.select(F.col("uid").alias("a"), F.col("members").alias("x"))
    return materialize(left.join(one, "b").join(two, "a").select("a", "b", "x", "y").mapInArrow(run, "src long, dst long"), f"links_{name}", where)


def _fits(x: str, y: str, percent: int) -> str:
    """Whether sets that share the member at x.place and y.place as their first can reach the threshold.

    The overlap is at most what follows the first shared places. At later shared
    members the bound is lower, so a pair that can reach it passes at its first.
    The bound implies the one on lengths. The bitmaps bound the difference of
    the sets from below.
    """
    apart = " + ".join(f"bit_count({x}.bitmap[{k}] ^ {y}.bitmap[{k}])" for k in range(WORDS))
    return f"{100 + percent} * least({x}.n - {x}.place, {y}.n - {y}.place) >= {percent} * ({x}.n + {y}.n) and {100 + percent} * ({apart}) <= {100 - percent} * ({x}.n + {y}.n)"


def _pairs(x: str, y: str) -> list:
    return [F.least(f"{x}.uid", f"{y}.uid").alias("a"), F.greatest(f"{x}.uid", f"{y}.uid").alias("b")]


def _to_hub(rows: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of each holder (struct x) with its list's hub."""
    return rows.where(f"x.uid <> hub.uid and {_fits('x', 'hub', percent)}").select(*_pairs("x", "hub")).distinct()


def _stars(known: DataFrame) -> DataFrame:
    """Edges (src, dst) of every node to its component's smallest."""
    return known.where("node <> comp").select(F.col("node").alias("src"), F.col("comp").alias("dst"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, text_hash, n_shingles, uid (of the row), class (uid of its set's class), component (least class uid), component_id.

    Links are pairs with 100 * overlap >= percent * union of their shingle sets;
    component_id is the smallest doc_id reachable by links.
    """
    blocks = pack(docs, id_col, text_col, F.xxhash64(text_col))
    where, parts = blocks.where, blocks.parts
    rows = materialize(_set_keys(blocks, words), "rows", where)
    classes = materialize(rows.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("uid").alias("cls"), F.min("id").alias("least")), "classes", where)
    reps = classes.select(F.expr(f"cls div {BLOCK_ROWS}").alias("block"), (F.col("cls") % BLOCK_ROWS).alias("at")).groupBy("block").agg(F.collect_list("at").alias("reps"))
    reps = materialize(reps, "reps", where)
    chosen = blocks.df.join(reps, "block")

    def requests(batches):
        for row in one_row_batches(batches):
            h, n = _block_counts(row, words)
            yield FREQUENCIES.packets(row["block"].as_py(), [(h, None, [n])], parts)

    counted = exchange(chosen.select("block", "reps", "offs", "data").mapInArrow(requests, PACKET), FREQUENCIES, blocks, "frequencies", once=True)
    with_counts = visit(Blocks(chosen, where, 0, 0, parts), counted, keep_all=False).select("block", "reps", "offs", "data", "answers")
    sets = materialize(_survivors(with_counts, parts, words, percent), "survivors", where)

    posting = sets.select("uid", "n", "bitmap", F.explode(F.arrays_zip("prefix", "places")).alias("p")).select("uid", "n", "bitmap", F.col("p.prefix").alias("member"), F.col("p.places").alias("place"))
    hub = posting.groupBy("member").agg(F.count("*").alias("holders"), F.min(F.struct("uid", "n", "place", "bitmap")).alias("hub")).where("holders > 1")
    held = materialize(posting.join(hub.select("member"), "member", "left_semi"), "postings", where)
    n_held, before = held.count(), math.inf
    tried = materialize(_to_hub(held.select("member", F.struct("uid", "n", "place", "bitmap").alias("x")).join(hub.select("member", "hub"), "member"), percent), "tried_0", where)
    links = verify(tried, sets, percent, "0", where)
    for step in range(1, HUB_ROUNDS + 1):
        known = components(links, f"{where}/cc_{step}")
        comp = known.withColumnRenamed("node", "uid")
        now = materialize(held.join(comp, "uid", "left").withColumn("comp", F.coalesce("comp", "uid")), f"held_{step}", where)
        lists = now.groupBy("member", "comp").agg(F.count("*").alias("k")).groupBy("member").agg(F.count("*").alias("comps"), F.sum("k").alias("all"), F.max(F.struct("k", "comp")).alias("main")).where("comps > 1")
        lists = materialize(lists.select("member", "all", F.col("main.k").alias("k"), F.col("main.comp").alias("main")), f"lists_{step}", where)
        open_ = now.join(lists.select("member", "main"), "member")
        pairs_left = lists.agg(F.coalesce(F.sum((F.col("all") - F.col("k")) * F.col("all")), F.lit(0))).first()[0]
        if pairs_left <= 4 * n_held or pairs_left > 0.7 * before or step == HUB_ROUNDS:
            break
        before = pairs_left
        #: A list's strays meet a member of its main component and any member, other ones for each list and round.
        row = F.struct("uid", "n", "place", "bitmap")
        pick = open_.groupBy("member").agg(F.min_by(row, F.xxhash64("uid", "member", F.lit(2 * step))).alias("any"), F.min_by(row, F.when(F.col("comp") == F.col("main"), F.xxhash64("uid", "member", F.lit(2 * step + 1)))).alias("of_main"))
        pick = pick.select("member", F.explode(F.array("any", "of_main")).alias("hub"))
        met = open_.where("comp <> main").select("member", row.alias("x")).join(pick, "member")
        new = materialize(_to_hub(met, percent).join(tried, ["a", "b"], "left_anti"), f"tried_{step}", where)
        tried = tried.union(new)
        # A component goes on as its star, so later rounds don't walk its links again.
        links = _stars(known).union(verify(new, sets, percent, str(step), where))

    x, y = open_.where("comp <> main").alias("x"), open_.alias("y")
    cross = x.join(y, F.expr(f"x.member = y.member and x.comp <> y.comp and (y.comp = y.main or x.uid < y.uid) and {_fits('x', 'y', percent)}")).select(*_pairs("x", "y")).distinct()
    rest = materialize(cross.join(tried, ["a", "b"], "left_anti"), "rest", where)
    more = verify(rest, sets, percent, "rest", where)
    comp = components(_stars(known).union(more), where + "/cc")

    by_class = classes.join(comp, classes.cls == comp.node, "left").withColumn("comp", F.coalesce("comp", "cls"))
    by_class = materialize(by_class.select("cls", "least", "comp", "k1", "k2", "n", F.col("node").isNotNull().alias("linked")), "by_class", where)
    best = by_class.where("linked").groupBy("comp").agg(F.min("least").alias("component"))
    named = by_class.join(best, "comp", "left").select("k1", "k2", "n", "cls", "comp", F.coalesce("component", "least").alias("named"))
    named = materialize(named, "named", where)
    out = rows.join(named, ["k1", "k2", "n"], "left")
    return out.select(F.col("id").alias("doc_id"), "text_hash", F.col("n").alias("n_shingles"), "uid", F.coalesce("cls", "uid").alias("class"), F.coalesce("comp", "uid").alias("component"), F.coalesce("named", "id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """Rows of docs, one of each component: a row of its smallest id. Texts without words all stay."""
    found = near_duplicates(docs, id_col, text_col, words, percent)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "uid", "text_hash")  # a null id comes last
    first = found.where("n_shingles > 0").groupBy("component").agg(F.min(order).alias("x")).select("x.doc_id", "x.text_hash")
    stays = first.union(found.where("n_shingles = 0").select("doc_id", "text_hash")).groupBy("doc_id", "text_hash").agg(F.count("*").alias("__rows"))
    stays = stays.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "__rows")
    rows = docs.withColumn("__key", F.xxhash64(text_col))
    both = rows.join(stays, (F.col("__key") == F.col("__hash")) & F.col(id_col).cast("long").eqNullSafe(F.col("__id")))
    place = F.row_number().over(Window.partitionBy("__hash", "__id").orderBy(F.lit(0)))
    return both.withColumn("__place", place).where("__place <= __rows").select(*docs.columns)


def op6(spark, sf_dir: str) -> DataFrame:
    """Query op6: components of all documents at 80 % overlap of 5-word shingles."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, sym.b FROM reach r JOIN sym ON sym.a = r.other)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) r ON r.doc_id = d.doc_id
"""
