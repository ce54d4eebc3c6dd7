"""Registered catalog and ingest queries.

Orders are objects or uploads, line items their placements (supplier := agent,
its nation := failure domain), events a log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.operators import catalog as C
from docspark.operators import ingest as I

QUERIES, ORACLE_SQL = {}, {}


def _q(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _placements(spark, d):
    line = _t(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linestatus")
    return line.join(_t(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))


_PLACED = "WITH p AS (SELECT l_orderkey, l_suppkey, l_linestatus, s_nationkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey), dom AS (SELECT l_orderkey, count(DISTINCT CASE WHEN l_linestatus = 'F' THEN s_nationkey END) AS domains FROM p GROUP BY 1) "


@_q("replica_domains", _PLACED + "SELECT * FROM dom")
def replica_domains(spark, d):
    return C.replica_domains(_placements(spark, d), ["l_orderkey"], "s_nationkey", F.col("l_linestatus") == "F")


@_q("replica_floor_missed", _PLACED + "SELECT * FROM dom WHERE domains < 2")
def replica_floor_missed(spark, d):
    return C.below_floor(_placements(spark, d), ["l_orderkey"], "s_nationkey", F.col("l_linestatus") == "F", 2)


@_q(
    "commit_gate",
    _PLACED + """, c AS (SELECT o_custkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS hash, coalesce(domains, 0) AS domains FROM orders LEFT JOIN dom ON l_orderkey = o_orderkey)
SELECT o_custkey, count(*) AS chunks, count(*) FILTER (WHERE hash IS NOT NULL AND domains >= 1) AS ready, count(*) = count(*) FILTER (WHERE hash IS NOT NULL AND domains >= 1) AS committable FROM c GROUP BY 1""",
)
def commit_gate(spark, d):
    dom = replica_domains(spark, d)
    o = _t(spark, d, "orders").join(dom, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    chunks = o.select("o_custkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("hash"), F.coalesce("domains", F.lit(0)).alias("domains"))
    return C.commit_gate(chunks, "o_custkey", 1)


LEGAL = [("signup", "view"), ("view", "click"), ("click", "purchase"), ("view", "view"), ("purchase", "view"), ("error", "view"), ("view", "error")]


@_q(
    "illegal_transitions",
    """
WITH s AS (SELECT user_id, event_type AS state, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events)
SELECT user_id, previous, state, count(*) AS n FROM s WHERE previous IS NOT NULL AND previous || '>' || state NOT IN ('signup>view', 'view>click', 'click>purchase', 'view>view', 'purchase>view', 'error>view', 'view>error') GROUP BY ALL
""",
)
def illegal_transitions(spark, d):
    return C.illegal_moves(_t(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", LEGAL)


@_q("idempotent_requests", "SELECT o_custkey, arg_min(o_orderkey, o_orderkey) AS result, count(*) AS requests, count(DISTINCT o_orderpriority) > 1 AS conflict FROM orders GROUP BY 1")
def idempotent_requests(spark, d):
    return C.idempotent_requests(_t(spark, d, "orders"), "o_custkey", "o_orderpriority", "o_orderkey", "o_orderkey")


@_q("set_once_conflicts", "SELECT l_orderkey, count(DISTINCT l_returnflag) AS n_values FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1")
def set_once_conflicts(spark, d):
    return C.set_once_conflicts(_t(spark, d, "lineitem"), "l_orderkey", "l_returnflag")


@_q("contiguous_ordinals", "SELECT l_orderkey, count(*) AS n, count(*) = count(DISTINCT l_linenumber) AND min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AS contiguous FROM lineitem GROUP BY 1")
def contiguous_ordinals(spark, d):
    return C.contiguous(_t(spark, d, "lineitem"), "l_orderkey", "l_linenumber", 1)


@_q("conversation_turns_contiguous", "SELECT conv_id, count(*) AS n, count(*) = count(DISTINCT turn) AND min(turn) = 0 AND max(turn) = count(*) - 1 AS contiguous FROM conversations GROUP BY 1")
def conversation_turns_contiguous(spark, d):
    return C.contiguous(_t(spark, d, "conversations"), "conv_id", "turn")


@_q("unique_violations", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def unique_violations(spark, d):
    return C.unique_violations(_t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@_q("agents_valid", "SELECT count(*) AS agents, count(DISTINCT s_suppkey) AS n_agents, count(DISTINCT s_nationkey) AS n_domains, count(*) = count(DISTINCT s_suppkey) AND count(*) = count(DISTINCT s_nationkey) AS valid FROM supplier")
def agents_valid(spark, d):
    return C.agents_valid(_t(spark, d, "supplier"), "s_suppkey", "s_nationkey")


@_q("latest_versions", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_quantity DESC, l_extendedprice DESC) = 1")
def latest_versions(spark, d):
    order = [F.desc(c) for c in ("l_shipdate", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")]
    return C.latest(_t(spark, d, "lineitem"), "l_orderkey", order).select("l_orderkey", "l_partkey", "l_quantity")


@_q("log_folded", "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'error'")
def log_folded(spark, d):
    log = _t(spark, d, "events")
    return C.fold_log(log, "user_id", "ts", "event_id", F.col("event_type") == "error").select("user_id", "event_id", "event_type", "value")


@_q("tombstone_ratio", "SELECT CAST(CAST('0x' || substr(md5(user_id::VARCHAR), 1, 8) AS BIGINT) >> 29 AS BIGINT) AS part, count(*) AS ops, round(avg((event_type = 'error')::INT::DOUBLE), 6) AS ratio, round(avg((event_type = 'error')::INT::DOUBLE), 6) > 0.2 AS compact FROM events GROUP BY 1")
def tombstone_ratio(spark, d):
    return C.tombstone_ratio(_t(spark, d, "events"), C.hash_prefix(F.col("user_id"), 3), F.col("event_type") == "error", 0.2)


@_q(
    "partition_split_plan",
    """
WITH h AS (SELECT CAST('0x' || substr(md5(o_orderkey::VARCHAR), 1, 8) AS BIGINT) >> 27 AS half FROM orders)
SELECT half >> 1 AS part, count(*) AS n, count(*) FILTER (WHERE half % 2 = 0) AS low, count(*) FILTER (WHERE half % 2 = 1) AS high, count(*) > 900 AS split FROM h GROUP BY 1
""",
)
def partition_split_plan(spark, d):
    return C.split_plan(_t(spark, d, "orders"), "o_orderkey", 4, 900)


@_q("unreferenced_objects", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_linestatus = 'O')")
def unreferenced_objects(spark, d):
    live = _t(spark, d, "lineitem").where("l_linestatus = 'O'").select(F.col("l_partkey").alias("p_partkey"))
    return C.unreferenced(_t(spark, d, "part").select("p_partkey"), live, "p_partkey")


@_q("replicate_outcomes", "SELECT o_orderkey, count(*) FILTER (WHERE ok) AS copies, count(DISTINCT CASE WHEN ok THEN r_regionkey END) AS domains, count(DISTINCT CASE WHEN ok THEN r_regionkey END) >= 3 AS met FROM (SELECT o_orderkey, r_regionkey, (o_orderkey + r_regionkey) % 7 < 4 AS ok FROM orders, region) GROUP BY 1")
def replicate_outcomes(spark, d):
    ok = (F.col("o_orderkey") + F.col("r_regionkey")) % 7 < 4
    return C.replicate_outcomes(_t(spark, d, "orders").select("o_orderkey"), _t(spark, d, "region").select("r_regionkey"), ok, "o_orderkey", "r_regionkey", 3)


@_q("object_blocks", "SELECT doc_id, CAST(i AS INTEGER) AS ordinal, length(substring(text, i * 4096 + 1, 4096)) AS len, sha256(substring(text, i * 4096 + 1, 4096)) AS hash FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 4096.0) AS BIGINT))) AS i FROM documents)")
def object_blocks(spark, d):
    return C.blocks(_t(spark, d, "documents"), "doc_id", "text", 4096)


@_q("request_fingerprints", "SELECT doc_id, sha256(length(source)::VARCHAR || ':' || source || length(n_chars::VARCHAR)::VARCHAR || ':' || n_chars::VARCHAR || length(lang)::VARCHAR || ':' || lang) AS fingerprint FROM documents")
def request_fingerprints(spark, d):
    return _t(spark, d, "documents").select("doc_id", C.request_fingerprint(F.col("source"), F.col("n_chars"), F.col("lang")).alias("fingerprint"))


@_q("hash_names_valid", "SELECT count(*) AS objects, count(*) FILTER (WHERE regexp_full_match(sha256(text), '[0-9a-f]{64}')) AS valid FROM documents")
def hash_names_valid(spark, d):
    h = F.sha2("text", 256)
    return _t(spark, d, "documents").agg(F.count("*").alias("objects"), F.count(F.when(h.rlike("^[0-9a-f]{64}$"), 1)).alias("valid"))


@_q("download_assembled", "SELECT conv_id, string_agg(text, '' ORDER BY turn, role, text) AS content FROM conversations GROUP BY 1")
def download_assembled(spark, d):
    c = _t(spark, d, "conversations").withColumn("place", F.struct("turn", "role", "text"))
    return C.assemble(c, "conv_id", "place", "text").select("conv_id", F.decode("content", "UTF-8").alias("content"))


@_q("first_valid_replica", "SELECT sha256(text) AS sha, count(*) AS copies, count(*) AS valid FROM documents GROUP BY 1")
def first_valid_replica(spark, d):
    r = _t(spark, d, "documents").select(F.sha2("text", 256).alias("sha"), "source", "text")
    return C.first_valid_replica(r, "sha", "source", "text").select("sha", "copies", "valid")


@_q("encrypted_round_trip", "SELECT doc_id, sha256(text) AS sha, TRUE AS same FROM documents")
def encrypted_round_trip(spark, d):
    """Encrypt each text under a key and IV derived from its id (unique here), decrypt, compare."""
    docs = _t(spark, d, "documents")
    key = F.unhex(F.md5(F.concat(F.lit("key"), "doc_id")))
    iv = F.unhex(F.substring(F.md5(F.concat(F.lit("iv"), "doc_id")), 1, 24))
    aad = F.concat(F.lit("v1|"), F.col("doc_id").cast("string"), F.lit("|"), F.length("text")).cast("binary")
    back = C.decrypt(C.encrypt(F.col("text").cast("binary"), key, iv, aad), key, aad).cast("string")
    return docs.select("doc_id", F.sha2(back, 256).alias("sha"), (back == F.col("text")).alias("same"))


@_q(
    "verify_agents",
    "SELECT s_suppkey, CASE WHEN n.c IS NULL THEN 'silent' WHEN s_nationkey = n.c THEN 'ok' ELSE 'other identity' END AS state FROM supplier LEFT JOIN (SELECT c_custkey AS k, c_nationkey AS c FROM customer WHERE c_acctbal > 0) n ON n.k = s_suppkey",
)
def verify_agents(spark, d):
    got = _t(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("s_suppkey"), F.col("c_nationkey").alias("s_nationkey"))
    return C.verify_agents(_t(spark, d, "supplier").select("s_suppkey", "s_nationkey"), got, "s_suppkey", "s_nationkey")


_OLD = "o_orderdate < TIMESTAMP '1998-01-01'"
_NEW = "o_orderdate >= TIMESTAMP '1996-01-01'"


@_q(
    "ingest_classified",
    f"""
WITH b AS (SELECT o_orderkey, o_totalprice FROM orders WHERE {_OLD}), n AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE {_NEW})
SELECT coalesce(b.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'new' WHEN n.o_orderkey IS NULL THEN 'removed' WHEN b.o_totalprice = n.o_totalprice THEN 'unchanged' ELSE 'changed' END AS state FROM b FULL JOIN n ON b.o_orderkey = n.o_orderkey
""",
)
def ingest_classified(spark, d):
    o = _t(spark, d, "orders")
    b = o.where(_OLD).select("o_orderkey", "o_totalprice")
    n = o.where(_NEW).select("o_orderkey", F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("o_totalprice"))
    return I.classify(b, n, "o_orderkey", F.col("b.o_totalprice") == F.col("n.o_totalprice"))


@_q("ingest_counters", "SELECT state, count(*) AS n FROM (" + ORACLE_SQL["ingest_classified"] + ") GROUP BY state")
def ingest_counters(spark, d):
    return I.counters(ingest_classified(spark, d))


@_q("ingest_upserted", f"SELECT o_orderkey, CASE WHEN {_NEW} THEN 'now' ELSE 'before' END AS version FROM orders WHERE {_NEW} OR {_OLD}")
def ingest_upserted(spark, d):
    o = _t(spark, d, "orders")
    return I.upsert(o.where(_OLD).select("o_orderkey", F.lit("before").alias("version")), o.where(_NEW).select("o_orderkey", F.lit("now").alias("version")), "o_orderkey")


@_q("cascade_kept", "SELECT o_orderkey, count(l_linenumber) AS lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING') GROUP BY 1")
def cascade_kept(spark, d):
    kept = _t(spark, d, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    orders = I.keep_only(_t(spark, d, "orders").select("o_orderkey", "o_custkey"), kept, "o_custkey")
    lines = I.keep_only(_t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber"), orders, "o_orderkey")
    return lines.groupBy("o_orderkey").agg(F.count("*").alias("lines"))


@_q("pruned_paths", "SELECT page_id FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE url LIKE 'https%')")
def pruned_paths(spark, d):
    p = _t(spark, d, "pages").select("page_id", "url")
    return p.join(p.where("url like 'https%'").select("url").distinct(), "url", "left_anti").select("page_id")


@_q("status_counts", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def status_counts(spark, d):
    return I.counters(_t(spark, d, "orders").withColumnRenamed("o_orderstatus", "status"), "status")


@_q("corpus_inventory", "SELECT p_type AS kind, p_brand AS bucket, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS bytes FROM part GROUP BY 1, 2")
def corpus_inventory(spark, d):
    return _t(spark, d, "part").groupBy(F.col("p_type").alias("kind"), F.col("p_brand").alias("bucket")).agg(F.count("*").alias("n"), F.sum("p_size").alias("bytes"))


@_q("event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    """Tumbling windows (beyond the reference); the stream in docspark.streaming computes the same."""
    from docspark.streaming import windows

    return windows.tumbling(_t(spark, d, "events"), "ts", "1 hour", ["event_type"], "value")


@_q("object_catalog_visible", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def object_catalog_visible(spark, d):
    return _t(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey")
