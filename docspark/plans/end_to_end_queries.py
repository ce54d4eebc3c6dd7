"""Registered queries of whole paths: search legs, evaluation, status, upload and download, corpus assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from docspark.functions import text as T
from docspark.operators import ingest as I
from docspark.operators import text_search as S
from docspark.operators.vector_search import QUERY_BYTES
from docspark.plans import portal, retrieval
from docspark.sources.tables import spread

QUERIES, ORACLE_SQL = {}, {}

#: A larger query set is embedded and scored in slices of about this many queries, or of QUERY_BYTES of text.
QUERIES_AT_ONCE = 10_000


def _q(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _corpus(spark, d):
    """Documents as files (name := source, time := id), chunks and vectors by the offline provider; benchmark items as queries."""
    docs = spread(_t(spark, d, "documents"))
    files = docs.select(F.col("doc_id").alias("file_id"), F.col("source").alias("name"), "text", F.col("doc_id").alias("mtime"))
    chunks = I.chunk(files).withColumn("chunk_id", F.xxhash64("file_id", "ordinal"))
    provider = I.HashingProvider(128)
    vectors = I.embed(chunks, provider, 64, batch=64, file_col="file_id")
    items = _t(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), "text")
    return files, chunks, vectors, items, provider


def _legs(spark, d, k=10):
    files, chunks, vectors, items, provider = _corpus(spark, d)
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    slices = max(1, -(-n // QUERIES_AT_ONCE), -(-size // QUERY_BYTES))
    semantic = None
    for s in range(slices):
        mine = items.where(F.pmod(F.xxhash64("query_id"), F.lit(slices)) == s)
        asked = [(r.query_id, r.text) for r in mine.orderBy("query_id").toLocalIterator()]
        q = retrieval.embed_queries(provider, asked, 64, provider.identity())
        part = retrieval.file_scores(files, chunks, vectors, q, k)
        semantic = part if semantic is None else semantic.union(part)
    return files, items, retrieval.all_legs(files, items, k, semantic)


@_q("search_all_legs")
def search_all_legs(spark, d):
    return _legs(spark, d)[2]


@_q("evaluate_configurations")
def evaluate_configurations(spark, d):
    """The documents that contain an item are relevant to it."""
    files, items, legs = _legs(spark, d)
    key = F.btrim(T.spaced_words(F.col("text"), r"[^\p{L}\p{N}]+"))
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    slices, qrels = max(1, -(-n // QUERIES_AT_ONCE), -(-size // QUERY_BYTES)), None
    for s in range(slices):
        mine = [(r.query_id, r.item) for r in items.where(F.pmod(F.xxhash64("query_id"), F.lit(slices)) == s).select("query_id", key.alias("item")).where("item is not null").toLocalIterator()]
        part = S.contained(files.select("file_id", key.alias("doc")), mine).select("query_id", "id", F.lit(1).alias("grade"))
        qrels = part if qrels is None else qrels.union(part)
    rankings = legs.withColumn("config", F.when(F.col("leg") == "semantic", "hashing:64"))
    return retrieval.evaluate(rankings, qrels, items.select("query_id", F.lit("items").alias("category")), 10)


@_q("status_snapshot", "SELECT 'files' AS what, lang AS detail, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'chunks', NULL, count(*) FROM conversations UNION ALL SELECT 'vectors', label || ':' || len(embedding), count(*) FROM embeddings GROUP BY ALL")
def status_snapshot(spark, d):
    files = _t(spark, d, "documents").withColumnRenamed("lang", "extract_status")
    vectors = _t(spark, d, "embeddings").select(F.col("label").alias("model"), F.size("embedding").alias("dims"))
    return retrieval.status(spark, files, _t(spark, d, "conversations"), vectors)


def _uploads(spark, d):
    files = _t(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: x["text"]), "\n").alias("content"))
    files = files.select(F.col("conv_id").cast("string").alias("upload"), F.translate("content", "\u0000", "").alias("content"))
    agents = spark.createDataFrame([("a1", "d1"), ("a2", "d2"), ("a3", "d3"), ("a4", "d3")], "agent string, domain string")
    key = F.unhex(F.sha2(F.lit("demonstration key"), 256))
    planned = portal.plan(files, 512, F.lit("demonstration"))
    chunks = portal.encrypted(files, planned, 512, key)
    m = portal.manifests(chunks)
    # Agent a2 refuses objects whose name starts with 0; every other agent takes all.
    works = ~((F.col("agent") == "a2") & F.col("hash").startswith("0"))
    copies = portal.replicate(chunks.select("hash", "stored").union(m.select("hash", "stored")), agents, works)
    return files, chunks, m, copies, key


@_q("upload_visible")
def upload_visible(spark, d):
    files, chunks, m, copies, _ = _uploads(spark, d)
    return portal.visible(files, chunks, m, copies, 3)


@_q("download_round_trip", "SELECT CAST(conv_id AS VARCHAR) AS upload, sha256(string_agg(text, chr(10) ORDER BY turn, role, text)) AS sha FROM conversations GROUP BY conv_id")
def download_round_trip(spark, d):
    _, _, m, copies, key = _uploads(spark, d)
    return portal.download(m, copies, key).select("upload", F.sha2("content", 256).alias("sha"))


@_q(
    "corpus_assembled",
    """
WITH one AS (SELECT min(doc_id) AS doc_id, source FROM documents GROUP BY sha256(text), source),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM one)
SELECT source, count(*) AS taken, CAST(sum(doc_id) AS BIGINT) AS ids FROM r WHERE r <= 50 GROUP BY source
""",
)
def corpus_assembled(spark, d):
    """Assembly: one copy of each content, at most 50 files of a bucket in path order (the cap is the feature), inventory."""
    one = _t(spark, d, "documents").groupBy(F.sha2("text", 256).alias("sha"), "source").agg(F.min("doc_id").alias("doc_id"))
    w = Window.partitionBy("source").orderBy("doc_id")
    return one.withColumn("r", F.row_number().over(w)).where("r <= 50").groupBy("source").agg(F.count("*").alias("taken"), F.sum("doc_id").alias("ids"))


@_q("point_lookups", "SELECT page_id, url, length(html) AS size FROM pages WHERE page_id IN (0, 7, 21)")
def point_lookups(spark, d):
    return _t(spark, d, "pages").where("page_id in (0, 7, 21)").select("page_id", "url", F.length("html").cast("long").alias("size"))


@_q("size_ceiling", "SELECT doc_id, CASE WHEN strlen(text) > 4096 THEN 'excluded' ELSE 'extracted' END AS status FROM documents")
def size_ceiling(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.when(F.octet_length("text") > 4096, "excluded").otherwise("extracted").alias("status"))


@_q("placement_confirmed", "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_linestatus = 'F')")
def placement_confirmed(spark, d):
    done = _t(spark, d, "lineitem").where("l_linestatus = 'F'").select(F.col("l_suppkey").alias("s_suppkey"))
    return _t(spark, d, "supplier").select("s_suppkey").join(done, "s_suppkey", "left_semi")


@_q("collections_membership", "SELECT c.label, d.source, count(*) AS n FROM embeddings c JOIN documents d ON d.doc_id = c.vec_id GROUP BY ALL")
def collections_membership(spark, d):
    """Manual collections (label) of the documents that have a vector, by source."""
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label").join(_t(spark, d, "documents").select("doc_id", "source"), "doc_id").groupBy("label", "source").agg(F.count("*").alias("n"))
