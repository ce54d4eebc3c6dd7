"""Registered evaluation queries: sources are queries, documents are ranked, labels are grades."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.operators import evaluation as E
from docspark.operators import text_search

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


# Rankings of a source's documents by length (ours) and by id (other); relevant are labelled documents of quality 1, grade 1 + toxic.
_BASE = """
WITH ours AS (SELECT source AS query_id, doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 10),
other AS (SELECT source AS query_id, doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents QUALIFY rank <= 10),
qrels AS (SELECT source AS query_id, d.doc_id AS id, quality + toxic AS grade FROM documents d JOIN labels USING (doc_id) WHERE quality = 1),
ideal AS (SELECT query_id, count(*) AS n_relevant, coalesce(sum(CASE WHEN r <= 10 THEN (pow(2, grade) - 1) / log2(r + 1) END), 0) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, id) AS r FROM qrels) GROUP BY query_id),
hit AS (SELECT query_id, count(*) AS hits, sum((pow(2, grade) - 1) / log2(rank + 1)) AS dcg, min(rank) AS first_hit FROM ours JOIN qrels USING (query_id, id) GROUP BY query_id),
hit2 AS (SELECT query_id, min(rank) AS first_hit FROM other JOIN qrels USING (query_id, id) GROUP BY query_id),
met AS (SELECT query_id, n_relevant, coalesce(hits, 0) AS hits, round(coalesce(hits / n_relevant::DOUBLE, 0), 6) AS recall, round(coalesce(dcg / nullif(idcg, 0), 0), 6) AS ndcg, CAST(first_hit AS INTEGER) AS first_hit FROM ideal LEFT JOIN hit USING (query_id)),
wlt AS (SELECT i.query_id, 'group' || (length(i.query_id) % 2) AS category, CASE WHEN a.first_hit IS NULL AND b.first_hit IS NULL THEN 'tie' WHEN b.first_hit IS NULL OR a.first_hit < b.first_hit THEN 'win' WHEN a.first_hit IS NULL OR b.first_hit < a.first_hit THEN 'loss' ELSE 'tie' END AS outcome
  FROM ideal i LEFT JOIN hit a USING (query_id) LEFT JOIN hit2 b USING (query_id))
"""


def _rankings(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = _t(spark, d, "documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("id"), F.col("n_chars"))
    ours = text_search.top_k(docs.withColumn("score", F.col("n_chars")), 10)
    other = text_search.top_k(docs.withColumn("score", F.lit(0)), 10)
    labels = _t(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("id"), (F.col("quality") + F.col("toxic")).alias("grade"))
    return ours, other, docs.join(labels, "id").select("query_id", "id", "grade")


@_q("eval_recall_ndcg", _BASE + "SELECT * FROM met")
def eval_recall_ndcg(spark, d):
    ours, _, qrels = _rankings(spark, d)
    return E.metrics(ours, qrels, 10)


@_q("eval_means", _BASE + "SELECT count(*) AS judged, round(avg(recall), 5) AS recall, round(avg(ndcg), 5) AS ndcg FROM met")
def eval_means(spark, d):
    return eval_recall_ndcg(spark, d).agg(F.count("*").alias("judged"), F.round(F.avg("recall"), 5).alias("recall"), F.round(F.avg("ndcg"), 5).alias("ndcg"))


def _outcomes(spark, d):
    ours, other, qrels = _rankings(spark, d)
    a = E.metrics(ours, qrels, 10).select("query_id", F.col("first_hit").alias("a"))
    b = E.metrics(other, qrels, 10).select("query_id", F.col("first_hit").alias("b"))
    return a.join(b, "query_id").select("query_id", F.concat(F.lit("group"), F.length("query_id") % 2).alias("category"), E.outcome(F.col("a"), F.col("b")).alias("outcome"))


@_q("eval_outcomes", _BASE + "SELECT * FROM wlt")
def eval_outcomes(spark, d):
    return _outcomes(spark, d)


@_q(
    "eval_win_rates",
    _BASE + """SELECT category, count(*) FILTER (WHERE outcome = 'win') AS wins, count(*) FILTER (WHERE outcome = 'loss') AS losses, count(*) FILTER (WHERE outcome = 'tie') AS ties,
round(coalesce(count(*) FILTER (WHERE outcome = 'win') / nullif(count(*) FILTER (WHERE outcome <> 'tie'), 0)::DOUBLE, 0), 6) AS win_rate FROM wlt GROUP BY ROLLUP (category)""",
)
def eval_win_rates(spark, d):
    return E.win_rates(_outcomes(spark, d))


@_q("eval_wilson", _BASE + """, c AS (SELECT count(*) FILTER (WHERE outcome = 'win')::DOUBLE AS w, nullif(count(*) FILTER (WHERE outcome <> 'tie'), 0)::DOUBLE AS n FROM wlt)
SELECT round((w / n + 1.959964 * 1.959964 / (2 * n) - 1.959964 * sqrt(w / n * (1 - w / n) / n + 1.959964 * 1.959964 / (4 * n * n))) / (1 + 1.959964 * 1.959964 / n), 5) AS wilson FROM c""")
def eval_wilson(spark, d):
    all_ = E.win_rates(_outcomes(spark, d)).where("category is null")
    return all_.select(F.round(E.wilson_lower(F.col("wins"), F.col("wins") + F.col("losses")), 5).alias("wilson"))


@_q("eval_percentiles", """
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT a.event_type, a.value AS p50, b.value AS p95 FROM r a JOIN r b ON a.event_type = b.event_type AND a.r = CAST(round((a.n - 1) * 0.5::DOUBLE) AS BIGINT) AND b.r = CAST(round((b.n - 1) * 0.95::DOUBLE) AS BIGINT)
""")
def eval_percentiles(spark, d):
    e = _t(spark, d, "events")
    a, b = (E.nearest_rank(e, ["event_type"], "value", q).withColumnRenamed("value", n) for q, n in ((0.5, "p50"), (0.95, "p95")))
    return a.join(b, "event_type")


@_q("eval_first_and_mean_latency", "SELECT event_type, arg_min(value, event_id) AS cold, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def eval_first_and_mean_latency(spark, d):
    return _t(spark, d, "events").groupBy("event_type").agg(F.min_by("value", "event_id").alias("cold"), F.round(F.avg("value"), 6).alias("mean"))


@_q(
    "eval_relevance_sets",
    """
WITH ids AS (SELECT source AS query_id, doc_id AS id FROM documents WHERE n_chars > 4000),
globs AS (SELECT source AS query_id, doc_id AS id FROM documents WHERE lang LIKE 'f%'),
grades AS (SELECT source AS query_id, doc_id AS id, quality + 1 AS grade FROM documents JOIN labels USING (doc_id)),
u AS (SELECT * FROM ids UNION SELECT * FROM globs UNION SELECT query_id, id FROM grades)
SELECT query_id, id, CAST(coalesce(grade, 1) AS INTEGER) AS grade FROM u LEFT JOIN grades USING (query_id, id)
""",
)
def eval_relevance_sets(spark, d):
    docs = _t(spark, d, "documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("id"), "n_chars", "lang")
    labels = _t(spark, d, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") + 1).alias("grade"))
    return E.relevance(docs.where("n_chars > 4000"), docs.where("lang like 'f%'"), docs.join(labels, "id").select("query_id", "id", "grade"))


@_q("eval_spread", "SELECT l_returnflag AS model, round(max(m) - min(m), 6) AS spread, count(*) AS sizes FROM (SELECT l_returnflag, l_linestatus, round(avg(l_discount), 6) AS m FROM lineitem GROUP BY ALL) GROUP BY 1")
def eval_spread(spark, d):
    by = _t(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("model"), "l_linestatus").agg(F.round(F.avg("l_discount"), 6).alias("ndcg"))
    return E.spread(by)


@_q("report_differences", """
WITH a AS (SELECT o_orderpriority || '.' || o_orderstatus AS path, CAST(count(*) AS VARCHAR) AS value FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1),
b AS (SELECT o_orderpriority || '.' || o_orderstatus AS path, CAST(count(DISTINCT o_custkey) AS VARCHAR) AS value FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1)
SELECT path, a.value AS a, b.value AS b FROM a FULL JOIN b USING (path) WHERE a.value IS DISTINCT FROM b.value
""")
def report_differences(spark, d):
    o = _t(spark, d, "orders").withColumn("path", F.concat_ws(".", "o_orderpriority", "o_orderstatus"))
    a = o.where("o_orderstatus <> 'P'").groupBy("path").agg(F.count("*").cast("string").alias("value"))
    b = o.where("o_orderstatus <> 'O'").groupBy("path").agg(F.countDistinct("o_custkey").cast("string").alias("value"))
    return E.differences(a, b)


@_q("selection_policy")
def selection_policy(spark, d):
    """The policy applied to the win rates and nDCG measured here, as three sizes of one model."""
    m = eval_means(spark, d).first()
    w = E.win_rates(_outcomes(spark, d)).where("category is null").first()
    configs = [E.Config("nomic-embed-text", n, (m.ndcg or 0.0) - 0.01 * k, w.win_rate, w.wins + w.losses, m.judged) for k, n in enumerate((768, 512, 384))]
    r = E.recommend(configs)
    return spark.createDataFrame([(r["go"], r["locked"], r["model"], r["dims"], r["text"])], "go boolean, locked boolean, model string, dims int, recommendation string")
