"""Registered vector queries over `embeddings` (chunk := vec_id, file := label)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions import vectors as V
from docspark.operators import vector_search as S

QUERIES, ORACLE_SQL = {}, {}

#: Cells are probed until recall, measured on so many queries by hash order, reaches this.
LEAST_RECALL, RECALL_QUERIES = 0.9, 1024


def _q(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet")


def _probe(v: DataFrame) -> list[float]:
    """The vector of vec_id 0, or zeros in an empty table."""
    row = v.where("vec_id = 0").select("embedding").first()
    return [float(x) for x in row[0]] if row else [0.0]


# SQL: unit vectors in double precision (u), and the probe (q).
_UNIT = """
WITH d AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
u AS (SELECT vec_id, label, v, CASE WHEN sqrt(list_dot_product(v, v)) > 0 THEN list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) ELSE v END AS n FROM d),
q AS (SELECT v AS qv, n AS qn FROM u WHERE vec_id = 0)
"""


@_q("knn_exact", _UNIT + "SELECT vec_id, round(list_dot_product(n, qn), 6) AS score FROM u, q WHERE vec_id <> 0 ORDER BY score DESC, vec_id LIMIT 10")
def knn_exact(spark, d):
    v = _vectors(spark, d)
    return S.knn(v.where("vec_id <> 0"), _probe(v), 10)


@_q("knn_max_sim", _UNIT + "SELECT label AS file_id, round(max(list_dot_product(n, qn)), 6) AS score FROM u, q WHERE vec_id <> 0 GROUP BY label ORDER BY score DESC, file_id LIMIT 10")
def knn_max_sim(spark, d):
    v = _vectors(spark, d)
    return S.max_sim(v.where("vec_id <> 0"), _probe(v), 10, "label")


@_q("knn_mean_of_top", _UNIT + "SELECT label AS file_id, round(avg(s), 6) AS score FROM (SELECT label, list_dot_product(n, qn) AS s, row_number() OVER (PARTITION BY label ORDER BY list_dot_product(n, qn) DESC) AS r FROM u, q) WHERE r <= 3 GROUP BY label")
def knn_mean_of_top(spark, d):
    v = _vectors(spark, d)
    return S.mean_of_top(v, _probe(v), 3, "label")


@_q("knn_truncated", "WITH d AS (SELECT vec_id, list_transform(embedding[1:32], lambda x: x::DOUBLE) AS v FROM embeddings), u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS n FROM d), q AS (SELECT n AS qn FROM u WHERE vec_id = 0) SELECT vec_id, round(list_dot_product(n, qn), 6) AS score FROM u, q WHERE vec_id <> 0 ORDER BY score DESC, vec_id LIMIT 10")
def knn_truncated(spark, d):
    v = _vectors(spark, d)
    return S.knn(v.where("vec_id <> 0"), _probe(v), 10, dims=32)


@_q("knn_batch", _UNIT + "SELECT query_id, rank, vec_id, score FROM (SELECT a.vec_id AS query_id, b.vec_id, round(list_dot_product(a.n, b.n), 6) AS score, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.n, b.n), 6) DESC, b.vec_id) AS INTEGER) AS rank FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE a.label = 0) WHERE rank <= 5")
def knn_batch(spark, d):
    v = _vectors(spark, d)
    return S.knn_batch(v, v.where("label = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), 5)


@_q("knn_filtered", _UNIT + "SELECT vec_id, round(list_dot_product(n, qn), 6) AS score FROM u, q WHERE vec_id <> 0 AND label IN (1, 2, 3) ORDER BY score DESC, vec_id LIMIT 10")
def knn_filtered(spark, d):
    v = _vectors(spark, d)
    return S.filtered_knn(v.where("vec_id <> 0"), v.where("label in (1, 2, 3)"), _probe(v), 10)


@_q("more_like_this", _UNIT + "SELECT b.label AS file_id, round(max(list_dot_product(a.n, b.n)), 6) AS score FROM u a JOIN u b ON a.label = 3 AND b.label <> 3 GROUP BY b.label ORDER BY score DESC, file_id LIMIT 5")
def more_like_this(spark, d):
    v = _vectors(spark, d)
    return S.more_like(v, v.where("label = 3"), v.where("label <> 3"), 5)


_INT8 = """,
m AS (SELECT *, list_max(list_transform(n, lambda x: abs(x))) AS top FROM u),
c AS (SELECT vec_id, n, top / 127 AS scale, list_transform(n, lambda x: CASE WHEN top > 0 THEN round(x * 127 / top) ELSE 0 END) AS code FROM m),
p AS (SELECT n AS qn, scale AS qs, code AS qc FROM c WHERE vec_id = 0),
rough AS (SELECT vec_id, n, qn, round(CAST(list_dot_product(code, qc) AS DOUBLE) * scale * qs, 6) AS r FROM c, p ORDER BY r DESC, vec_id LIMIT 40)
SELECT vec_id, round(list_dot_product(n, qn), 6) AS score FROM rough ORDER BY score DESC, vec_id LIMIT 10
"""


@_q("knn_int8_rescored", _UNIT.rstrip() + _INT8)
def knn_int8_rescored(spark, d):
    v = _vectors(spark, d)
    return S.int8_rescored(v, _probe(v), 10)


@_q("vector_distances", _UNIT + "SELECT vec_id, round(list_dot_product(v, qv), 6) AS dot, round(sqrt(list_sum(list_transform(list_zip(v, qv), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6) AS l2, round(list_dot_product(v, qv) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(qv, qv))), 6) AS cosine FROM u, q")
def vector_distances(spark, d):
    v = _vectors(spark, d)
    q = F.array(*(F.lit(x) for x in _probe(v)))
    e = F.col("embedding")
    return v.select("vec_id", F.round(V.dot(e, q), 6).alias("dot"), F.round(V.l2_distance(e, q), 6).alias("l2"), F.round(V.cosine(e, q), 6).alias("cosine"))


@_q("vector_truncate_normalize", "WITH d AS (SELECT vec_id, list_transform(embedding[1:16], lambda x: x::DOUBLE) AS v FROM embeddings) SELECT vec_id, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first, round(list_sum(list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))), 6) AS total FROM d")
def vector_truncate_normalize(spark, d):
    n = V.truncate_and_normalize(F.col("embedding"), 16)
    return _vectors(spark, d).select("vec_id", F.round(n[0], 6).alias("first"), F.round(F.aggregate(n, F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@_q("embeddings_by_config", "SELECT label, CAST(len(embedding) AS INTEGER) AS dims, count(*) AS n FROM embeddings GROUP BY ALL")
def embeddings_by_config(spark, d):
    return _vectors(spark, d).groupBy("label", F.size("embedding").alias("dims")).agg(F.count("*").alias("n"))


@_q("embeddings_wrong_dims", "SELECT count(*) AS vectors, count(*) FILTER (WHERE len(embedding) = 64) AS usable FROM embeddings")
def embeddings_wrong_dims(spark, d):
    return _vectors(spark, d).agg(F.count("*").alias("vectors"), F.count(F.when(F.size("embedding") == 64, 1)).alias("usable"))


@_q("documents_without_vector", "SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM embeddings WHERE vec_id = doc_id)")
def documents_without_vector(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id").join(_vectors(spark, d).select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")


@_q("capacity_estimate", "SELECT label, count(*) AS vectors, CAST(ceil(sum(len(embedding)) * 4 * 1.5) AS BIGINT) AS float_bytes, CAST(ceil(sum(len(embedding)) * 1.5) AS BIGINT) AS int8_bytes FROM embeddings GROUP BY label")
def capacity_estimate(spark, d):
    n = F.sum(F.size("embedding"))
    return _vectors(spark, d).groupBy("label").agg(F.count("*").alias("vectors"), F.ceil(n * 4 * F.lit(1.5)).cast("long").alias("float_bytes"), F.ceil(n * F.lit(1.5)).cast("long").alias("int8_bytes"))


@_q("knn_centroid_cells")
def knn_centroid_cells(spark, d):
    """Every vec_id divisible by 20 asks as many cells as its recall needs, held against exact search; 4 at least."""
    v = _vectors(spark, d)
    queries = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    index = S.CentroidIndex(v, 8)
    some = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(RECALL_QUERIES).persist()  # what recall is measured on; all are asked
    recall = index.recalls(some, S.knn_batch(v, some, 10))
    some.unpersist()
    probe = next(p for p in range(4, len(recall) + 1) if recall[p - 1] >= LEAST_RECALL or p == len(recall))
    return index.search_batch(queries, 10, probe)


@_q("cluster_suggestions")
def cluster_suggestions(spark, d):
    return S.clusters(_vectors(spark, d), 8)


@_q("approximate_recall")
def approximate_recall(spark, d):
    """Overlap of the centroid search with the exact one, by cells probed, at four selectivities of a filter."""
    v = _vectors(spark, d).persist()
    q, n = _probe(v), v.count()
    rows = []
    for share in (0.001, 0.01, 0.1, 0.5):
        some = v.orderBy(F.md5(F.col("vec_id").cast("string")), "vec_id").limit(max(10, int(n * share)))
        exact = {r.vec_id for r in S.knn(some, q, 10).toLocalIterator()}
        index = S.CentroidIndex(some, 4)
        for probe in (1, 2, 4):
            got = {r.vec_id for r in index.search(q, 10, probe).toLocalIterator()}
            rows.append((share, probe, len(got & exact) / len(exact) if exact else 1.0))
    v.unpersist()
    return spark.createDataFrame(rows, "selectivity double, probed int, recall double")
