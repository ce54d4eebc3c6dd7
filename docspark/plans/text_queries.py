"""Registered text and retrieval queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions import text as T
from docspark.operators import ingest, text_search
from docspark.plans.stem_sql import stem_ctes
from docspark.sources.tables import spread

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


_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@_q(
    "chunk_documents",
    f"""
WITH RECURSIVE s AS (
  SELECT doc_id, text, length(text) AS n, 0 AS start, -1 AS ordinal, 0 AS a, 0 AS b, FALSE AS keep FROM documents WHERE length(text) > 0
  UNION ALL
  SELECT doc_id, text, n, CASE WHEN e >= n THEN n ELSE CASE WHEN e - 200 > start THEN e - 200 ELSE e END END,
    CASE WHEN length(trim(w, {_WS})) > 0 THEN ordinal + 1 ELSE ordinal END,
    start + length(w) - length(ltrim(w, {_WS})), start + length(rtrim(w, {_WS})), length(trim(w, {_WS})) > 0
  FROM (SELECT doc_id, text, n, start, ordinal, e, substring(text, start + 1, e - start) AS w FROM (
    SELECT *, CASE WHEN start + 2000 < n AND cut >= 1000 THEN start + cut ELSE least(start + 2000, n) END AS e FROM (
      SELECT *, length(regexp_extract(substring(text, start + 1, 2000), '(?s)^(.*\\s)', 1)) AS cut FROM s WHERE start < n))))
SELECT doc_id AS file_id, CAST(ordinal AS INTEGER) AS ordinal, substring(text, a + 1, b - a) AS text, CAST(a AS INTEGER) AS char_start, CAST(b AS INTEGER) AS char_end FROM s WHERE keep
""",
)
def chunk_documents(spark, d):
    return ingest.chunk(_t(spark, d, "documents"), id_col="doc_id")


_TOK = "regexp_extract_all(lower(coalesce({c}, '')), '[\\p{{L}}\\p{{N}}]+')"
_DOC_TERMS = f"SELECT doc_id AS id, unnest({_TOK.format(c='text')}) AS term FROM documents"


@_q("term_statistics", f"SELECT term, count(*) AS tf, count(DISTINCT id) AS df FROM ({_DOC_TERMS}) GROUP BY term")
def term_statistics(spark, d):
    post = text_search.postings(spread(_t(spark, d, "documents")), "doc_id", {"text": "text"})
    return post.groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


_INDEXED = "regexp_extract_all(lower(coalesce({c}, '')), '[\\p{{L}}\\p{{N}}\\p{{M}}]+')"


def bm25_ctes(docs: str, queries: str) -> str:
    """CTEs up to `bm` (query_id, id, score, rank) over docs (id, text, other) and queries (query_id, text)."""
    tokens = "unnest(list_transform(string_split_regex(text, '\\s+'), lambda t: regexp_replace(t, '[^\\p{L}\\p{N}_.\\-]', '', 'g')))"
    return f"""
qw AS (SELECT DISTINCT query_id, unnest({_INDEXED.format(c='tok')}) AS word FROM (SELECT query_id, {tokens} AS tok FROM {queries})),
docs AS (SELECT * FROM {docs}),
dw AS (SELECT id, unnest({_INDEXED.format(c='text')}) AS word FROM docs),
words AS (SELECT word FROM qw UNION SELECT word FROM dw),
{stem_ctes('words')},
qt AS (SELECT DISTINCT query_id, term AS prefix FROM qw JOIN stemmed USING (word)),
post AS (SELECT id, term, count(*) AS tf FROM dw JOIN stemmed USING (word) GROUP BY id, term),
len AS (SELECT id, len({_INDEXED.format(c='text')}) + len({_INDEXED.format(c='other')}) AS len FROM docs),
tot AS (SELECT count(*) AS n, avg(len) AS avglen FROM len),
vocab AS (SELECT DISTINCT term FROM post),
pre AS (SELECT term, unnest(range(1, length(term) + 1)) AS k FROM vocab),
m AS (SELECT p.prefix, v.term FROM (SELECT DISTINCT prefix FROM qt) p JOIN (SELECT term, left(term, k) AS prefix FROM pre) v ON v.prefix = p.prefix),
tf AS (SELECT prefix, id, sum(tf) AS tf FROM post JOIN m USING (term) GROUP BY prefix, id),
df AS (SELECT prefix, n, avglen, count(*) AS df FROM tf, tot GROUP BY prefix, n, avglen),
idf AS (SELECT prefix, avglen, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6::DOUBLE END AS idf FROM df),
gain AS (SELECT prefix, id, idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avglen)) AS gain FROM tf JOIN idf USING (prefix) JOIN len USING (id)),
scored AS (SELECT query_id, id, round(sum(gain), 6) AS score FROM qt JOIN gain USING (prefix) GROUP BY query_id, id),
bm AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM scored)"""


_BM25 = "WITH " + bm25_ctes("(SELECT doc_id AS id, text, source AS other FROM documents)", "(SELECT item_id AS query_id, text FROM benchmark)")


def _bm25(spark, d):
    return text_search.bm25(spread(_t(spark, d, "documents")), _t(spark, d, "benchmark"), "text", {"name": "source", "text": "text"})


@_q("bm25_body_search", _BM25 + " SELECT query_id, id, floor(score * 10000 + 0.5) / 10000 AS score FROM bm WHERE rank <= 10")
def bm25_body_search(spark, d):
    return text_search.top_k(_bm25(spark, d), 10).select("query_id", "id", (F.floor(F.col("score") * 10_000 + 0.5) / 10_000).alias("score"))  # ties as in SQL, where round() differs between engines


_WORDS = f"""
raw AS (SELECT DISTINCT id, term FROM ({_DOC_TERMS})),
bw AS (SELECT DISTINCT item_id AS query_id, unnest({_TOK.format(c='text')}) AS term FROM benchmark),
ov AS (SELECT query_id, id, count(*) AS score FROM bw JOIN raw USING (term) GROUP BY ALL),
ovr AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM ov)
"""


@_q(
    "hybrid_fusion",
    _BM25 + f""", {_WORDS},
legs AS (SELECT query_id, id, 1.0::DOUBLE / (60 + rank) AS part FROM bm WHERE rank <= 50 UNION ALL SELECT query_id, id, 1.0::DOUBLE / (60 + rank) FROM ovr WHERE rank <= 50),
fused AS (SELECT query_id, id, round(sum(part), 8) AS score FROM legs GROUP BY ALL)
SELECT query_id, id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM fused) WHERE rank <= 10
""",
)
def hybrid_fusion(spark, d):
    docs, items = spread(_t(spark, d, "documents")), _t(spark, d, "benchmark")
    keyword = text_search.top_k(_bm25(spark, d), 50)
    words = docs.select(F.col("doc_id").alias("id"), F.explode(F.array_distinct(T.words("text"))).alias("term"))
    asked = items.select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(T.words("text"))).alias("term"))
    overlap = text_search.top_k(words.join(asked, "term").groupBy("query_id", "id").agg(F.count("*").alias("score")), 50)
    return text_search.fuse({"keyword": keyword, "overlap": overlap}, 10).select("query_id", "id", "score", "rank")


_PARTS = "(SELECT row_number() OVER (ORDER BY p_type) AS query_id, lower(p_type) || ' ring' AS text FROM (SELECT DISTINCT p_type FROM part))"


def _part_queries(spark, d):
    """A query for each part type, numbered: a query set, so its one window is small whatever the table's size."""
    from pyspark.sql import Window

    kinds = _t(spark, d, "part").select("p_type").distinct()
    return kinds.select(F.row_number().over(Window.orderBy("p_type")).cast("long").alias("query_id"), F.concat(F.lower("p_type"), F.lit(" ring")).alias("text"))


@_q(
    "name_like_search",
    f"""
WITH q AS {_PARTS},
s AS (SELECT query_id, p_partkey AS id, CASE WHEN contains(lower(p_name), text) THEN 10 ELSE 0 END + CAST(list_sum(list_transform(string_split(text, ' '), lambda t: CAST(contains(lower(p_name), t) AS INTEGER))) AS INTEGER) AS score FROM part, q)
SELECT query_id, id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM s WHERE score > 0) WHERE rank <= 10
""",
)
def name_like_search(spark, d):
    return text_search.like_search(_t(spark, d, "part"), _part_queries(spark, d), 10, "p_partkey", "p_name").select("query_id", "id", "score", "rank")


_LIKE = "CASE WHEN contains(lower(p_name), text) THEN 10 ELSE 0 END + CAST(list_sum(list_transform(string_split(text, ' '), lambda t: CAST(contains(lower(p_name), t) AS INTEGER))) AS INTEGER)"


@_q(
    "name_search_with_fallback",
    "WITH " + bm25_ctes("(SELECT p_partkey AS id, p_name AS text, '' AS other FROM part)", _PARTS) + f""",
hits AS (SELECT query_id, id, score, rank, 'match' AS via FROM bm WHERE rank <= 10),
rest AS (SELECT * FROM {_PARTS} q WHERE query_id NOT IN (SELECT query_id FROM hits)),
lk AS (SELECT query_id, p_partkey AS id, {_LIKE} AS score FROM part, rest)
SELECT * FROM hits
UNION ALL SELECT query_id, id, CAST(score AS DOUBLE), CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank, 'like' FROM lk WHERE score > 0 QUALIFY rank <= 10""",
)
def name_search_with_fallback(spark, d):
    return text_search.name_search(_t(spark, d, "part"), _part_queries(spark, d), 10, "p_partkey", "p_name")


@_q(
    "name_trigram_search",
    f"""
WITH q AS {_PARTS},
qg AS (SELECT query_id, n, unnest(g) AS gram FROM (SELECT query_id, g, len(g) AS n FROM (SELECT query_id, list_distinct(list_transform(range(1, greatest(length(text) - 2, 1) + 1), lambda i: substring(text, i, 3))) AS g FROM q))),
dg AS (SELECT id, unnest(g) AS gram FROM (SELECT p_partkey AS id, list_distinct(list_transform(range(1, greatest(length(p_name) - 2, 1) + 1), lambda i: substring(lower(p_name), i, 3))) AS g FROM part)),
s AS (SELECT query_id, id, round(count(*) / n::DOUBLE, 6) AS score FROM dg JOIN qg USING (gram) GROUP BY query_id, id, n)
SELECT query_id, id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM s) WHERE rank <= 10
""",
)
def name_trigram_search(spark, d):
    return text_search.trigram_search(_t(spark, d, "part"), _part_queries(spark, d), 10, "p_partkey", "p_name").select("query_id", "id", "score", "rank")


GLOBS = [(1, "*/en/*"), (2, "http://**?ref=*"), (3, "*#TOP"), (4, "*_*"), (5, "https://m.*/fr/*")]


@_q(
    "glob_matches",
    """
WITH g(query_id, pattern) AS (VALUES (1, '%/en/%'), (2, 'http://%_ref=%'), (3, '%#top'), (4, '%\\_%'), (5, 'https://m.%/fr/%'))
SELECT DISTINCT query_id, url AS path FROM g JOIN pages ON lower(url) LIKE pattern ESCAPE '\\'
""",
)
def glob_matches(spark, d):
    return text_search.glob_matches(spark.createDataFrame(GLOBS, "query_id int, glob string"), _t(spark, d, "pages"), "url")


@_q("recency_search", "SELECT event_id AS id, CAST(floor(epoch(ts)) AS BIGINT) AS score FROM events ORDER BY score DESC, id LIMIT 10")
def recency_search(spark, d):
    return text_search.recency(_t(spark, d, "events"), 10, "event_id", "ts")


@_q("recency_collision", "SELECT count(*) AS files, count(*) FILTER (WHERE o_orderdate = m) AS newest, round(coalesce(count(*) FILTER (WHERE o_orderdate = m) / nullif(count(*), 0)::DOUBLE, 0), 6) AS share FROM orders, (SELECT max(o_orderdate) AS m FROM orders)")
def recency_collision(spark, d):
    # One pass: rows by time, then the largest time's count over all.
    by = _t(spark, d, "orders").groupBy("o_orderdate").agg(F.count("*").alias("n"))
    out = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("files"), F.coalesce(F.max_by("n", "o_orderdate"), F.lit(0)).alias("newest"))
    return out.withColumn("share", F.round(F.coalesce(F.col("newest") / F.nullif(F.col("files"), F.lit(0)), F.lit(0.0)), 6))


@_q("facets", "SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY lang, source")
def facets(spark, d):
    return _t(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@_q("facet_filtered_search", "SELECT lang, count(*) AS n FROM documents WHERE source IN ('src1', 'src2') AND n_chars BETWEEN 100 AND 5000 GROUP BY lang")
def facet_filtered_search(spark, d):
    return _t(spark, d, "documents").where("source in ('src1', 'src2') and n_chars between 100 and 5000").groupBy("lang").agg(F.count("*").alias("n"))


@_q("content_duplicates", "SELECT sha256(text) AS sha, min(doc_id) AS survivor, count(*) AS copies FROM documents GROUP BY sha256(text) HAVING count(*) > 1")
def content_duplicates(spark, d):
    return _t(spark, d, "documents").groupBy(F.sha2("text", 256).alias("sha")).agg(F.min("doc_id").alias("survivor"), F.count("*").alias("copies")).where("copies > 1")


@_q("content_deduplicated", "SELECT doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def content_deduplicated(spark, d):
    best = _t(spark, d, "documents").groupBy(F.sha2("text", 256).alias("sha")).agg(F.min(F.struct("doc_id", "n_chars")).alias("x"))
    return best.select("x.doc_id", "x.n_chars")


@_q(
    "corpus_fingerprint",
    """
WITH r AS (SELECT sha256(concat_ws('|', doc_id::VARCHAR, sha256(text), n_chars::VARCHAR)) AS h FROM documents),
b AS (SELECT substr(h, 1, 2) AS b, bit_xor(CAST('0x' || substr(h, 3, 15) AS BIGINT)) AS x, sum(CAST('0x' || substr(h, 18, 8) AS BIGINT)) AS s, count(*) AS n FROM r GROUP BY 1)
SELECT sha256(string_agg(e, ',' ORDER BY e)) AS fingerprint, CAST(sum(n) AS BIGINT) AS files FROM (SELECT b || ':' || x || ':' || s || ':' || n AS e, n FROM b)
""",
)
def corpus_fingerprint(spark, d):
    return ingest.content_fingerprint(_t(spark, d, "documents").withColumn("sha", F.sha2("text", 256)), ["doc_id", "sha", "n_chars"])


@_q("query_match_expression", "SELECT item_id, array_to_string(list_transform(list_filter(list_transform(string_split_regex(text, '\\s+'), lambda t: regexp_replace(t, '[^\\p{L}\\p{N}_.\\-]', '', 'g')), lambda t: t <> ''), lambda t: '\"' || t || '\"*'), ' OR ') AS match FROM benchmark")
def query_match_expression(spark, d):
    return _t(spark, d, "benchmark").select("item_id", T.match_expression(F.col("text")).alias("match"))


@_q("conversation_categories", "SELECT coalesce(nullif(trim(role), ''), 'uncategorized') AS category, count(*) AS n, count(DISTINCT conv_id) AS conversations FROM conversations GROUP BY 1")
def conversation_categories(spark, d):
    return _t(spark, d, "conversations").groupBy(T.normalized_category(F.col("role")).alias("category")).agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("conversations"))


@_q("path_parts", "SELECT page_id, string_split(url, '/')[-1] AS name, regexp_replace(string_split(url, '/')[-1], '(.)\\.[^.]*$', '\\1') AS stem, CASE WHEN lower(url) LIKE '%page=%' THEN 1 ELSE 0 END AS paged FROM pages")
def path_parts(spark, d):
    u = F.col("url")
    return _t(spark, d, "pages").select("page_id", T.file_name(u).alias("name"), T.file_stem(u).alias("stem"), T.ascii_lower(u).contains("page=").cast("int").alias("paged"))


@_q("model_prefixes", "SELECT doc_id, 'search_document: ' || text AS with_prefix, text AS without FROM documents")
def model_prefixes(spark, d):
    t = F.col("text")
    return _t(spark, d, "documents").select("doc_id", T.document_prefix(F.lit("nomic-embed-text"), t).alias("with_prefix"), T.document_prefix(F.lit("bge-m3"), t).alias("without"))


@_q("html_to_text")
def html_to_text(spark, d):
    @F.pandas_udf("string")
    def extract(s: pd.Series) -> pd.Series:
        return s.fillna("").map(T.html_text)

    return _t(spark, d, "pages").select("page_id", extract("html").alias("text"))


@_q(
    "keyword_index_terms",
    f"""
WITH dw AS (SELECT doc_id, unnest({_INDEXED.format(c='text')}) AS word FROM documents),
{stem_ctes('dw')}
SELECT doc_id, term, count(*) AS tf FROM dw JOIN stemmed USING (word) GROUP BY doc_id, term""",
)
def keyword_index_terms(spark, d):
    """Stemmed postings of the documents: each distinct word is stemmed once."""
    rows = spread(_t(spark, d, "documents")).select("doc_id", F.explode(text_search.index_words("text")).alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    rows = rows.persist()
    return rows.join(text_search.stems(rows.select("word").distinct()), "word").groupBy("doc_id", "term").agg(F.sum("n").alias("tf"))


@_q("embed_missing_chunks")
def embed_missing_chunks(spark, d):
    """Vectors of the chunks that have none yet, by the offline provider."""
    chunks = ingest.chunk(_t(spark, d, "documents"), id_col="doc_id").withColumn("chunk_id", F.xxhash64("file_id", "ordinal"))
    have = spark.createDataFrame([], "chunk_id long, model string, dims int")
    provider = ingest.HashingProvider(64)
    return ingest.embed(ingest.missing(chunks, have, provider.model, 32), provider, 32)
