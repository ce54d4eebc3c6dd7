"""Mix sources to target weights by Poisson replication.

A source's documents repeat at the mean rate that brings its characters to its
target share of the output. A document's number of copies is the inverse of the
Poisson distribution with that mean at a uniform number hashed from seed and
doc_id, so it depends on nothing but the document and its source's rate, and any
lost task makes the same copies again. Copies are dealt and ordered by a hash of
their own: a global shuffle.

All steps are DataFrame expressions. The rates are one row a source; they are
broadcast only if there are at most BROADCAST_SOURCES of them, else joined by an
exchange in which Spark splits skewed sources.

Defined cases: a null source is a source of its own; null and empty texts count
no characters but are replicated like the rest; a source without characters
keeps rate `epochs`; rows with the same doc_id get the same number of copies;
an empty table gives an empty result; other columns are passed through, whatever their
names, but for `copy`, `rate` and `shuffle_key` in any case, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_SOURCES = 10_000
#: exp(-rate) must not vanish: a larger rate is a sum of independent ones up to this.
LARGEST = 500.0
SEED = "mix-1"


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) of 52 bits from the MD5 of the parts joined by '|'."""
    text = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: DataFrame | None = None, alpha: float = 0.5, epochs: float = 1.0, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(source, size, rate): mean copies of a document of the source.

    weights: (source, weight) of target shares; by default a source's share is
    its size to the power alpha. epochs: output size over input size.
    """
    size = docs.groupBy(F.col(source_col).alias("source")).agg(F.coalesce(F.sum(F.length(text_col)), F.lit(0)).cast("double").alias("size"))
    if weights is None:
        size = size.withColumn("weight", F.pow("size", F.lit(alpha)))
    else:
        w = weights.select(F.col("source").alias("__s"), F.col("weight").cast("double").alias("weight"))
        size = size.join(w, size.source.eqNullSafe(w.__s), "left").drop("__s").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    total = size.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight"))
    rate = F.lit(epochs) * F.col("all_size") * F.col("weight") / F.col("all_weight") / F.col("size")
    return size.join(F.broadcast(total)).select("source", "size", F.when((F.col("size") > 0) & (F.col("all_weight") > 0), rate).otherwise(F.lit(epochs)).alias("rate"))  # total is one row


def _thresholds(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... as far as the hash can tell it from 1."""
    most = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("cdf"))

    def add(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), F.array_append(acc["cdf"], F.element_at(acc["cdf"], -1) + p).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), most), start, add, lambda acc: acc["cdf"])


def replicate(docs: DataFrame, weights: DataFrame | None = None, alpha: float = 0.5, epochs: float = 1.0, seed: str = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Columns of docs plus `copy` (1, 2, ...), `rate` and `shuffle_key`, in globally shuffled order."""
    spark = docs.sparkSession
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    names = [c for c in docs.columns if c.lower() not in ("copy", "rate", "shuffle_key")]
    r = rates(docs, weights, alpha, epochs, source_col, text_col)
    pieces = F.greatest(F.ceil(F.col("rate") / LARGEST), F.lit(1)).cast("int")
    r = r.select(F.col("source").alias("of"), "rate", pieces.alias("pieces"), _thresholds(F.col("rate") / pieces).alias("cdf"))
    few = r.select("of").limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    #: The row travels as one struct, so its columns' names can't meet those used here.
    rows = docs.select(F.struct(*map(quoted, names)).alias("row"), quoted(id_col).alias("id"), quoted(source_col).alias("source"))
    out = rows.join(F.broadcast(r) if few else r, F.col("source").eqNullSafe(F.col("of")))
    key = F.col("id")
    first = F.size(F.filter("cdf", lambda c: c <= F.col("u")))
    more = F.aggregate(
        F.sequence(F.lit(1), F.col("pieces") - 1),
        F.lit(0),
        lambda n, j: n + F.size(F.filter("cdf", lambda c: c <= uniform(F.lit(seed), key, j))),
    )
    out = out.withColumn("u", uniform(F.lit(seed), key)).withColumn("n", first + F.when(F.col("pieces") > 1, more).otherwise(0))
    out = out.where("n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    out = out.withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), F.coalesce(key.cast("string"), F.lit("null")), "copy")))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = out.select("row", "id", "copy", "rate", "shuffle_key").repartition(n, "shuffle_key").sortWithinPartitions("shuffle_key", "id")
    return dealt.select("row.*", "copy", "rate", "shuffle_key")


def op5(spark, sf_dir: str) -> DataFrame:
    """Query op5: all documents mixed to square-root shares of their sources."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return replicate(docs).select("doc_id", "source", "copy", F.round("rate", 6).alias("rate"), "shuffle_key")


OP5_SQL = f"""
WITH RECURSIVE size AS (
  SELECT source, CAST(coalesce(sum(length(text)), 0) AS DOUBLE) AS size FROM documents GROUP BY source),
total AS (SELECT sum(size) AS all_size, sum(pow(size, 0.5)) AS all_weight FROM size),
rate AS (
  SELECT source, CASE WHEN size > 0 AND all_weight > 0 THEN 1.0::DOUBLE * all_size * pow(size, 0.5) / all_weight / size ELSE 1.0::DOUBLE END AS rate
  FROM size, total),
cdf AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS cdf FROM rate
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), cdf + p * rate / (k + 1) FROM cdf WHERE k < ceil(rate + 12 * sqrt(rate) + 30)),
drawn AS (
  SELECT doc_id, source, CAST('0x' || substr(md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u FROM documents),
counted AS (
  SELECT d.doc_id, d.source, any_value(c.rate) AS rate, count(*) FILTER (WHERE c.cdf <= d.u) AS n
  FROM drawn d JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source GROUP BY d.doc_id, d.source)
SELECT doc_id, source, CAST(copy AS INTEGER) AS copy, round(rate, 6) AS rate, md5('{SEED}|order|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || CAST(copy AS VARCHAR)) AS shuffle_key
FROM (SELECT doc_id, source, rate, unnest(range(1, n + 1)) AS copy FROM counted)
"""
