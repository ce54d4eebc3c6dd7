import math

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from docspark.llm import mixing as M

from .common import awkward, frame


def test_equals_the_sql(spark, tmp_path):
    docs = spark.createDataFrame([(k, "x" * (k % 97), f"s{k % 3 if k % 2 else 0}" if k % 11 else None) for k in range(400)], "doc_id long, text string, source string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    from pyspark.sql import SparkSession

    assert isinstance(spark, SparkSession)
    got = M.op5(spark, str(tmp_path)).toPandas()
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = c.sql(M.OP5_SQL).df()
    order = ["doc_id", "copy"]
    pd.testing.assert_frame_equal(got.sort_values(order).reset_index(drop=True), want[got.columns].sort_values(order).reset_index(drop=True), check_dtype=False)


def test_awkward_rows_and_clashing_names(spark):
    docs = frame(spark, awkward())
    out = M.replicate(docs, epochs=3.0)
    assert out.columns == [c for c in docs.columns if c != "copy"] + ["copy", "rate", "shuffle_key"]
    n = {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.max("copy").alias("n")).collect()}
    assert None in n or sum(n.values()) > 50
    twice = [r for r in out.where("doc_id = 2").groupBy("copy").count().collect()]
    assert all(r["count"] == 2 for r in twice)
    assert M.replicate(frame(spark, [])).count() == 0


def test_target_weights_are_met_on_average(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("x" * 10).alias("text"), F.when(F.col("id") < 4000, "big").otherwise("small").alias("source"))
    weights = spark.createDataFrame([("big", 1.0), ("small", 3.0)], "source string, weight double")
    n = {r.source: r["count"] for r in M.replicate(docs, weights).groupBy("source").count().collect()}
    assert n["small"] / (n["small"] + n["big"]) == pytest.approx(0.75, abs=0.02)
    assert n["small"] + n["big"] == pytest.approx(6000, rel=0.05)


def test_unlisted_source_and_large_rates(spark):
    docs = spark.createDataFrame([(k, "abc", "a" if k else "b") for k in range(3)], "doc_id long, text string, source string")
    weights = spark.createDataFrame([("b", 1.0)], "source string, weight double")
    out = M.replicate(docs, weights, epochs=700.0).groupBy("source").agg(F.count("*").alias("n"), F.max("rate").alias("rate")).collect()
    assert [r.source for r in out] == ["b"]
    assert out[0].rate == pytest.approx(2100)
    assert abs(out[0].n - 2100) < 6 * math.sqrt(2100)


def test_counts_follow_the_distribution(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit("a").alias("source"))
    n = {r.n: r["count"] for r in M.replicate(docs, epochs=2.0).groupBy("doc_id").agg(F.max("copy").alias("n")).groupBy("n").count().collect()}
    for k in range(1, 6):
        assert n[k] / 20000 == pytest.approx(math.exp(-2) * 2**k / math.factorial(k), abs=0.012)


def test_columns_of_any_name_pass_through(spark):
    names = ["__u", "__n", "__cdf", "__pieces", "__source", "u", "n", "cdf", "pieces", "of", "id", "row", "a.b", "COPY"]
    docs = spark.createDataFrame([(k, "some text", "s", *[f"{c}{k}" for c in names]) for k in range(30)], "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in names))
    out = M.replicate(docs, epochs=2.0)
    assert out.columns == ["doc_id", "text", "source", *names[:-1], "copy", "rate", "shuffle_key"]
    got = out.collect()
    assert len(got) > 30 and all(r[3:-3] == tuple(f"{c}{r.doc_id}" for c in names[:-1]) and isinstance(r["copy"], int) for r in got)
