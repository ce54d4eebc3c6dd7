import datetime as dt

from pyspark.sql import functions as F

from docspark.streaming import op_log, windows

SCHEMA = "op string, k string, seq long, v string, epoch int, ts timestamp"


def put(spark, path, rows):
    base = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(*r[:5], base + dt.timedelta(minutes=r[5])) for r in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_log_is_folded_once(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / x) for x in ("src", "out", "ckpt"))
    put(spark, src, [("o1", "a", 1, "x", 1, 0), ("o1", "a", 1, "x", 1, 0), ("o2", "b", 2, "y", 0, 1)])
    read = lambda: op_log.once(spark.readStream.schema(SCHEMA).parquet(src), "op", "ts", "1 hour", "epoch", 1)
    op_log.fold_batches(read(), "k", "seq", out, ckpt).awaitTermination()
    put(spark, src, [("o1", "a", 1, "x", 1, 2), ("o3", "a", 3, "z", 2, 3)])
    op_log.fold_batches(read(), "k", "seq", out, ckpt).awaitTermination()
    got = op_log.current(spark.read.parquet(out), "k", "seq").collect()
    assert [(r.k, r.v) for r in got] == [("a", "z")]


def test_windows_of_a_stream_equal_the_batch(spark, tmp_path):
    src, ckpt = str(tmp_path / "src"), str(tmp_path / "ckpt")
    put(spark, src, [(f"o{k}", "ab"[k % 2], k, "1", 1, k * 7) for k in range(40)])
    stream = windows.tumbling(spark.readStream.schema(SCHEMA).parquet(src), "ts", "1 hour", ["k"], "seq", late="10 minutes")
    q = stream.writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = windows.tumbling(spark.read.parquet(src), "ts", "1 hour", ["k"], "seq")
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, batch.collect()))
    assert windows.sessions(spark.read.parquet(src), "ts", "10 minutes", ["k"]).count() > 30
    assert windows.tumbling(spark.read.parquet(src), "ts", "1 hour", ["k"], "seq", slide="30 minutes").count() > batch.count()


def test_ingest_steps_see_each_file_once(spark, tmp_path):
    src, ckpt, seen = str(tmp_path / "src"), str(tmp_path / "ckpt"), []
    read = lambda: spark.readStream.schema(SCHEMA).parquet(src)
    for n in (3, 2):
        put(spark, src, [(f"o{n}{k}", "a", k, "", 1, 0) for k in range(n)])
        op_log.ingest(read(), lambda df, i: seen.append(df.count()), ckpt).awaitTermination()
    assert seen == [3, 2]


def test_smart_collections(spark):
    new = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, v array<double>")
    saved = spark.createDataFrame([("x", [1.0, 0.0])], "collection string, q array<double>")
    from docspark.functions import vectors as V

    got = op_log.refresh_collections(new, saved, V.dot(F.col("v"), F.col("q")), 0.9).collect()
    assert [(r.id, r.collection) for r in got] == [(1, "x")]
