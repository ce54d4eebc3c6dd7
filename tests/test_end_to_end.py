import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from docspark.operators import ingest as I
from docspark.plans import portal, retrieval

def key(name="k"):
    return F.unhex(F.sha2(F.lit(name), 256))


FILES = [("a", "block one block two tail"), ("b", ""), ("c", "héllo wörld " * 20)]
BYTES = {k: v.encode() for k, v in FILES}


@pytest.fixture
def stored(spark):
    files = spark.createDataFrame(FILES, "upload string, content string")
    chunks = portal.encrypted(files, portal.plan(files, 10, F.lit("s")), 10, key()).persist()
    m = portal.manifests(chunks)
    empty = files.join(m, "upload", "left_anti").select("upload", F.to_json(F.struct(F.lit(1).alias("version"), F.array().cast("array<struct<ordinal:int,len:long,hash:string>>").alias("chunks"))).cast("binary").alias("stored"))
    m = m.unionByName(empty.withColumn("hash", F.sha2("stored", 256))).persist()
    agents = spark.createDataFrame([("a1", "d1"), ("a2", "d2"), ("a3", "d3")], "agent string, domain string")
    copies = portal.replicate(chunks.select("hash", "stored").union(m.select("hash", "stored")), agents, F.lit(True))
    return files, chunks, m, copies


def test_round_trip(stored):
    files, chunks, m, copies = stored
    assert {r.upload: r.content for r in portal.download(m, copies, key()).collect()} == BYTES
    assert all(r.committable for r in portal.visible(files, chunks, m, copies, 3).collect())
    planned = portal.plan(files, 10, F.lit("s"))
    assert planned.select("iv").distinct().count() == planned.count() == chunks.count()


def test_corrupt_and_missing_copies(stored):
    files, chunks, m, copies = stored
    first = chunks.where("upload = 'a' and ordinal = 0").first().hash
    bad = copies.withColumn("stored", F.when((F.col("hash") == first) & F.col("agent").isin("a1", "a2"), F.lit("junk").cast("binary")).otherwise(F.col("stored")))
    assert {r.upload: r.content for r in portal.download(m, bad, key()).collect()} == BYTES
    assert {r.upload: r.committable for r in portal.visible(files, chunks, m, bad, 2).collect()} == {"a": False, "b": True, "c": True}
    gone = copies.where(F.col("hash") != first)
    got = {r.upload: r.content for r in portal.download(m, gone, key()).collect()}
    assert got == {**BYTES, "a": None}


def test_tampering_is_an_error(stored):
    _, _, m, copies = stored
    swapped = m.withColumn("stored", F.regexp_replace(F.col("stored").cast("string"), '"ordinal":1', '"ordinal":7').cast("binary"))
    with pytest.raises(PySparkException):
        portal.download(swapped, copies, key()).collect()
    with pytest.raises(PySparkException):
        portal.download(m, copies, key("other")).collect()


def corpus(spark):
    files = spark.createDataFrame([(1, "tax-notes.md", "spring tax documents and deductions", 10), (2, "invoice-4021.txt", "invoice for consulting", 30), (3, "meeting.md", "no taxes here, only talk", 20), (4, "scan.pdf", None, 30)], "file_id long, name string, text string, mtime long")
    chunks = I.chunk(files).withColumn("chunk_id", F.col("file_id") * 100 + F.col("ordinal"))
    p = I.HashingProvider(64)
    return files, chunks, I.embed(chunks, p, 32), p


def test_legs_and_console(spark):
    files, chunks, vectors, p = corpus(spark)
    asked = [("q1", "tax deductions"), ("q2", "invoice")]
    queries = spark.createDataFrame(asked, "query_id string, text string")
    semantic = retrieval.file_scores(files, chunks, vectors, retrieval.embed_queries(p, asked, 32, p.identity()), 3)
    legs = retrieval.all_legs(files, queries, 3, semantic)
    top = {(r.leg, r.query_id): r.id for r in legs.where("rank = 1").collect()}
    assert top["semantic", "q1"] == top["keyword", "q1"] == top["name", "q1"] == 1
    assert top["keyword", "q2"] == top["name", "q2"] == 2
    assert [r.id for r in legs.where("leg = 'recency' and query_id = 'q1'").orderBy("rank").collect()] == [2, 4, 3]
    text = retrieval.console(legs.where("query_id = 'q1'"), files)
    assert text.startswith("semantic:\n   1. tax-notes.md") and "recency:" in text
    assert "semantic" not in {r.leg for r in retrieval.all_legs(files, queries, 3).collect()}
    with pytest.raises(ValueError):
        retrieval.embed_queries(p, asked, 32, "another state")


def test_evaluation_and_status(spark):
    files, chunks, vectors, p = corpus(spark)
    asked = [("q1", "tax deductions"), ("q2", "invoice")]
    queries = spark.createDataFrame(asked, "query_id string, text string")
    semantic = retrieval.file_scores(files, chunks, vectors, retrieval.embed_queries(p, asked, 32, None), 3)
    legs = retrieval.all_legs(files, queries, 3, semantic).withColumn("config", F.when(F.col("leg") == "semantic", "hashing:32"))
    qrels = spark.createDataFrame([("q1", 1, 1), ("q2", 2, 1)], "query_id string, id long, grade int")
    got = {r.category: r for r in retrieval.evaluate(legs, qrels, spark.createDataFrame([("q1", "tax")], "query_id string, category string"), 3).collect()}
    assert set(got) == {"tax", "uncategorized", None}
    assert (got[None].judged, got[None].recall) == (2, 1.0)
    assert got["tax"].win_recency == 1 and got["tax"].tie_keyword == 1
    status = {(r.what, r.detail): r.n for r in retrieval.status(spark, files.withColumn("extract_status", F.lit("extracted")), chunks, vectors).collect()}
    assert status == {("files", "extracted"): 4, ("chunks", None): 3, ("vectors", "hashing:32"): 3}


def test_every_query_of_a_large_set_has_a_semantic_leg(spark, tmp_path):
    from docspark.plans import end_to_end_queries as Q

    n = 10_050
    spark.createDataFrame([(1, "tax notes of spring", "a"), (2, "an invoice for consulting", "b")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(n).select(F.col("id").alias("item_id"), F.concat(F.lit("invoice "), F.col("id")).alias("text")).write.parquet(f"{tmp_path}/benchmark.parquet")
    legs = Q.search_all_legs(spark, str(tmp_path)).where("leg = 'semantic'")
    assert legs.select("query_id").distinct().count() == n


def test_binary_files_come_back_as_they_are(spark):
    content = {"x": bytes((i * 31 + 17) % 251 for i in range(1000)), "y": bytes(range(256)), "z": b"\xff\xfe\x00"}
    files = spark.createDataFrame([(k, bytearray(v)) for k, v in content.items()], "upload string, content binary")
    chunks = portal.encrypted(files, portal.plan(files, 100, F.lit("s")), 100, key()).persist()
    m = portal.manifests(chunks)
    agents = spark.createDataFrame([("a1", "d1")], "agent string, domain string")
    copies = portal.replicate(chunks.select("hash", "stored").union(m.select("hash", "stored")), agents, F.lit(True))
    assert {r.upload: bytes(r.content) for r in portal.download(m, copies, key()).collect()} == content


def test_evaluation_without_queries_has_no_rows(spark):
    rankings = spark.createDataFrame([], "config string, leg string, query_id string, rank int, id long")
    qrels = spark.createDataFrame([], "query_id string, id long, grade int")
    out = retrieval.evaluate(rankings, qrels, spark.createDataFrame([], "query_id string, category string"), 10)
    assert out.count() == 0 and {"config", "category", "judged", "recall", "ndcg", "win_name", "tie_recency"} <= set(out.columns)


def test_best_files_of_many_queries_equal_all_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x, m = rng.normal(size=(300, 4)), rng.normal(size=(7, 4))
    file = rng.integers(0, 60, 300)
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "chunk_id long, vector array<double>")
    chunks = spark.createDataFrame([(k, int(f)) for k, f in enumerate(file)], "chunk_id long, file_id long")
    files = spark.createDataFrame([(int(f),) for f in set(file)], "file_id long")
    got = retrieval.file_scores(files, chunks, vectors, [(f"q{k}", v.tolist()) for k, v in enumerate(m)], 5).collect()
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    s = np.round(unit(m) @ unit(x).T, 6)
    for q in range(7):
        best = sorted(((-max(s[q, file == f]), int(f)) for f in set(file)))[:5]
        assert [(r.id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == f"q{q}"] == [(f, pytest.approx(-v)) for v, f in best]


def test_documents_that_contain_items(spark):
    from docspark.operators import text_search as S

    docs = [(1, "the red bolt of spring"), (2, "red bolt of sprin"), (3, ""), (4, None), (5, "xéx the red bolt"), (6, "a"), (7, "bolt of spring bolt of spring")]
    items = [("a", "red bolt of sprin"), ("b", "bolt of spring"), ("c", "a"), ("d", ""), ("e", "éx the red"), ("f", "bolt of spring"), ("g", "nowhere at all")]
    got = S.contained(spark.createDataFrame(docs, "id long, doc string"), items).collect()
    assert sorted((r.query_id, r.id) for r in got) == sorted((q, i) for q, t in items for i, d in docs if d is not None and t in d)


def test_a_provider_stems_each_word_once(monkeypatch):
    """A thousand equal texts cost one stem a word; components are signed counts of hashed stems."""
    import hashlib

    from docspark.functions import text as T

    stems, stem = [], T.porter_stem
    monkeypatch.setattr(T, "porter_stem", lambda w: stems.append(w) or stem(w))
    text = "Running, runs é e\u0301t\u00e9 re-run ΑΣ. \U0001D165x a_b İs \u0301"
    got = I.HashingProvider(24).embed([text] * 1000 + ["", "running"])
    assert len(stems) < 40
    want = [0.0] * 24
    for w in T.index_terms(text):
        h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "big")
        want[h % 24] += 1.0 if h >> 63 else -1.0
    assert got[:1000] == [want] * 1000 and got[1000] == [0.0] * 24 and sum(map(abs, got[1001])) == 1


def test_rankings_are_made_once_for_an_evaluation(spark):
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = [("hashing:8" if leg == "semantic" else None, leg, q, 1, 5) for leg in ("semantic", "name", "keyword", "recency") for q in ("a", "b")]
    rankings = spark.createDataFrame(rows, "config string, leg string, query_id string, rank int, id long")
    rankings = rankings.mapInArrow(run, rankings.schema)
    qrels = spark.createDataFrame([("a", 5, 1)], "query_id string, id long, grade int")
    got = retrieval.evaluate(rankings, qrels, spark.createDataFrame([("a", "x")], "query_id string, category string"), 10).collect()
    assert {(r.category, r.judged, r.recall) for r in got} == {("x", 1, 1.0), (None, 1, 1.0)}
    assert made.value == len(rows)
