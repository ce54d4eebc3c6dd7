import math
import os
import random
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from docspark.operators import catalog as C
from docspark.operators import evaluation as E
from docspark.operators import ingest as I
from docspark.operators import text_search as S
from docspark.operators import vector_search as V


def test_ranking_and_ties(spark):
    v = spark.createDataFrame([(1, [0.0, 1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [1.0, 0.0, 0.0])], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in V.knn(v, [1, 0, 0], 3).collect()] == [2, 3, 1]
    assert V.knn(v.limit(0), [1, 0, 0], 3).count() == 0


def test_batch_equals_single_queries(spark):
    rng = np.random.default_rng(1)
    rows = [(k, rng.integers(-2, 3, 4).astype(float).tolist()) for k in range(60)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = V.knn_batch(v, v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), 4).collect()
    for q, vec in rows[::13]:
        want = [(r.vec_id, r.score) for r in V.knn(v.where(f"vec_id <> {q}"), vec, 4).collect()]
        assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == want


def test_centroid_search_recall(spark):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(6, 8))
    rows = [(k, (centers[k % 6] + rng.normal(size=8) * 0.1).tolist()) for k in range(300)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    exact = {r.vec_id for r in V.knn(v, rows[0][1], 10).collect()}
    index = V.CentroidIndex(v, 6)
    assert len(exact & {r.vec_id for r in index.search(rows[0][1], 10, 2).collect()}) >= 9
    assert exact == {r.vec_id for r in index.search(rows[0][1], 10, 6).collect()}


def test_keyword_search_is_scoped_and_matches_prefixes(spark):
    docs = spark.createDataFrame([(1, "alpha", "beta tax"), (2, "tax", "beta"), (3, "x", "taxes taxes"), (4, "y", None)], "doc_id long, name string, body string")
    q = spark.createDataFrame([(1, "tax"), (2, "none!"), (3, "...")], "query_id long, text string")
    fields = {"name": "name", "body": "body"}
    body = S.bm25(docs, q, "body", fields, "doc_id", "query_id", "text").collect()
    assert sorted((r.query_id, r.id) for r in body) == [(1, 1), (1, 3)]
    name = S.bm25(docs, q, "name", fields, "doc_id", "query_id", "text").collect()
    assert [(r.query_id, r.id) for r in name] == [(1, 2)]


def test_bm25_equals_the_formula(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["ab", "abc", "b", "cd", "cde", "e"]) for _ in range(rng.randrange(1, 12))) for _ in range(30)]
    docs = spark.createDataFrame([(k, "nm", t) for k, t in enumerate(texts)], "doc_id long, name string, body string")
    q = spark.createDataFrame([(1, "ab e"), (2, "cd")], "query_id long, text string")
    got = {(r.query_id, r.id): r.score for r in S.bm25(docs, q, "body", {"name": "name", "body": "body"}, "doc_id", "query_id", "text").collect()}
    words = [t.split() for t in texts]
    avg = sum(len(w) + 1 for w in words) / len(words)
    want = {}
    for i, terms in ((1, ["ab", "e"]), (2, ["cd"])):
        for t in terms:
            tf = {k: sum(x.startswith(t) for x in w) for k, w in enumerate(words)}
            df = sum(n > 0 for n in tf.values())
            idf = math.log((len(words) - df + 0.5) / (df + 0.5))
            for k, n in tf.items():
                if n:
                    want[i, k] = want.get((i, k), 0) + (idf if idf > 0 else 1e-6) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * (len(words[k]) + 1) / avg))
    assert got == pytest.approx(want, abs=1e-5)


def test_fallback_is_per_query(spark):
    names = spark.createDataFrame([(1, "tax-notes.md"), (2, "syntax.md"), (3, "other")], "id long, name string")
    q = spark.createDataFrame([(1, "tax"), (2, "yntax other"), (3, "zzz"), (4, "!!")], "query_id long, text string")
    got = sorted((r.query_id, r.id, r.via) for r in S.name_search(names, q, 5, "id", "name").collect())
    assert got == [(1, 1, "match"), (2, 3, "match")]
    got = sorted((r.query_id, r.id, r.score) for r in S.like_search(names, q, 5, "id", "name").collect())
    assert got == [(1, 1, 11), (1, 2, 11), (2, 2, 1), (2, 3, 1)]


def test_fusion(spark):
    leg = lambda *ids: spark.createDataFrame([(1, i, r) for r, i in enumerate(ids, 1)], "query_id long, id long, rank int")
    got = S.fuse({"a": leg(1, 2, 3), "b": leg(3, 1)}, 10).orderBy("rank").collect()
    assert [r.id for r in got] == [1, 3, 2]
    assert got[0].score == pytest.approx(1 / 61 + 1 / 62, abs=1e-8)
    exact = spark.createDataFrame([(1, 9), (1, 2)], "query_id long, id long")
    assert [r.id for r in S.fuse({"a": leg(1, 2)}, 10, exact).orderBy("rank").collect()] == [2, 9, 1]
    assert [r.id for r in S.fuse({"a": leg(1, 2), "b": leg(5).limit(0)}, 1).collect()] == [1]


def test_hydrate_and_selectors(spark):
    ranked = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "query_id long, id long, rank int")
    files = spark.createDataFrame([(5, "/v/Notes/tax.md"), (7, "/v/a/tax.txt")], "file_id long, path string")
    assert [(r.id, r.path) for r in S.hydrate(ranked, files, "file_id").collect()] == [(5, "/v/Notes/tax.md")]
    sel = spark.createDataFrame([(1, "TAX"), (2, "notes/tax.md"), (3, "a"), (4, "x")], "query_id long, selector string")
    got = sorted((r.query_id, r.path) for r in S.selector_matches(sel, files, "path").collect())
    assert got == [(1, "/v/Notes/tax.md"), (1, "/v/a/tax.txt"), (2, "/v/Notes/tax.md"), (3, "/v/a/tax.txt")]


def test_recall_and_ndcg(spark):
    rank = spark.createDataFrame([(1, i, r) for r, i in enumerate([3, 1, 4, 2], 1)], "query_id long, id long, rank int")
    qrels = spark.createDataFrame([(1, 1, 1), (1, 2, 1), (2, 9, 2)], "query_id long, id long, grade int")
    at2 = {r.query_id: r for r in E.metrics(rank, qrels, 2).collect()}
    at4 = {r.query_id: r for r in E.metrics(rank, qrels, 4).collect()}
    assert (at2[1].recall, at4[1].recall, at4[1].first_hit) == (0.5, 1.0, 2)
    ideal = 1 + 1 / math.log2(3)
    assert at4[1].ndcg == pytest.approx((1 / math.log2(3) + 1 / math.log2(5)) / ideal, abs=1e-6)
    assert (at4[2].recall, at4[2].ndcg, at4[2].first_hit) == (0, 0, None)


def test_percentile_and_outcomes(spark):
    assert E.percentile([20, 10, 50, 30, 40], 0.5) == 30
    assert E.percentile([20, 10, 50, 30, 40], 0.95) == 50
    assert E.percentile([], 0.5) == 0
    rows = [(1, 2, "win"), (2, 1, "loss"), (1, 1, "tie"), (None, None, "tie"), (1, None, "win"), (None, 1, "loss")]
    got = spark.createDataFrame(rows, "a int, b int, want string").select(E.outcome(F.col("a"), F.col("b")).alias("o"), "want").collect()
    assert all(r.o == r.want for r in got)
    rates = {r.category: (r.wins, r.losses, r.ties, r.win_rate) for r in E.win_rates(spark.createDataFrame([("x", "win"), ("x", "tie"), ("y", "loss"), ("z", "tie")], "category string, outcome string")).collect()}
    assert rates == {"x": (1, 0, 1, 1.0), "y": (0, 1, 0, 0.0), "z": (0, 0, 1, 0.0), None: (1, 1, 2, 0.5)}


def config(model="nomic-embed-text", dims=512, ndcg=0.7, win=0.7, decided=30, judged=50):
    return E.Config(model, dims, ndcg, win, decided, judged)


@pytest.mark.parametrize(
    ("configs", "go", "locked", "dims"),
    [
        ([], False, False, None),
        ([config(dims=1024)], False, False, None),
        ([config(dims=768), config(dims=512, ndcg=0.69)], True, True, 512),
        ([config(dims=768, ndcg=0.8), config(dims=512, ndcg=0.7)], True, True, 768),
        ([config(judged=20)], True, False, 512),
        ([config(model="m", dims=768), config(model="m", dims=256, ndcg=0.69)], True, False, 768),
        ([config(win=0.5)], False, False, 512),
        ([config(win=0.0, decided=0, ndcg=0.95)], True, False, 512),
        ([config(win=0.0, decided=0, ndcg=0.8)], False, False, 512),
        ([config(model="m", dims=768, win=0.7), config(model="m", dims=384, win=0.7)], True, False, 384),
    ],
)
def test_selection_policy(configs, go, locked, dims):
    r = E.recommend(configs)
    assert (r["go"], r["locked"], r["dims"]) == (go, locked, dims)
    assert r["text"].endswith("; dims not locked") or locked or not configs or dims is None


def test_report_comparison(spark):
    from docspark.plans import reports

    a, b = {"k": 10, "configs": [{"ndcg": 0.5}], "only": 1}, {"k": 10, "configs": [{"ndcg": 0.6}]}
    df = lambda x: spark.createDataFrame(reports.flatten(x), "path string, value string")
    assert sorted(r.path for r in E.differences(df(a), df(b)).collect()) == ["configs[0].ndcg", "only"]
    assert E.provenance_problems({"rev": "a", "m": ""}, {"rev": "b", "m": "x"}, ["rev", "m"]) == ["rev: a != b", "m: missing"]
    md = reports.to_markdown("R", {"t": [{"a": "x|y", "b": 1}]})
    assert "| x\\|y | 1 |" in md and "&lt;" in reports.to_html("<", {})


def test_commit_gate_needs_hash_floor_and_manifest(spark):
    chunks = spark.createDataFrame([("u1", "h", 3), ("u1", "i", 3), ("u2", None, 3), ("u3", "h", 2), ("u4", "h", 3)], "upload string, hash string, domains int")
    manifests = spark.createDataFrame([("u1", 3), ("u2", 3), ("u3", 3), ("u4", 1)], "upload string, domains int")
    got = {r.upload: r.committable for r in C.commit_gate(chunks, "upload", 3, manifests).collect()}
    assert got == {"u1": True, "u2": False, "u3": False, "u4": False}


def test_transitions_and_log(spark):
    h = spark.createDataFrame([("a", 1, "staging"), ("a", 2, "replicating_chunks"), ("a", 3, "committed"), ("b", 1, "staging"), ("b", 2, "failed")], "id string, seq int, state string")
    assert [(r.id, r.previous, r.state) for r in C.illegal_moves(h, "id", ["seq"], "state", C.TRANSITIONS).collect()] == [("a", "replicating_chunks", "committed")]
    log = spark.createDataFrame([(1, "x", 1, "p", False), (1, "x", 1, "p", False), (2, "y", 2, "q", False), (3, "x", 3, None, True)], "op long, k string, seq int, v string, gone boolean")
    snap = spark.createDataFrame([(0, "z", 0, "s", False)], "op long, k string, seq int, v string, gone boolean")
    assert sorted((r.k, r.v) for r in C.fold_log(log, "k", "seq", "op", F.col("gone"), snap).collect()) == [("y", "q"), ("z", "s")]


def test_blocks_replicas_and_encryption(spark):
    payload = "".join(chr(97 + (i * 31 + 17) % 25) for i in range(4096 + 37))
    files = spark.createDataFrame([(1, payload), (2, "")], "id long, content string")
    assert [(r.id, r.ordinal, r.len) for r in C.blocks(files, "id", "content", 4096).orderBy("ordinal").collect()] == [(1, 0, 4096), (1, 1, 37)]
    r = spark.createDataFrame([("a", "bad"), ("b", "good"), ("c", "good")], "agent string, content string").withColumn("hash", F.sha2(F.lit("good"), 256))
    x = C.first_valid_replica(r, "hash", "agent", "content").first()
    assert (x.content, x.valid, x.copies) == ("good", 2, 3)
    assert C.first_valid_replica(r.where("agent = 'a'"), "hash", "agent", "content").first().content is None
    key, iv, aad = F.unhex(F.lit("00" * 16)), F.unhex(F.lit("01" * 12)), F.lit("v1").cast("binary")
    e = files.select("content", C.encrypt(F.col("content").cast("binary"), key, iv, aad).alias("e"))
    assert all(r.content == r.d.decode() for r in e.select("content", C.decrypt(F.col("e"), key, aad).alias("d")).collect())
    from pyspark.errors import PySparkException

    with pytest.raises(PySparkException):
        e.select(C.decrypt(F.col("e"), key, F.lit("v2").cast("binary"))).collect()


def test_placement_packing():
    assert C.pack_placements([("p", 5), ("q", 3), ("r", 2)], [("a", 6), ("b", 6)]) == {"p": "a", "q": "b", "r": "b"}
    with pytest.raises(ValueError):
        C.pack_placements([("p", 9)], [("a", 6)])


def test_fingerprints_keep_parts_apart(spark):
    f = lambda *p: spark.range(1).select(C.request_fingerprint(*(F.lit(x) for x in p)).alias("x")).first().x
    assert f("ab", "c") != f("a", "bc")


def test_embedding_resumes(spark):
    p = I.HashingProvider(16)
    chunks = spark.createDataFrame([(k, f"text number {k}") for k in range(30)], "chunk_id long, text string")
    some = I.embed(chunks.where("chunk_id < 10"), p, 8)
    rest = I.missing(chunks, some, "hashing", 8)
    assert rest.count() == 20
    assert I.missing(chunks, some, "hashing", 16).count() == 30
    both = some.union(I.embed(rest, p, 8, concurrency=2))
    assert I.missing(chunks, both, "hashing", 8).count() == 0
    assert all(abs(sum(x * x for x in r.vector) - 1) < 1e-9 or not any(r.vector) for r in both.collect())
    I.check_identity(None, p.identity())
    with pytest.raises(ValueError):
        I.check_identity("other", p.identity())


def test_corpus_fingerprint_ignores_order(spark):
    a = spark.createDataFrame([(k, f"h{k}") for k in range(300)], "path long, h string")
    f = lambda df: I.content_fingerprint(df, ["path", "h"]).first().fingerprint
    assert f(a) == f(a.orderBy(F.desc("path")).repartition(7)) != f(a.where("path > 0"))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_centroid_cells_ask_all_queries_at_recall(spark):
    from docspark.operators import vector_search as S
    from docspark.plans import vector_queries as Q

    d = "/root/testdata/sf0.1"
    v = spark.read.parquet(f"{d}/embeddings.parquet")
    asked = v.where("vec_id % 20 = 0").selectExpr("vec_id as query_id", "embedding as vector")
    exact, got = ({(r.query_id, r.vec_id) for r in x.collect()} for x in (S.knn_batch(v, asked, 10), Q.knn_centroid_cells(spark, d)))
    assert len(exact) == 10 * asked.count() and {q for q, _ in got} == {q for q, _ in exact}
    assert len(got & exact) / len(exact) >= 0.9
    print("recall", len(got & exact) / len(exact))


def test_keyword_matches_equal_the_full_text_engine(spark):
    """Words are found by their stems and without diacritics, as the standard library's SQLite does with porter unicode61."""
    c = sqlite3.connect(":memory:")
    try:
        c.execute("CREATE VIRTUAL TABLE f USING fts5(name, body, tokenize='porter unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("no full-text extension")
    bodies = ["They run and run", "running ponies", "Pony rides, été à Paris", "generalizations of relations", "the general's relative", "ETE 2024", "run_time re-run", "", "relational generality", "x"]
    for k, b in enumerate(bodies):
        c.execute("INSERT INTO f(rowid, name, body) VALUES (?, 'nothing', ?)", (k, b))
    queries = ["running", "ponies", "été", "generalized relation", "run", "rel", "2024 rides"]
    docs = spark.createDataFrame([(k, "nothing", b) for k, b in enumerate(bodies)], "doc_id long, name string, body string")
    got = S.bm25(docs, spark.createDataFrame(list(enumerate(queries)), "query_id long, text string"), "body", {"name": "name", "body": "body"}, "doc_id", "query_id", "text").collect()
    for q, text in enumerate(queries):
        match = " OR ".join(f'"{t}"*' for t in text.split())
        want = {r[0] for r in c.execute("SELECT rowid FROM f WHERE f MATCH ?", (f"body : ({match})",))}
        assert {r.id for r in got if r.query_id == q} == want, text


def test_nearest_rank_of_groups_equals_sorting(spark):
    rng = random.Random(6)
    rows = [("a", rng.gauss(0, 1e6)) for _ in range(501)] + [("b", 3.0)] * 40 + [("c", float(rng.randrange(4))) for _ in range(77)] + [("d", -1.5), (None, 2.0), (None, 8.0), ("e", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    for q in (0.0, 0.5, 0.95, 1.0):
        got = {r.g: r.value for r in E.nearest_rank(df, ["g"], "v", q).collect()}
        assert got == {g: E.percentile([v for h, v in rows if h == g], q) for g in ("a", "b", "c", "d", None)}


def shuffled(spark, f):
    """Bytes that a job exchanges."""
    one = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before, got = one(), f()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return one() - before, got


def test_best_documents_equal_those_of_all_pairs(spark):
    import random

    r = random.Random(3)
    kinds = ["running", "runs", "ran", "café", "cafes", "x", "re-run", "a", "the", "happily", "happy"]
    some = lambda n: " ".join(r.choices(kinds, k=r.randint(0, n)))
    docs = spark.createDataFrame([(i - 50, some(3) if i % 9 else None, some(12)) for i in range(300)], "id long, name string, body string").repartition(3)
    queries = spark.createDataFrame([(f"q{i}", some(4)) for i in range(40)] + [("none", "zzz"), ("empty", ""), ("null", None)], "query_id string, text string")
    for fields, field in (({"name": "name", "body": "body"}, "body"), ({"name": "name"}, "name")):
        want = S.top_k(S.bm25(docs, queries, field, fields, "id", "query_id", "text"), 7).select("query_id", "id", "score", "rank")
        got = S.bm25_top(docs, queries, field, fields, 7, "id", "query_id", "text")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []
    assert S.bm25_top(docs, queries.limit(0), "body", {"body": "body"}, 7, "id", "query_id", "text").count() == 0
    assert S.bm25_top(docs.limit(0), queries, "body", {"body": "body"}, 7, "id", "query_id", "text").count() == 0


def test_equal_names_are_not_paired(spark, tmp_path):
    """1,500 queries of 3,000 parts with three names: 1.5 million pairs of equal names, of which 15,000 are returned."""
    from docspark.plans import record_queries as Q

    spark.range(3000).selectExpr("id as p_partkey", "element_at(array('red bolt', 'red gear', 'old ring'), cast(id % 3 as int) + 1) as p_name", "cast(7 + id % 2 as int) as p_size").write.parquet(f"{tmp_path}/part.parquet")
    moved, rows = shuffled(spark, Q.exact_names_first(spark, str(tmp_path)).collect)
    assert moved < 3_000_000
    assert len(rows) == 15_000
    for q, name in ((0, 0), (1, 1), (2, 2), (2998, 1)):
        mine = sorted((r["rank"], r.id, r.exact) for r in rows if r.query_id == q)
        assert mine == [(i + 1, name + 3 * i, True) for i in range(10)] if q % 2 == 0 else mine == []


def test_postings_are_counted_where_their_rows_are(spark, tmp_path):
    """300 documents of 400 words: 120,000 postings, of which no row is exchanged, only 11 terms of each task; a shared or missing id, marks alone and nulls too."""
    from docspark.plans import record_queries as Q

    words = "running runs é e\u0301te cafés cafe re-run \u0301 Alpha beta"
    rows = [(i, f"{words} {' '.join(f'w{i}x{j}' for j in range(400))}", "Sources run") for i in range(300)]
    rows += [(7, "cafe again", "s"), (13, "x", "Sources"), (None, "running", "s"), (9, None, None), (23, "y", None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    moved, n = shuffled(spark, S.packed_postings(docs, "doc_id", "text").selectExpr("sum(size(postings))").first)
    assert moved < 5_000 and n[0] > 120_000
    got = {r.term: (r.tf, r.df) for r in Q.postings_maintained(spark, str(tmp_path)).collect()}
    # 240 documents are kept; the 30 changed ones, one of them twice, have their source.
    assert got["run"] == (240 * 3 + 30, 240 + 30) and got["sourc"] == (31, 30)
    assert got["cafe"] == (240 * 2 + 1, 240) and got["w5x399"] == (1, 1) and "w3x1" not in got and "w4x1" not in got and "y" not in got
