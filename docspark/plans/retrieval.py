"""Retrieval end to end: the four legs of a query, status, and evaluation of configurations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.operators import evaluation as E
from docspark.operators import text_search as T
from docspark.operators import vector_search as V
from docspark.operators.ingest import EmbeddingProvider, check_identity


def file_scores(files: DataFrame, chunks: DataFrame, vectors: DataFrame, queries: list[tuple[str, list[float]]], k: int) -> DataFrame:
    """(query_id, rank, id, score): best files of each query vector by max-similarity over their chunks.

    vectors: (chunk_id, vector) of one configuration, with file_id or else found by
    chunks: (chunk_id, file_id). A file's chunks may lie in several tasks: whichever
    holds its best chunk keeps the file, if it is among the k best.
    """
    import numpy as np
    import pyarrow as pa

    names = [q for q, _ in queries]
    m = V._unit(np.array([v for _, v in queries], np.float64)) if queries else np.zeros((0, 1))

    def run(batches):
        """The k best files of each query in the task, chunks of a file united as far as they are here."""
        ids, best = np.zeros(0, np.int64), np.zeros((len(m), 0))
        last, open_ = None, None  # the file whose chunks may go on in the next batch

        def keep(more, scores):
            nonlocal ids, best
            ids, best = np.concatenate((ids, more)), np.concatenate((best, scores), axis=1)
            if len(ids) > 4 * k + 64:
                ids, best = kept(ids, best)

        def kept(ids, best):
            """Each file once, and only those that are among the k best of some query."""
            order = np.argsort(ids, kind="stable")
            ids, best = ids[order], best[:, order]
            first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
            ids, best = ids[first], np.maximum.reduceat(best, first, axis=1)
            some = np.zeros(len(ids), bool)
            some[np.lexsort((np.broadcast_to(ids, best.shape), -best), axis=1)[:, :k].ravel()] = True
            return ids[some], best[:, some]

        for b in batches:
            if not b.num_rows or not len(m):
                continue
            s = np.round(m @ V._unit(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)).T, 6)
            s = np.where(np.isnan(s), -np.inf, s)
            file = b.column(0).to_numpy()
            first = np.flatnonzero(np.concatenate(([True], file[1:] != file[:-1])))
            top = np.maximum.reduceat(s, first, axis=1)
            if last is not None and file[0] == last:
                top[:, 0] = np.maximum(top[:, 0], open_)
            elif last is not None:
                keep(np.array([last]), open_[:, None])
            keep(file[first[:-1]], top[:, :-1])
            last, open_ = int(file[-1]), top[:, -1]
        if last is not None:
            keep(np.array([last]), open_[:, None])
        if len(ids):
            ids, best = kept(ids, best)
            order = np.lexsort((np.broadcast_to(ids, best.shape), -best), axis=1)[:, :k]
            score = np.take_along_axis(best, order, 1).ravel()
            yield pa.RecordBatch.from_pydict({"q": pa.array(np.repeat(np.arange(len(m)), order.shape[1]), pa.int64()), "id": pa.array(ids[order.ravel()], pa.int64()), "score": pa.array(score + 0.0)})

    dims = len(queries[0][1]) if queries else 0
    rows = vectors.where(F.size("vector") == dims)
    rows = rows if "file_id" in rows.columns else rows.join(chunks.select("chunk_id", "file_id"), "chunk_id")
    rows = rows.select(F.col("file_id").cast("long").alias("file_id"), F.col("vector").cast("array<double>").alias("vector"))
    best = rows.mapInArrow(run, "q long, id long, score double").groupBy("q", "id").agg(F.max("score").alias("score"))
    named = files.sparkSession.createDataFrame(list(enumerate(names)), "q long, query_id string")
    return T.top_k(best.join(F.broadcast(named), "q").drop("q"), k)


def all_legs(files: DataFrame, queries: DataFrame, k: int, semantic: DataFrame | None = None) -> DataFrame:
    """(leg, query_id, rank, id, score) of the name, keyword and recency legs, and the semantic one if there is a provider.

    files: (file_id, name, text, mtime); queries: (query_id, text). Recency is
    the same for every query and ranked once.
    """
    fields = {"name": "name", "text": "text"}
    name = T.name_search(files, queries, k, "file_id", "name").withColumn("leg", F.lit("name"))
    keyword = T.bm25_top(files, queries, "text", fields, k, "file_id", "query_id", "text").withColumn("leg", F.lit("keyword"))
    newest = T.top_k(files.select(F.lit(0).alias("query_id"), F.col("file_id").alias("id"), F.col("mtime").cast("double").alias("score")), k).drop("query_id")
    recency = queries.select("query_id").crossJoin(F.broadcast(newest)).withColumn("leg", F.lit("recency"))
    cols = ["leg", "query_id", "rank", "id", F.col("score").cast("double").alias("score")]
    out = name.select(*cols).union(keyword.select(*cols)).union(recency.select(*cols))
    if semantic is not None:
        out = out.union(semantic.withColumn("leg", F.lit("semantic")).select(*cols))
    return out


def embed_queries(provider: EmbeddingProvider, queries: list[tuple[str, str]], dims: int, stored_identity: str | None) -> list[tuple[str, list[float]]]:
    """Query vectors cut to dims; refused if the stored vectors come from another state of the model."""
    check_identity(stored_identity, provider.identity())
    return [(q, v[:dims]) for (q, _), v in zip(queries, provider.embed([t for _, t in queries]), strict=True)]


def evaluate(rankings: DataFrame, qrels: DataFrame, categories: DataFrame, k: int) -> DataFrame:
    """Per configuration, category and over all (category null): judged, recall, nDCG and outcomes against the other legs.

    rankings: (config, leg, query_id, rank, id); legs other than `semantic` have
    config null and are used with every configuration. They are read several times, so they are kept.
    """
    rankings, qrels = rankings.persist(), qrels.persist()
    ours = rankings.where("leg = 'semantic'")
    per = []
    configs = [r.config for r in ours.select("config").distinct().orderBy("config").limit(101).collect()]
    if len(configs) > 100:
        raise ValueError("at most 100 configurations are compared")
    firsts = {leg: E.metrics(rankings.where(F.col("leg") == leg), qrels, k).select("query_id", F.col("first_hit").alias(leg)) for leg in ("name", "keyword", "recency")}
    for c in configs:
        m = E.metrics(ours.where(F.col("config") == c), qrels, k).withColumn("config", F.lit(c))
        for leg, f in firsts.items():
            m = m.join(f, "query_id", "left").withColumn(f"vs_{leg}", E.outcome(F.col("first_hit"), F.col(leg)))
        per.append(m)
    if not per:  # nothing was ranked: no configuration to judge
        per = [E.metrics(ours, qrels, k).withColumn("config", F.lit(None).cast("string")).where("false")]
        for leg in firsts:
            per[0] = per[0].withColumn(leg, F.lit(None).cast("int")).withColumn(f"vs_{leg}", F.lit("tie"))
    all_ = per[0]
    for m in per[1:]:
        all_ = all_.union(m)
    if not configs:
        return all_.select("config", F.lit(None).cast("string").alias("category"), F.lit(0).cast("long").alias("judged"), "recall", "ndcg", *(F.lit(0).cast("long").alias(f"{o}_{leg}") for leg in firsts for o in ("win", "loss", "tie")))
    all_ = all_.join(categories, "query_id", "left").withColumn("category", F.coalesce("category", F.lit("uncategorized")))
    counts = [F.count(F.when(F.col(f"vs_{leg}") == o, 1)).alias(f"{o}_{leg}") for leg in firsts for o in ("win", "loss", "tie")]
    return all_.groupBy("config", "category").agg(F.count("*").alias("judged"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("ndcg"), 6).alias("ndcg"), *counts).unionByName(
        all_.groupBy("config").agg(F.count("*").alias("judged"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("ndcg"), 6).alias("ndcg"), *counts).withColumn("category", F.lit(None).cast("string"))
    )


def status(spark: SparkSession, files: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """(what, detail, n): files by extraction state, chunks, vectors by configuration."""
    a = files.groupBy("extract_status").agg(F.count("*").alias("n")).select(F.lit("files").alias("what"), F.col("extract_status").alias("detail"), "n")
    b = chunks.agg(F.count("*").alias("n")).select(F.lit("chunks").alias("what"), F.lit(None).cast("string").alias("detail"), "n")
    c = vectors.groupBy("model", "dims").agg(F.count("*").alias("n")).select(F.lit("vectors").alias("what"), F.concat_ws(":", "model", "dims").alias("detail"), "n")
    return a.union(b).union(c)


def console(legs: DataFrame, files: DataFrame, leg_order: tuple[str, ...] = ("semantic", "name", "recency", "keyword"), most: int = 500) -> str:
    """The legs of a query as text; k rows a leg."""
    rows = T.hydrate(legs, files.select("file_id", "name"), "file_id").orderBy("query_id", "leg", "rank").limit(most).collect()
    out = []
    for leg in leg_order:
        mine = [r for r in rows if r.leg == leg]
        if mine:
            out.append(f"{leg}:")
            out += [f"  {r['rank']:>2}. {r.name} ({r.score:.4f})" for r in mine]
    return "\n".join(out)
