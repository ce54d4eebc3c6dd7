"""Command line: prepare, embed, query, eval, status over a store folder.

python -m docspark.cli prepare STORE ROOT
python -m docspark.cli embed STORE --config hashing:64 [--url HOST] [--force]
python -m docspark.cli query STORE "text" [--config hashing:64]
python -m docspark.cli eval STORE queries.json report --config hashing:64 --config hashing:32
python -m docspark.cli status STORE
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions import text as T
from docspark.operators import evaluation as E
from docspark.operators import ingest as I
from docspark.operators import text_search as S
from docspark.plans import reports, retrieval
from docspark.plans.prepare import prepare
from docspark.sources import corpus, provider
from docspark.sources.snapshots import Snapshots

VECTORS = "chunk_id long, model string, dims int, vector array<double>"


def provider_of(model: str, url: str | None, prefix: str = ""):
    """The HTTP provider, or the offline one of 256 dims."""
    return provider.HttpProvider(url, model, prefix) if url else I.HashingProvider(256, model)


def tables(spark: SparkSession, store: str) -> tuple[DataFrame, DataFrame, DataFrame, dict]:
    """Files, chunks with ids, vectors, and the identities of the models that made them."""
    lead = Snapshots(spark, f"{store}/files")
    files, chunks = lead.read(), Snapshots(spark, f"{store}/chunks", lead).read()
    if files is None or chunks is None:
        raise SystemExit("nothing is prepared in this store")
    # The id names file, place and content, so a changed chunk is a new one.
    chunks = chunks.withColumn("chunk_id", F.xxhash64("file_id", "ordinal", "text"))
    snapshot = Snapshots(spark, f"{store}/vectors")
    vectors, pointer = snapshot.read(), snapshot.pointer()
    return files, chunks, spark.createDataFrame([], VECTORS) if vectors is None else vectors.select("chunk_id", "model", F.col("dims").cast("int").alias("dims"), "vector"), pointer["meta"] if pointer else {}


def embed(spark: SparkSession, store: str, config: str, url: str | None, force: bool, concurrency: int | None) -> int:
    """Embed the chunks that have no vector of this configuration; vectors of vanished chunks fall out."""
    model, dims = provider.model_dims(config)
    _, chunks, vectors, meta = tables(spark, store)
    p = provider_of(model, url, "search_document: " if "nomic-embed" in model.lower() else "")
    if force:
        vectors = vectors.where(~((F.col("model") == model) & (F.col("dims") == dims)))
        meta = {k: v for k, v in meta.items() if k != config}
    I.check_identity(meta.get(config), p.identity())
    vectors = I.keep_only(vectors, chunks, "chunk_id")
    rest = I.missing(chunks, vectors, model, dims)
    fresh = I.embed(rest, p, dims, concurrency=concurrency).select("chunk_id", "model", F.col("dims").cast("int").alias("dims"), "vector")
    Snapshots(spark, f"{store}/vectors").write(vectors.unionByName(fresh), {**meta, config: p.identity()}, partition_by=["model", "dims"])
    return rest.count()


def legs(spark: SparkSession, store: str, asked: list[tuple[str, str]], configs: list[str], url: str | None, k: int) -> tuple[DataFrame, DataFrame]:
    """Files and (config, leg, query_id, rank, id, score) rankings of every query."""
    files, chunks, vectors, meta = tables(spark, store)
    named = files.select("file_id", "name", F.col("extracted_text").alias("text"), "mtime", "path")
    queries = spark.createDataFrame(asked, "query_id string, text string")
    out = retrieval.all_legs(named, queries, k).withColumn("config", F.lit(None).cast("string"))
    for config in configs:
        model, dims = provider.model_dims(config)
        if config not in meta:
            raise SystemExit(f"no vectors of {config}")
        p = provider_of(model, url, "search_query: " if "nomic-embed" in model.lower() else "")
        q = retrieval.embed_queries(p, asked, dims, meta[config])
        mine = vectors.where((F.col("model") == model) & (F.col("dims") == dims)).select("chunk_id", "vector")
        semantic = retrieval.file_scores(named, chunks, mine, q, k).select("query_id", "rank", "id", "score", F.lit("semantic").alias("leg"), F.lit(config).alias("config"))
        out = out.unionByName(semantic)
    return named, out


def relevant(files: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id, grade) from ids, globs and grade keys (ids, absolute paths, or selectors among the declared files)."""
    by_id = queries.select(F.col("id").alias("query_id"), F.explode("relevant_file_ids").alias("id"))
    globs = queries.select(F.col("id").alias("query_id"), F.explode("relevant_path_globs").alias("glob"))
    hits = S.glob_matches(globs, files, "path").join(files.select("path", F.col("file_id").alias("id")), "path").select("query_id", "id")
    keys = queries.select(F.col("id").alias("query_id"), F.explode("grades").alias("selector", "grade"))
    number = F.try_to_number("selector", F.lit("9999999999999999999")).cast("long")
    numeric = keys.where(number.isNotNull()).select("query_id", number.alias("id"), "grade")
    absolute = keys.join(files, keys.selector == files.path).select("query_id", F.col("file_id").alias("id"), "grade")
    declared = by_id.union(hits).distinct()
    relative = keys.where(number.isNull() & ~F.col("selector").startswith("/"))
    found = S.selector_matches(relative.select("query_id", "selector"), files, "path").join(files.select("path", F.col("file_id").alias("id")), "path").join(declared, ["query_id", "id"]).join(relative, ["query_id", "selector"]).select("query_id", "id", "grade")
    lost = keys.where(number.isNull()).join(absolute.select("query_id").union(found.select("query_id")).distinct(), "query_id", "left_anti")
    if lost.limit(1).count():
        raise SystemExit("a grade names no declared file")
    return E.relevance(by_id, hits, numeric.union(absolute).union(found))


def evaluate(spark: SparkSession, store: str, path: str, base: str, configs: list[str], url: str | None, k: int) -> dict:
    """Write base.md, .html and .json; the recommendation."""
    queries = corpus.load_queries(spark, path)
    asked = [(r.id, r.text) for r in queries.select("id", "text").orderBy("id").toLocalIterator()]  # the query set
    files, rankings = legs(spark, store, asked, configs, url, k)
    out = retrieval.evaluate(rankings, relevant(files, queries), queries.select(F.col("id").alias("query_id"), "category"), k)
    rows = sorted(reports.rows_of(out), key=lambda r: (configs.index(r["config"]), r["category"] is not None, r["category"] or ""))
    whole = [r for r in rows if r["category"] is None]
    decided = [r["win_name"] + r["loss_name"] for r in whole]
    advice = E.recommend([E.Config(*provider.model_dims(r["config"]), r["ndcg"], r["win_name"] / n if n else 0.0, n, r["judged"]) for r, n in zip(whole, decided, strict=True)])
    reports.write(base, "Evaluation", {"configurations": rows, "recommendation": [advice]})
    return advice


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="docspark", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    add = lambda name, *args: [c := sub.add_parser(name), c.add_argument("store"), *(c.add_argument(a) for a in args)][0]
    c = add("prepare", "root")
    c.add_argument("--size", type=int, default=2000)
    c.add_argument("--overlap", type=int, default=200)
    c = add("embed")
    c.add_argument("--config", required=True)
    c.add_argument("--force", action="store_true")
    c.add_argument("--concurrency", type=int)
    c.add_argument("--url")
    for c in (add("query", "text"), add("eval", "queries", "report")):
        c.add_argument("--config", action="append", default=[])
        c.add_argument("--k", type=int, default=10)
        c.add_argument("--url")
    add("status")
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("docspark").getOrCreate()
    if a.command == "prepare":
        print(prepare(spark, a.root, a.store, a.size, a.overlap))
    elif a.command == "embed":
        print(f"{embed(spark, a.store, a.config, a.url, a.force, a.concurrency)} chunks embedded")
    elif a.command == "query":
        files, ranked = legs(spark, a.store, [("q", a.text)], a.config[:1], a.url, a.k)
        print(retrieval.console(ranked, files))
    elif a.command == "eval":
        print(evaluate(spark, a.store, a.queries, a.report, a.config, a.url, a.k)["text"])
    else:
        files, chunks, vectors, _ = tables(spark, a.store)
        for r in reports.rows_of(retrieval.status(spark, files, chunks, vectors).orderBy("what", "detail")):
            print(r["what"], T.markdown_cell(str(r["detail"] or "")), r["n"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
