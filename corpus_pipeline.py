"""Corpus pipeline: toxicity, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and reread as the next stage's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm import decontamination, mixing, ngram_join, sharding, toxicity
from docspark.llm.store import materialize, workdir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5; the model learns from the labels' rows that op9 learns from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    return toxicity.score(docs.select(*COLUMNS), model).where("score < 0.5").select(*COLUMNS)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: its smallest doc_id; texts without words all stay."""
    return ngram_join.keep_one(docs.select(*COLUMNS)).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark item within a fifth of its words."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.find_leaks(docs.select(*COLUMNS), items).where(F.size("leaks") == 0).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Poisson copies at square-root shares of the sources, in shuffled order."""
    return mixing.replicate(docs.select(*COLUMNS)).select(*COLUMNS)


def write_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's doc_id, source, length and shard."""
    out = sharding.shard(docs.select(*COLUMNS))
    return out.select("doc_id", "source", "lang", F.length("text").cast("long").alias("n_chars"), "shard")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", write_shards),
]

#: The stages learn models and write shards; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    where = workdir(spark)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name, where)
    return STAGES[-1][1](spark, docs, sf_dir)
