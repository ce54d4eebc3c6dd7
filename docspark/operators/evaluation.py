"""Ranking evaluation: relevance sets, recall, nDCG, wins, percentiles, selection, comparison."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def relevance(ids: DataFrame, globs: DataFrame, grades: DataFrame) -> DataFrame:
    """(query_id, id, grade): ids, glob hits and graded ids united; an ungraded one has grade 1."""
    all_ = ids.select("query_id", "id").union(globs.select("query_id", "id")).union(grades.select("query_id", "id")).distinct()
    g = grades.groupBy("query_id", "id").agg(F.max("grade").alias("grade"))
    return all_.join(g, ["query_id", "id"], "left").select("query_id", "id", F.coalesce("grade", F.lit(1)).cast("int").alias("grade"))


def metrics(rankings: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """Per query with relevant ids: n_relevant, hits, recall, ndcg, first_hit (rank, or null).

    Gain 2^grade - 1, discount log2(rank + 1); the ideal list uses all grades;
    recall divides by all relevant ids.
    """
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    w = Window.partitionBy("query_id").orderBy(F.desc("grade"), "id")
    ideal = qrels.withColumn("r", F.row_number().over(w)).groupBy("query_id").agg(F.count("*").alias("n_relevant"), F.coalesce(F.sum(F.when(F.col("r") <= k, gain / F.log2(F.col("r") + 1.0))), F.lit(0.0)).alias("idcg"))
    hit = rankings.join(qrels, ["query_id", "id"]).groupBy("query_id").agg(
        F.count(F.when(F.col("rank") <= k, 1)).alias("hits"),
        F.sum(F.when(F.col("rank") <= k, gain / F.log2(F.col("rank") + 1.0))).alias("dcg"),
        F.min("rank").alias("first_hit"),
    )
    out = ideal.join(hit, "query_id", "left")
    return out.select(
        "query_id",
        "n_relevant",
        F.coalesce("hits", F.lit(0)).alias("hits"),
        F.round(F.coalesce(F.col("hits") / F.col("n_relevant"), F.lit(0.0)), 6).alias("recall"),
        F.round(F.coalesce(F.col("dcg") / F.nullif(F.col("idcg"), F.lit(0.0)), F.lit(0.0)), 6).alias("ndcg"),
        "first_hit",
    )


def outcome(ours: Column, other: Column) -> Column:
    """win, loss or tie by the rank of the first hit; no hit on either side, or equal ranks, is a tie."""
    return (
        F.when(ours.isNull() & other.isNull(), "tie")
        .when(other.isNull() | (ours < other), "win")
        .when(ours.isNull() | (other < ours), "loss")
        .otherwise("tie")
    )


def win_rates(pairs: DataFrame, category: str = "category") -> DataFrame:
    """Counts by category, and over all (category null), of (category, outcome) rows: one rollup."""
    count = lambda o: F.count(F.when(F.col("outcome") == o, 1))
    out = pairs.rollup(category).agg(count("win").alias("wins"), count("loss").alias("losses"), count("tie").alias("ties"))
    return out.withColumn("win_rate", F.round(F.coalesce(F.col("wins") / F.nullif(F.col("wins") + F.col("losses"), F.lit(0)), F.lit(0.0)), 6))


def nearest_rank(values: DataFrame, by: list[str], value: str, q: float) -> DataFrame:
    """The sorted value at index round((n - 1) q), half away from zero, of each group.

    Rows are counted by value before anything is exchanged, and a group's different
    values by their first 12 of 64 ordered bits, so the value's range is found from
    4,096 counts a group at most; only the values of that range are sorted.
    """
    counts = values.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("value")).agg(F.count("*").alias("c"))
    width = lambda x: F.floor((x - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * 4095)
    ends = counts.groupBy(*by).agg(F.min("value").cast("double").alias("lo"), F.max("value").cast("double").alias("hi"), F.sum("c").alias("n"))
    ends = ends.withColumn("at", F.round((F.col("n") - 1) * F.lit(q)).cast("long"))
    on = lambda x, y: [F.col(f"{x}.{k}").eqNullSafe(F.col(f"{y}.{k}")) for k in by]
    both = counts.alias("v").join(ends.alias("e"), on("v", "e")) if by else counts.alias("v").crossJoin(ends.alias("e"))
    binned = both.select(*(F.col(f"v.{k}").alias(k) for k in by), "value", "c", "at", F.coalesce(width(F.col("value").cast("double")), F.lit(0)).alias("bin"))
    order = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = binned.groupBy(*by, "bin", "at").agg(F.sum("c").alias("k")).withColumn("upto", F.sum("k").over(order))
    hit = bins.where((F.col("upto") > F.col("at")) & (F.col("upto") - F.col("k") <= F.col("at"))).select(*by, "bin", (F.col("upto") - F.col("k")).alias("before"))
    inside = binned.alias("v").join(hit.alias("h"), [*on("v", "h"), F.col("v.bin") == F.col("h.bin")]).select(*(F.col(f"v.{k}").alias(k) for k in by), "value", "c", "at", "before")
    order = Window.partitionBy(*by).orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = inside.withColumn("upto", F.col("before") + F.sum("c").over(order))
    return ranked.where((F.col("upto") > F.col("at")) & (F.col("upto") - F.col("c") <= F.col("at"))).select(*by, "value")


def percentile(values: list[float], q: float) -> float:
    """The same for a few numbers; 0 for none."""
    if not values:
        return 0.0
    return sorted(values)[math.floor((len(values) - 1) * q + 0.5)]


def wilson_lower(wins: Column, n: Column, z: float = 1.959964) -> Column:
    """Lower end of Wilson's interval of a rate; null without trials."""
    n = F.nullif(n.cast("double"), F.lit(0.0))
    p = wins / n
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


MOST_DIMS, NEAR, LEAST_JUDGED, LEAST_WINS, ALL_TIES = 768, 0.03, 40, 0.60, 0.9
PREFERRED_MODEL, PREFERRED_DIMS = "nomic-embed-text", 512


@dataclass(frozen=True)
class Config:
    model: str
    dims: int
    ndcg: float
    win_rate: float
    decided: int
    judged: int


def recommend(configs: list[Config]) -> dict:
    """Go or no-go, the chosen configuration and whether its size is settled."""
    if not configs:
        return {"go": False, "locked": False, "model": None, "dims": None, "text": "no-go: no configurations"}
    fit = [c for c in configs if c.dims <= MOST_DIMS]
    if not fit:
        return {"go": False, "locked": False, "model": None, "dims": None, "text": f"no-go: no configuration with at most {MOST_DIMS} dims"}
    best = fit[0]
    for c in fit[1:]:
        gap = c.ndcg - best.ndcg
        if gap > 1e-9 or (abs(gap) <= 1e-9 and (c.win_rate - best.win_rate > 1e-9 or (abs(c.win_rate - best.win_rate) <= 1e-9 and c.dims < best.dims))):
            best = c
    top = best.ndcg
    best = next((c for c in fit if c.model == best.model and c.dims == PREFERRED_DIMS and top - c.ndcg <= NEAR), best)
    family = [c.ndcg for c in fit if c.model == best.model]
    spread = max(family) - min(family)
    preferred = len(family) >= 2 and best.model == PREFERRED_MODEL and best.dims == PREFERRED_DIMS and top - best.ndcg <= NEAR
    settled = best.judged >= LEAST_JUDGED and (spread >= NEAR or preferred)
    go = best.judged > 0 and (best.ndcg >= ALL_TIES if best.decided == 0 else best.win_rate >= LEAST_WINS)
    text = f"{'go' if go else 'no-go'}: {best.model} at {best.dims} dims" + ("" if go and settled else "; dims not locked")
    return {"go": go, "locked": go and settled, "model": best.model, "dims": best.dims, "text": text}


def spread(configs: DataFrame) -> DataFrame:
    """Largest minus smallest nDCG over the sizes of a model."""
    return configs.groupBy("model").agg(F.round(F.max("ndcg") - F.min("ndcg"), 6).alias("spread"), F.count("*").alias("sizes"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """(path, a, b) where two flattened (path, value) reports differ, either side missing included."""
    both = a.select("path", F.col("value").alias("a")).join(b.select("path", F.col("value").alias("b")), "path", "full")
    return both.where(~F.col("a").eqNullSafe(F.col("b")))


def provenance_problems(a: dict, b: dict, fields: list[str]) -> list[str]:
    """Fields that are missing, blank or unknown on a side, or differ."""
    out = []
    for f in fields:
        x, y = a.get(f), b.get(f)
        if any(v in (None, "", "unknown") for v in (x, y)):
            out.append(f"{f}: missing")
        elif x != y:
            out.append(f"{f}: {x} != {y}")
    return out
