"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import drop_dir, materialize


def components(edges: DataFrame, where: str) -> DataFrame:
    """(node, comp): comp is the smallest node reachable by edges (src, dst), for every node with an edge.

    A round hooks every node to its smallest neighbour, if that is smaller, finds
    the roots of these hooks by pointer doubling, and contracts the graph to the
    roots. A root that no node joins has, in the next round, only smaller
    neighbours and joins one of them, so two rounds at least halve the nodes of a
    component, and a round's doublings are the logarithm of its longest chain of
    hooks. Edges and nodes shrink from round to round; the maps from node to root
    are chained at the end, the small ones first. A hub is one key of joins whose
    other side has a row a key, so Spark can split it. Everything a round makes is
    written to the shared folder.

    Self loops are nodes without links; an empty edge list gives an empty result.
    """
    spark = edges.sparkSession
    pair = lambda x, y: [F.greatest(x, y).alias("a"), F.least(x, y).alias("b")]
    live = materialize(edges.select(*pair("src", "dst")).distinct(), "cc_live_0", where)
    maps: list[DataFrame] = []
    while True:
        k = len(maps)
        ends = live.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(live.select("b", "b"))
        hooks, step, moved = materialize(ends.groupBy("node").agg(F.min("comp").alias("comp")), f"cc_hooks_{k}_0", where), 0, 1
        while moved:
            step += 1
            further = hooks.select(F.col("node").alias("comp"), F.col("comp").alias("root"))
            new = hooks.join(further, "comp").select("node", F.col("root").alias("comp"), (F.col("root") != F.col("comp")).alias("moved"))
            new = materialize(new, f"cc_hooks_{k}_{step}", where)
            drop_dir(spark, f"{where}/cc_hooks_{k}_{step - 1}")
            moved = new.where("moved").limit(1).count()
            hooks = new.select("node", "comp")
        maps.append(hooks)
        x, y = hooks.toDF("a", "x"), hooks.toDF("b", "y")
        left = live.join(x, "a").join(y, "b").where("x <> y").select(*pair("x", "y")).distinct()
        live = materialize(left, f"cc_live_{k + 1}", where)
        drop_dir(spark, f"{where}/cc_live_{k}")
        if not live.limit(1).count():
            break
    found = maps.pop()
    while maps:
        last = found.toDF("comp", "root")
        found = maps.pop().join(last, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp"))
        found = materialize(found, f"cc_chain_{len(maps)}", where)
    return found
