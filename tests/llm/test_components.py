import os
import random

import pytest

from docspark.llm.components import components
from docspark.llm.store import workdir


def found(spark, edges):
    where = workdir(spark)
    out = components(spark.createDataFrame(edges, "src long, dst long"), where)
    return {r.node: r.comp for r in out.collect()}, os.listdir(where.removeprefix("file://"))


def brute(edges):
    comp = {x: x for e in edges for x in e}
    while True:
        new = dict(comp)
        for a, b in edges:
            new[a] = new[b] = min(new[a], new[b])
        if new == comp:
            return comp
        comp = new


@pytest.mark.parametrize("length", [16, 300])
def test_rounds_of_a_winding_path_are_logarithmic(spark, length):
    """0 - L - (L-1) - ... - 1, on which the smallest label spreads a step a round."""
    edges = [(0, length)] + [(k, k - 1) for k in range(2, length + 1)]
    got, folders = found(spark, edges)
    assert got == dict.fromkeys(range(length + 1), 0)
    steps = [int(x.split("_")[3]) + 1 for x in folders if x.startswith("cc_hooks_")]
    assert len(steps) <= 3 and sum(steps) <= 2 * length.bit_length() + 4


def test_random_graphs(spark):
    rng = random.Random(3)
    for n, m in ((40, 25), (40, 40), (60, 200)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        assert found(spark, edges)[0] == brute(edges)


def test_stars_loops_repeats_and_no_edges(spark):
    edges = [(9, k) for k in range(3, 8)] + [(9, 3), (3, 9), (20, 20), (31, 30)]
    assert found(spark, edges)[0] == {**dict.fromkeys([3, 4, 5, 6, 7, 9], 3), 20: 20, 30: 30, 31: 30}
    assert found(spark, [])[0] == {}
