import numpy as np
import pytest

from docspark.llm import nn_descent as N

SCHEMA = "vec_id long, embedding array<float>, label int, uid string, dst string, sha string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "y", "z") for i, v in rows], SCHEMA)


def brute(rows, threshold):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) if o else None for (_, v), o in zip(rows, ok, strict=True)]
    n = len(rows)
    link = [[j for j in range(n) if j != i and ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and (unit[i] @ unit[j] >= threshold or rows[i][1] == rows[j][1])] for i in range(n)]
    out, seen = {}, set()
    for i in range(n):
        if i not in seen:
            group, todo = {i}, [i]
            while todo:
                for j in link[todo.pop()]:
                    if j not in group:
                        group.add(j)
                        todo.append(j)
            seen |= group
            ids = [rows[j][0] for j in group if rows[j][0] is not None]
            out |= {j: min(ids) if ids else None for j in group}
    return [(rows[i][0], len(link[i]), out[i] if out[i] is not None else rows[i][0]) for i in range(n)]


def key(r):
    return tuple((x is None, x or 0) for x in r)


def clustered(seed, groups, size, noise, dims=16):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(groups):
        c = rng.normal(size=dims)
        out += [(c + rng.normal(size=dims) * noise).astype(np.float32).tolist() for _ in range(size)]
    out += rng.normal(size=(150, dims)).astype(np.float32).tolist()
    return [(k * 3 + 1, v) for k, v in enumerate(out)]


@pytest.mark.parametrize(("groups", "size", "noise"), [(30, 2, 0.1), (12, 6, 0.12), (2, 90, 0.15)])
def test_equals_brute_force(spark, groups, size, noise):
    rows = clustered(3, groups, size, noise)
    got = N.near_duplicates(frame(spark, rows)).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=key) == sorted(brute(rows, N.THRESHOLD), key=key)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert got[0].audited_recall >= N.RECALL


def test_awkward_vectors(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(5, v), (5, v), (2, v), (None, v), (None, [0.0, 1.0, 0.0]), (7, None), (8, []), (9, [0.0, 0.0, 0.0]), (10, [1.0, None, 2.0]), (11, [1.0, float("nan"), 2.0]), (12, [1.0, float("inf"), 0.0]), (13, [1.0, 2.0]), (14, [2.0, 4.0]), (15, [-1.0, -2.0, -3.0]), (16, [10.0, 20.0, 30.0])]
    got = N.near_duplicates(frame(spark, rows)).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=key) == sorted(brute(rows, N.THRESHOLD), key=key)


def test_empty_table_and_all_equal(spark):
    assert N.near_duplicates(frame(spark, [])).count() == 0
    got = N.near_duplicates(frame(spark, [(k, [1.0, 0.5]) for k in range(40)])).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(39, 0)}


def equals_brute(got, rows):
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=key) == sorted(brute(rows, N.THRESHOLD), key=key)


def twins(size, dims=16):
    """Two dense groups of `size` vectors at cosine 0.97 of one another."""
    rng = np.random.default_rng(5)
    a, b = np.eye(dims)[0], 0.97 * np.eye(dims)[0] + np.sqrt(1 - 0.97**2) * np.eye(dims)[1]
    out = [(c + rng.normal(size=dims) * 0.002).astype(np.float32).tolist() for c in (a, b) for _ in range(size)]
    return list(enumerate(out))


def test_links_between_saturated_groups(spark):
    rows = twins(20)
    assert {n for _, n, _ in brute(rows, N.THRESHOLD)} == {39}
    equals_brute(N.near_duplicates(frame(spark, rows)).collect(), rows)


def test_saturated_groups_that_never_met(spark, monkeypatch):
    rows, buckets = twins(20), N.bucket_graph
    monkeypatch.setattr(N, "bucket_graph", lambda nodes, *a: buckets(nodes.where("least < 20"), *a).union(buckets(nodes.where("least >= 20"), *a)))
    equals_brute(N.near_duplicates(frame(spark, rows)).collect(), rows)


def test_missed_pairs_beside_a_hot_group_are_audited(spark, monkeypatch):
    rng = np.random.default_rng(6)
    pairs = [v for v in rng.normal(size=(30, 16)) for _ in range(2)]
    vectors = [np.eye(16)[0] + rng.normal(size=16) * 0.02 for _ in range(60)] + [v + rng.normal(size=16) * 0.05 for v in pairs]
    rows = [(k, v.astype(np.float32).tolist()) for k, v in enumerate(vectors)]
    buckets, descent = N.bucket_graph, N.descend
    monkeypatch.setattr(N, "bucket_graph", lambda nodes, *a: buckets(nodes.where("least < 60"), *a))
    monkeypatch.setattr(N, "descend", lambda graph, nodes, *a: descent(graph, nodes.where("least < 60"), *a))
    equals_brute(N.near_duplicates(frame(spark, rows)).collect(), rows)


def test_tables_grow_with_the_table(spark):
    met = (1 - np.arccos(N.THRESHOLD) / np.pi) ** N.code_bits(10**6)
    assert 1 - (1 - met) ** N.tables_needed(10**6, N.THRESHOLD, N.RECALL) >= N.RECALL


def test_counts_by_tiles_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 5)).astype("<f4")
    x[:60] = x[0] + 0.25 * x[:60]
    comp = [0] * 60 + [1] * 25 + [2] * 5
    mult = rng.integers(1, 4, 90).tolist()
    members = spark.createDataFrame([(c, k, bytearray(v.tobytes()), m) for k, (c, v, m) in enumerate(zip(comp, x, mult, strict=True))], "comp long, uid long, v binary, mult long")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = (u @ u.T >= 0.9) & (np.array(comp)[:, None] == np.array(comp)) & ~np.eye(90, dtype=bool)
    for tile in (1000, 20, 7):
        got = {r.uid: r.n for r in N._exact_counts(members, "<f4", 0.9, tile).collect()}
        assert [got[k] for k in range(90)] == (near @ np.array(mult)).tolist()


def test_a_member_is_sent_to_few_tiles():
    assert N.tile_rows(64 * 8) == N.TILE and N.tile_rows(1024 * 8) == 512 and N.tile_rows(1 << 20) == 256


def test_recall_is_unknown_where_nothing_links(spark):
    rng = np.random.default_rng(4)
    rows = [(k, [float(v) for v in rng.normal(size=32)]) for k in range(60)]
    out = N.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {(r.n_links, r.kept, r.audited_recall) for r in out} == {(0, True, None)}


def test_descent_goes_on_until_lists_rest(spark):
    """From a poor first graph, on a line of points, descent alone finds nearly all nearest neighbours."""
    rng, k = np.random.default_rng(5), 8
    angle = np.sort(rng.uniform(0, 3, 400))
    x = np.stack([np.cos(angle), np.sin(angle)], 1).astype("<f4")
    nodes = spark.createDataFrame([(i, bytearray(v.tobytes()), 2) for i, v in enumerate(x)], "uid long, v binary, dim int")
    first = [(i, int(j)) for i in range(400) for j in rng.choice(400, k, replace=False) if i != j]
    graph, turns = spark.createDataFrame([(i, j, float(x[i] @ x[j]), True) for i, j in first], "src long, dst long, sim double, new boolean"), 0
    while graph.where("new").count() > N.STOP * k * 400:
        found = N.descend(graph, nodes, "<f4", k, 2.0).where("not tree").selectExpr("src", "dst", "sim", "true new")
        graph = N.materialize(N.best(graph.withColumn("new", N.F.lit(False)).union(found), k), f"g{turns}", N.workdir(spark))
        turns += 1
    near = {(r.src, r.dst) for r in graph.collect()}
    truth = {(i, int(j)) for i in range(400) for j in np.argsort(np.abs(angle - angle[i]), kind="stable")[1:3]}
    assert 2 < turns < 25 and len(truth & near) > 0.9 * len(truth)
