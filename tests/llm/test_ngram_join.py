import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docspark.llm import ngram_join as J

from .common import awkward, edited, frame, prose, words


def sets_of(rows):
    out = []
    for _, t, *_ in rows:
        w = words(t)
        out.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def brute(rows, percent=80):
    """(doc_id, set size, smallest id reachable) of each row."""
    sets = sets_of(rows)
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    where = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            where[g].append(i)
    common = collections.Counter((a, b) for v in where.values() for k, b in enumerate(v) for a in v[:k])
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            parent[find(a)] = find(b)
    least = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, *_) in enumerate(rows)]


def key(r):
    return tuple((x is None, x or 0) for x in r)


def check(spark, rows, percent=80):
    got = J.near_duplicates(frame(spark, rows), percent=percent).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows, percent), key=key)


def test_awkward_rows(spark):
    check(spark, awkward())


def near_copies(seed, n, edits):
    rng = random.Random(seed)
    bases = [prose(rng, k, 5000) for k in (60, 140, 200)]
    rows = [(k, edited(rng, rng.choice(bases), rng.randrange(edits)), "en", "a") for k in range(n)]
    passage = prose(rng, 45, 5000)
    return rows + [(n + k, prose(rng, rng.randrange(6), 5000) + " " + passage + " " + prose(rng, rng.randrange(6), 5000), "en", "b") for k in range(60)]


def test_large_groups_around_the_threshold(spark):
    check(spark, near_copies(2, 240, 7))


def test_hub_rounds_lose_no_link(spark, monkeypatch):
    rows = near_copies(4, 200, 9)
    monkeypatch.setattr(J, "HUB_ROUNDS", 1)
    check(spark, rows)
    check(spark, rows, percent=60)


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(1)
    for n in (3, 100, 3000):
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        y = np.unique(np.concatenate((x[n // 5 :], rng.integers(0, 1 << 63, n // 3, dtype=np.uint64))))
        apart = np.bitwise_count((J.parity_bitmap(x) ^ J.parity_bitmap(y)).view(np.uint64)).sum()
        assert apart <= len(np.setxor1d(x, y))


def test_empty_table(spark):
    assert J.near_duplicates(frame(spark, [])).count() == 0


def test_keep_one(spark):
    rows = awkward()
    docs = frame(spark, rows)
    out = J.keep_one(docs)
    assert out.columns == docs.columns
    kept = out.collect()
    want = collections.Counter()
    for (i, n, c), (d, t, *_) in zip(brute(rows), rows, strict=True):
        if n == 0:
            want[d, t] += 1
        elif i is not None and i == c:
            want[d, t] = 1
        elif c is None:
            want[d, t] = 1
    assert collections.Counter((r.doc_id, r.text) for r in kept) == want


@pytest.mark.parametrize("n", [1, 2, 4, 5, 6, 9])
def test_short_texts(spark, n):
    text = " ".join("abcdefghi"[:n])
    check(spark, [(1, text, "en", "a"), (2, text.upper(), "en", "a"), (3, text + " j", "en", "a")])


def test_result_has_one_row_a_document(spark):
    out = J.near_duplicates(frame(spark, awkward()))
    assert out.count() == out.select("uid").distinct().count() == len(awkward())
    assert out.where(F.col("n_shingles") == 0).where(~F.col("component_id").eqNullSafe(F.col("doc_id"))).count() == 0


def test_keep_one_keeps_unlinked_texts_of_null_and_equal_ids(spark):
    rng = random.Random(8)
    texts = [prose(rng, 60, 9000) for _ in range(6)]
    rows = [(None, t, "en", "a") for t in texts[:4]] + [(None, texts[0], "en", "a")] + [(7, t, "en", "a") for t in texts[4:]]
    got = J.keep_one(frame(spark, rows)).collect()
    assert collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter([(None, t) for t in texts[:4]] + [(7, t) for t in texts[4:]])


def test_orders_prune_pairs_before_sets_travel_and_lose_no_link(spark):
    """Pairs of sets of 100 that share all but d members of each: links (d up to 11) all pass, most of those far below the threshold don't."""
    rng = np.random.default_rng(6)
    rows, pairs = [], []
    for k in range(300):
        d = k % 100
        x = np.unique(rng.integers(1, 1 << 63, 100, dtype=np.uint64))
        y = np.concatenate((x[d:], np.unique(rng.integers(1, 1 << 63, d, dtype=np.uint64))))
        for uid, z in ((2 * k, x), (2 * k + 1, y)):
            known = np.ones(len(z), bool)
            rows.append((uid, *(J.hash_prefix(z, known, s, 21).tolist() for s in J.ORDERS)))
        pairs.append((2 * k, 2 * k + 1, d))
    sets = spark.createDataFrame(rows, "uid long, second array<int>, third array<int>")
    left = {r.a for r in J.shared_under_all_orders(spark.createDataFrame([p[:2] for p in pairs], "a long, b long"), sets).collect()}
    assert all(a in left for a, _, d in pairs if d <= 11)
    far = [a for a, _, d in pairs if d >= 90]
    assert sum(a in left for a in far) < len(far)
