import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docspark.llm import lm_scoring as L

from .common import awkward, frame, words


def exact_weights(cells):
    """EM over (bucket, p0, p1, p2) of every deleted token, one by one, with exact estimates: as the module says, by other means."""
    pooled = [0.1, 0.6, 0.3]

    def step(tokens, w, prior, weight):
        total = [weight * x for x in prior]
        for _, *p in tokens:
            q = [x * y for x, y in zip(p, w, strict=True)]
            for k in range(3):
                total[k] += q[k] / sum(q)
        return [x / sum(total) for x in total]

    for _ in range(60):
        pooled = step(cells, pooled, [1, 1, 1], 1e-3)
    out = {}
    for b in range(L.BUCKETS):
        prior = pooled if b else [pooled[0] / (pooled[0] + pooled[1]), pooled[1] / (pooled[0] + pooled[1]), 0.0]
        mine, w = [c for c in cells if c[0] == b], prior
        for _ in range(60 if mine else 0):
            w = step(mine, w, prior, 10)
        out[b] = w
    return out


def brute(rows):
    texts = [(i, words(t) + ["\0end"]) for i, t, *_ in rows]
    crc = lambda i: zlib.crc32(str(i).encode()) if i is not None else None
    role = [L.SCORED if c is not None and c % 7 == 2 else L.DELETED if c is not None and c // 7 % 8 == 0 else L.ESTIMATE for c in (crc(i) for i, _ in texts)]

    def counts(use):
        uni, bi, ctx = collections.Counter(), collections.Counter(), collections.Counter()
        for (_, t), r in zip(texts, role, strict=True):
            if use(r):
                uni.update(t)
                prev = ["\0begin", *t[:-1]]
                bi.update(zip(prev, t, strict=True))
                ctx.update(prev)
        return uni, bi, ctx

    def estimates(c, t):
        """(bucket, uniform, unigram, bigram) of each token."""
        uni, bi, ctx = c
        n, v = sum(uni.values()), len(uni)
        for h, w in zip(["\0begin", *t[:-1]], t, strict=True):
            yield min(39, math.ceil(math.log2(ctx[h] + 1))), 1 / (v + 1), uni[w] / max(n, 1), bi[h, w] / max(ctx[h], 1)

    est, full = counts(lambda r: r == L.ESTIMATE), counts(lambda r: r != L.SCORED)
    w = exact_weights([x for (_, t), r in zip(texts, role, strict=True) if r == L.DELETED for x in estimates(est, t)])
    n, v = sum(full[0].values()), len(full[0])
    out = []
    for (i, t), r in zip(texts, role, strict=True):
        score = sum(math.log10(w[b][0] * p0 + w[b][1] * p1 + w[b][2] * p2) for b, p0, p1, p2 in estimates(full, t))
        base = sum(math.log10((full[0][x] + 1) / (n + v + 1)) for x in t)
        out.append((i, r == L.SCORED, len(t), sum(full[0][x] > 0 for x in t), n, base, score))
    return out


def run(spark, rows):
    crc = F.crc32(F.col("doc_id").cast("string"))
    df = L.score(frame(spark, rows), F.coalesce(crc % 7 == 2, F.lit(False)), F.coalesce(F.floor(crc / 7) % 8 == 0, F.lit(False)))
    return [tuple(r) for r in df.collect()]


def test_scores_equal_brute_force(spark):
    rows = [r if len(r[1] or "") < 20_000 else (r[0], r[1][:20_000], *r[2:]) for r in awkward()]
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got, want = sorted(run(spark, rows), key=key), sorted(brute(rows), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [r[5] for r in got] == pytest.approx([r[5] for r in want], abs=1e-6)
    assert [r[6] for r in got] == pytest.approx([r[6] for r in want], rel=2e-4)  # weights learned from cells' means


def test_weights_from_cells_are_close_to_exact_ones():
    rng = np.random.default_rng(1)
    v, tokens = 5000, []
    for b in (0, 1, 3, 9):
        for _ in range(3000):
            p1 = float(10 ** rng.uniform(-6, -1)) * (rng.random() < 0.97)
            p2 = float(rng.uniform(0.001, 1)) * (rng.random() < 0.6) * (b > 0)
            tokens.append((b, 1 / v, p1, p2))
    cell = [int((b * L.RATIO_BINS + L._bins(np.array([p1]), p0)[0]) * L.RATIO_BINS + L._bins(np.array([p2]), p0)[0]) for b, p0, p1, p2 in tokens]
    cells, at, n = np.unique(cell, return_inverse=True, return_counts=True)
    means = np.stack([np.bincount(at, [t[k] / t[1] for t in tokens]) / n for k in (2, 3)], 1)
    got, want = L.learn_weights(cells // L.RATIO_BINS**2, n.astype(float), means), exact_weights(tokens)
    for b in (0, 1, 3, 9):
        assert got[b].tolist() == pytest.approx(want[b], abs=0.002)
    assert got[0, 2] == 0 and got[0].sum() == pytest.approx(1)


def test_probabilities_after_any_context_sum_to_one():
    """Over the words and the unseen word, for an unseen and a seen context."""
    w = L.learn_weights(np.zeros(0, int), np.zeros(0), np.zeros((0, 2)))
    uni, n = np.array([5, 3, 2]), 10
    for cc, bigram in ((0, np.zeros(3)), (4, np.array([3, 1, 0]))):
        p0, p1, p2 = L._estimates(np.append(uni, 0), cc, np.append(bigram, 0), n, 3)
        assert (w[L._bucket(np.array([cc]))[0]] @ np.stack([np.full(4, p0), p1, p2])).sum() == pytest.approx(1)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_weights_follow_the_data():
    w = L.learn_weights(np.array([5]), np.array([1000.0]), np.array([[1.0, 1024.0]]))
    assert w[5, 2] > 0.95
    assert np.allclose(w.sum(1), 1)
    assert (L.learn_weights(np.zeros(0, int), np.zeros(0), np.zeros((0, 2)))[1:] > 0).all()
