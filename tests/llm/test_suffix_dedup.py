import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docspark.llm import suffix_dedup as S

from .common import awkward, frame

LENGTH = 40


def brute(texts, length):
    seen, out = {}, []
    for b in texts:
        for p in range(len(b) - length + 1):
            seen[b[p : p + length]] = seen.get(b[p : p + length], 0) + 1
    for b in texts:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = True
        edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(int), [0]))))
        out.append((edge.tolist(), bytes(np.frombuffer(b, np.uint8)[~gone])))
    return out


def check(spark, rows, length, passage=None):
    got = S.remove_repeats(frame(spark, rows), length=length, passage=passage).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3])
    texts = [(t or "").encode() for _, t, *_ in rows]
    want = [(i, len(b), spans, kept) for (i, *_), b, (spans, kept) in zip(rows, texts, brute(texts, length), strict=True)]
    assert sorted([(r.doc_id, r.n_bytes, list(r.removed), bytes(r.kept)) for r in got], key=key) == sorted(want, key=key)


    if passage:
        shorter = [(i, sum(spans[1::2]) - sum(spans[::2])) for (i, *_), (spans, _) in zip(rows, brute(texts, passage), strict=True)]
        assert sorted(((r.doc_id, r.passage_bytes) for r in got), key=lambda r: (r[0] is None, *map(lambda x: x or 0, r))) == sorted(shorter, key=lambda r: (r[0] is None, *map(lambda x: x or 0, r)))
    else:
        assert all(r.passage_bytes is None for r in got)


def test_awkward_rows(spark):
    rows = [r if len(r[1] or "") < 20_000 else (r[0], r[1][:20_000], *r[2:]) for r in awkward()]
    check(spark, rows, LENGTH, 25)
    check(spark, rows, 400)


@pytest.mark.parametrize("hot", [4096, 3])
def test_shared_passages_with_many_edges(spark, monkeypatch, hot):
    """Groups with more contexts than `hot` are counted string by string; the result is the same."""
    monkeypatch.setattr(S, "HOT_GROUP", hot)
    many_edges(spark)


def many_edges(spark):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefgh ü") for _ in range(n))
    passages = [text(n) for n in (40, 41, 60, 90, 300)]
    rows = []
    for k in range(150):
        p = rng.choice(passages)
        a = rng.randrange(len(p))
        rows.append((k, text(rng.randrange(60)) + p[a // 3 :] + text(rng.randrange(3)) + rng.choice(passages)[: rng.randrange(35, 120)] + text(20), "en", "a"))
    rows += [(200, "ab" * 200, "en", "a"), (201, "a" * 39, "en", "a"), (202, "a" * 39, "en", "a"), (203, "a" * 41, "en", "a")]
    check(spark, rows, LENGTH, 24)


def test_empty_table(spark):
    assert S.remove_repeats(frame(spark, [])).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=6).map(lambda b: bytes(x % 3 for x in b)), max_size=8), max_size=9))
def test_merge_of_front_coded_runs(runs):
    runs = [sorted(r) for r in runs]

    def coded_run(i, r):
        for n, (s, k) in enumerate(S.decoded(*S.front_coded(r))):
            yield s, k, (i, n)

    coded = [coded_run(i, r) for i, r in enumerate(runs)]
    out = list(S.merge_runs(coded))
    assert [s for s, _, _ in out] == sorted(s for r in runs for s in r)
    assert sorted(p for _, _, p in out) == [(i, n) for i, r in enumerate(runs) for n in range(len(r))]
    for (a, _, _), (b, k, _) in zip(out, out[1:], strict=False):
        assert k == S.shared_prefix(a, b)
        assert a[:k] == b[:k] and (len(a) == k or len(b) == k or a[k] != b[k])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.text("ab", min_size=4, max_size=4), st.text("ab", min_size=4, max_size=4)), min_size=2, max_size=6))
def test_match_group(pairs):
    length = 6
    pairs = sorted(((l.encode(), b"cc" + r.encode()) for l, r in pairs), key=lambda x: x[1])
    members = [(l, 0, 4) for l, _ in pairs]
    rights = [0, *(S.shared_prefix(a[1], b[1]) for a, b in zip(pairs, pairs[1:], strict=False))]
    got = S.match_group(members, rights, length)
    for i, (l, r) in enumerate(pairs):
        want = [a for a in range(5) if any(j != i and x[len(x) - a :] + y[: length - a] == l[len(l) - a :] + r[: length - a] for j, (x, y) in enumerate(pairs))]
        assert got[i].tolist() == want


def test_a_passage_in_very_many_surroundings_is_dealt_out(spark, monkeypatch):
    """No task of the merge gets more contexts of one guard than HOT_GROUP, and the strings' owners share the load."""
    monkeypatch.setattr(S, "HOT_GROUP", 100)
    rng = random.Random(11)
    passage = "".join(rng.choice("abcdefghij ") for _ in range(60))
    text = lambda: "".join(rng.choice("abcdefghij ") for _ in range(30))
    docs = frame(spark, [(k, text() + passage + text(), "en", "a") for k in range(20_000)])
    blocks = S.pack(docs, "doc_id", "text", block_bytes=100_000)
    counted = {r.block for r in S.find_repeats(blocks, 40, "x").collect() if r.part == S.COUNTED}
    assert len(counted) == blocks.df.count()
    runs = spark.read.parquet(f"{blocks.where}/runs_x").where("part >= 0").selectExpr("part", "length(data) size").groupBy("part").sum("size").collect()
    assert max(r[1] for r in runs) < 0.05 * blocks.n_bytes
    sent = spark.read.parquet(f"{blocks.where}/strings_x").where("block >= 0").groupBy("part").agg({"data": "count"}).collect()
    assert len(sent) > 20
    got = S.remove_repeats(docs, length=40).selectExpr("count(*) n", "sum(n_bytes - length(kept)) gone", "min(n_bytes - length(kept)) least").first()
    assert got.n == 20_000 and got.least >= 60


def test_a_passage_must_be_shorter(spark):
    with pytest.raises(ValueError):
        S.remove_repeats(frame(spark, []), length=40, passage=40)
