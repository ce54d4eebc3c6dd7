import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docspark.llm import decontamination as D

from .common import awkward, edited, frame, prose


def test_words():
    assert [len(x) for x in D.text_words(["Hello, (world) --- a!!", None, "...", "x y ---"])] == [3, 0, 0, 2]
    a, b = D.text_words(["Hello, WORLD", "(hello) world!"])
    assert (a == b).all()


def edit_distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        d2 = [i]
        for j, y in enumerate(b, 1):
            d2.append(min(d[j - 1] + (x != y), d[j] + 1, d2[-1] + 1))
        d = d2
    return d[-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(2, 5), min_size=1, max_size=7), st.lists(st.integers(2, 5), max_size=9))
def test_align_is_the_nearest_run(item, text):
    d, a, b = D.align(np.array(item, np.uint64), np.array(text, np.uint64))
    assert d == min(edit_distance(item, text[i:j]) for i in range(len(text) + 1) for j in range(i, len(text) + 1))
    assert edit_distance(item, text[a:b]) == d


def planted(seed=3):
    rng = random.Random(seed)
    items = [(k, prose(rng, 15 + 3 * k, 3000)) for k in range(14)] + [(90, None), (91, ""), (92, "two words"), (None, prose(rng, 20, 3000)), (5, prose(rng, 25, 3000))]
    rows = awkward()
    for k in range(60):
        i, t = items[k % 14]
        e = k % 5 if k % 5 <= len(t.split()) // 5 else 0
        rows.append((1000 + k, f"{prose(rng, 40, 3000)} {edited(rng, t, e).upper()}! {prose(rng, 30, 3000)}", "en", "a"))
    return items, rows


def test_against_alignment_of_every_item(spark):
    items, rows = planted()
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = D.find_leaks(frame(spark, rows), bench)
    assert out.columns == [c for c in frame(spark, rows).columns if c != "leaks"] + ["leaks"]
    got = {(r.doc_id, (r.text or "")[:50], x.item_id): x.edits for r in out.collect() for x in r.leaks}
    want = {}
    for (i, t, *_), w in zip(rows, D.text_words([r[1] for r in rows]), strict=True):
        for (j, _), v in zip(items, D.text_words([x[1] for x in items]), strict=True):
            if len(v) >= D.LEAST_WORDS and len(w) <= 5000:
                d = D.align(v, w)[0]
                if d <= len(v) // 5:
                    want[i, (t or "")[:50], j] = d
    assert len(want) >= 60
    found = sum(got.get(k) == d for k, d in want.items())
    assert found >= 0.97 * len(want)
    assert set(got) <= set(want)


def index_of(items, **options):
    return D.Index([(i, w) for (i, _), w in zip(items, D.text_words([x[1] for x in items]), strict=True)], **options)


def test_recall_of_random_edits_reaches_the_target_in_each_class():
    index = index_of(planted()[0])
    assert index.recall >= D.TARGET_RECALL and len(index.recalls) == len(index.classes) > 2
    assert all(r >= D.TARGET_RECALL for r in index.recalls) and not any(index.exact)


def test_a_class_short_of_the_target_is_searched_exactly(monkeypatch):
    monkeypatch.setattr(D, "SAMPLED", 6)
    items, rows = planted()
    monkeypatch.setattr(D, "MOST_WALKS", 1)
    index = index_of(items)
    assert any(index.exact) and index.recall >= D.TARGET_RECALL
    words = D.text_words([r[1] for r in rows])
    h, at = np.concatenate(words), np.concatenate(([0], np.cumsum([len(w) for w in words])))
    got = {(d, i): x[0] for d, found in index.search(h, at).items() for i, x in found.items() if index.exact[[i in ids for ids in index.ids].index(True)]}
    want = {}
    for d, w in enumerate(words):
        for i, (_, v) in enumerate(index.items):
            if len(w) <= 5000 and index.exact[[i in ids for ids in index.ids].index(True)] and D.align(v, w)[0] <= index.limit(len(v)):
                want[d, i] = D.align(v, w)[0]
    assert got == want and want


def test_long_items_keep_sampled_steps_only():
    rng = random.Random(2)
    items = [(k, prose(rng, 5000, 10**6)) for k in range(20)] + [(99, prose(rng, 6, 10**6))]
    index = index_of(items)
    assert all(len(kept) <= D.TABLES * D.SAMPLED for walks in index.walks for _, kept, _ in walks)
    h, at = D.bare_words(np.frombuffer((items[3][1] + " tail").encode(), np.uint8), np.array([0, len(items[3][1]) + 5]))
    assert index.search(h, at) == {0: {3: (0, 0, 5000)}}


def test_too_many_edits_are_refused():
    with pytest.raises(ValueError, match="word pair"):
        index_of([(1, "a b c d e")], percent=40)
    index_of([(1, "a b c d e")], percent=20)


def test_slices_and_empty_tables(spark):
    items, rows = planted()
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, rows[-20:])
    key = lambda df: sorted((r.doc_id, x.item_id, x.edits) for r in df.collect() for x in r.leaks if x.item_id is not None)
    assert key(D.find_leaks(docs, bench, slice_bytes=600)) == key(D.find_leaks(docs, bench))
    assert all(r.leaks == [] for r in D.find_leaks(docs, bench.limit(0)).collect())
    assert D.find_leaks(frame(spark, []), bench).count() == 0
