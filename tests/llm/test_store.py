from itertools import islice

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docspark.llm import kernels as K
from docspark.llm import store
from docspark.llm.store import Census, _counts

from . import test_lm_scoring, test_ngram_join, test_suffix_dedup
from .common import awkward, frame

words64 = st.lists(st.integers(0, (1 << 64) - 1), max_size=30)


@settings(max_examples=100, deadline=None)
@given(words64)
def test_sorted_words_round_trip(x):
    h = np.array(sorted(x), np.uint64)
    assert (K.unpack_sorted(K.pack_sorted(h)) == h).all()
    cut = K.cut_by_part(h, 7)
    assert cut[0] == 0 and cut[-1] == len(h)
    for p in range(7):
        assert all(int(v) * 7 >> 64 == p for v in h[cut[p] : cut[p + 1]])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(250, 1 << 40)), max_size=30))
def test_counts_round_trip(x):
    b = K.pack_counts(np.array(x, np.int64))
    assert K.unpack_counts(b, len(x)).tolist() == x == _counts(b).tolist()


class Sums(Census):
    pairs = True
    first_only = {7: 1}

    def answer(self, section, keys, seconds, sums):
        return [np.where(sums[0] > 1, 7, 0)]


def test_one_sender_of_a_key_gets_the_special_answer():
    s = Sums()
    one = lambda keys, seconds: s.encode([(np.array(keys, np.uint64), np.array(seconds, np.uint64), [np.ones(len(keys), np.int64)])])
    u = s.unite([one([5, 5, 9], [1, 1, 4]), one([5, 9], [1, 3]), one([], [])])
    out = s.scattered([s.answer(0, *u[0][:3])], [u[0][3]], [u[0][4]])
    assert [s.read(b, [n])[0][0].tolist() for b, n in zip(out, (3, 2, 0), strict=True)] == [[7, 1, 0], [1, 0], []]


@pytest.fixture
def two_levels(monkeypatch):
    """Small blocks, groups of two, and the second level of the exchange for any number of packets."""
    monkeypatch.setattr(store, "MOST_PACKETS", 0)
    monkeypatch.setattr(store, "GROUP_BLOCKS", 2)
    monkeypatch.setattr(store, "BLOCK_BYTES", 3000)


def test_two_levels_answer_like_one(spark, two_levels):
    b = store.pack(frame(spark, awkward()), "doc_id", "text")
    assert b.fine > 1 and b.groups > 1 and b.df.count() > 4
    test_lm_scoring.test_scores_equal_brute_force(spark)
    test_suffix_dedup.test_awkward_rows(spark)
    test_suffix_dedup.many_edges(spark)
    test_ngram_join.test_awkward_rows(spark)
    test_ngram_join.test_large_groups_around_the_threshold(spark)


def test_empty_table_at_two_levels(spark, two_levels):
    test_lm_scoring.test_empty_table(spark)
    test_suffix_dedup.test_empty_table(spark)
    test_ngram_join.test_empty_table(spark)


def test_blocks_hold_every_row_once(spark, two_levels):
    b = store.pack(frame(spark, awkward()), "doc_id", "text")
    rows = b.df.select("block", "n", "ids", "size").collect()
    assert len({r.block for r in rows}) == len(rows)
    assert sum(r.n for r in rows) == b.n_docs == len(awkward())
    assert sorted((i is None, i or 0) for r in rows for i in r.ids) == sorted((i is None, i or 0) for i, *_ in awkward())
    assert all(r.size <= 3000 or r.n == 1 for r in rows)


def test_ids_fall_into_few_of_sparks_buckets(spark):
    for task in (0, 5, 1 << 19, store.MOST_TASKS - 1):
        ids = list(islice(store.block_ids(task, 51), 40))
        found = spark.createDataFrame([(i,) for i in ids], "id long").selectExpr("pmod(hash(id), 51) b").collect()
        assert [r.b for r in found] == store.bucket_of(np.array(ids), 51).tolist()
        assert len({r.b for r in found}) == store.TASK_BUCKETS and len(set(ids)) == 40
        assert max(ids) * store.BLOCK_ROWS + store.BLOCK_ROWS < 1 << 63
    with pytest.raises(ValueError):
        next(store.block_ids(store.MOST_TASKS, 51))


def test_ids_go_on_when_their_buckets_are_used_up(monkeypatch):
    monkeypatch.setattr(store, "TASK_BLOCKS", 1 << 16)
    ids = list(islice(store.block_ids(3, 1 << 14), 1 << 16))
    assert len(set(ids)) == 1 << 16 and min(ids) == 3 << 16 and max(ids) == (4 << 16) - 1


def test_a_cluster_without_a_shared_folder_raises(spark):
    class Context:
        master = "spark://host:7077"
        getConf = lambda self: {}

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(ValueError, match="checkpoint"):
        store.workdir(Session())


def test_a_tasks_blocks_make_few_files(spark, two_levels):
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        b = store.pack(frame(spark, [(i, "word " * 300, "en", "a") for i in range(400)]).coalesce(2), "doc_id", "text")
        assert b.df.count() > 100 and len(b.df.inputFiles()) <= 2 * store.TASK_BUCKETS
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_sizes_and_scale():
    assert [store._bytes(x) for x in ("67108864b", "64mb", "1g", "5")] == [1 << 26, 1 << 26, 1 << 30, 5]

    class Session:
        class sparkContext:  # noqa: N801
            getConf = staticmethod(lambda: {"spark.executor.memory": Session.memory, "spark.executor.cores": "4"})

    for Session.memory, want in (("1800m", 1), ("16g", 4), ("2000g", 16), ("20480", 5)):
        assert store.task_scale(Session) == want
