import collections
import random
from concurrent.futures import ThreadPoolExecutor

import pytest

from docspark.llm import sharding as S
from docspark.llm.store import workdir

from .common import awkward, frame, prose


def same_rows(a, b):
    return collections.Counter(map(tuple, a)) == collections.Counter(map(tuple, b))


def test_rows_survive_appends_and_compactions(spark):
    docs = frame(spark, awkward())
    store = S.Store(spark, workdir(spark), target_bytes=200_000)
    for k in range(4):
        store.append(docs.repartition(5))
        before = store.manifest()
        after = store.compact()
        assert after["version"] > before["version"]
        assert len(store.shards(after)) < len(store.shards(before))
        out = store.read().drop("shard").collect()
        assert same_rows(out, [r for _ in range(k + 1) for r in docs.drop("shard").collect()])
        assert sum(s["rows"] for s in store.shards(after)) == len(awkward()) * (k + 1)
    assert same_rows(store.read(1).drop("shard").collect(), docs.drop("shard").collect())
    assert store.vacuum() == 0 and len(store.versions()) == after["version"]
    store.vacuum(older_s=0)
    assert store.versions() == [after["version"]]
    assert store.read().count() == 4 * len(awkward())


def test_a_store_below_a_folder_named_data(spark):
    out = S.shard(frame(spark, awkward()).repartition(6), root=f"{workdir(spark)}/data/data/store")
    assert out.count() == len(awkward())
    assert out.where("shard is null").count() == 0


def sizes_after(store, sizes):
    """Sizes after the planned merges."""
    shards = [{"path": f"p{k:05}", "bytes": b, "rows": 1} for k, b in enumerate(sizes)]
    groups = store.plan(shards)
    merged = [s for g in groups for s in g]
    assert len({s["path"] for s in merged}) == len(merged)
    assert all(s["bytes"] < store.target / 2 for s in merged)
    assert all(sum(s["bytes"] for s in g) <= store.target and len(g) > 1 for g in groups)
    return sorted([sum(s["bytes"] for s in g) for g in groups] + [s["bytes"] for s in shards if s not in merged])


def test_similar_sizes_merge_when_a_tier_is_full(spark):
    store = S.Store(spark, workdir(spark), target_bytes=1000)
    assert sizes_after(store, [10, 10, 10]) == [10, 10, 10]
    assert sizes_after(store, [10, 10, 10, 10]) == [40]
    assert sizes_after(store, [10, 10, 10, 300, 2, 2]) == [2, 2, 10, 10, 10, 300]
    assert sizes_after(store, [400, 499, 500, 700, 1500]) == [400, 499, 500, 700, 1500]


def test_merges_cascade_up_the_tiers(spark):
    store = S.Store(spark, workdir(spark), target_bytes=1000)
    assert sizes_after(store, [10] * 3 + [40, 40, 40] + [10]) == [160]
    out = sizes_after(store, [10] * 150 + [120] * 9 + [400, 499, 500, 700, 1500])
    assert sum(out) == 1500 + 1080 + 3599 and max(x for x in out if x < 1500) <= 1000
    for n in (1, 5, 30, 1000, 5000):
        out = sizes_after(store, [7] * n)
        assert sum(out) == 7 * n
        assert sum(x < 500 for x in out) < 8 * S.FANOUT


def test_every_row_is_written_a_few_times_over_many_appends(spark):
    """A shard of 1 appended at a time: merges write each byte once a tier at most."""
    store = S.Store(spark, workdir(spark), target_bytes=4**5)
    live, written = [], 0
    for k in range(3000):
        live.append({"path": f"a{k:05}", "bytes": 1, "rows": 1})
        for n, g in enumerate(store.plan(live)):
            live = [s for s in live if s not in g] + [{"path": f"c{k:05}-{n}", "bytes": sum(s["bytes"] for s in g), "rows": 1}]
            written += live[-1]["bytes"]
    assert written <= 6 * 3000 and len(live) <= 3000 / 512 + 5 * S.FANOUT


def test_a_second_writer_loses(spark):
    store = S.Store(spark, workdir(spark))
    first = store.append(frame(spark, awkward()))
    with pytest.raises(RuntimeError):
        store.commit(0, None, [], 0, "late")
    assert store.manifest() == first


def test_of_concurrent_writers_one_gets_a_version(spark):
    store = S.Store(spark, workdir(spark))
    for parent in range(10):
        with ThreadPoolExecutor(6) as pool:
            def one(k):
                try:
                    return store.commit(parent, None, [], k, str(k))
                except RuntimeError:
                    return None

            won = [x for x in pool.map(one, range(6)) if x]
        assert len(won) == 1 and store.manifest() == won[0]


def test_concurrent_appends_are_all_kept(spark):
    store = S.Store(spark, workdir(spark))
    docs = [frame(spark, [(k, f"text {k}", "en", "a")]) for k in range(5)]
    with ThreadPoolExecutor(5) as pool:
        list(pool.map(store.append, docs))
    assert sorted(r.doc_id for r in store.read().collect()) == list(range(5))
    assert len({r.shard for r in store.read().collect()}) == 5


def test_compaction_keeps_what_was_appended_meanwhile(spark, monkeypatch):
    store = S.Store(spark, workdir(spark))
    store.append(frame(spark, awkward()).repartition(6))
    plain = store._written

    def late(folder, schema):
        monkeypatch.setattr(store, "_written", plain)
        store.append(frame(spark, [(12345, "late", "en", "a")]))
        return plain(folder, schema)

    monkeypatch.setattr(store, "_written", late)
    store.compact()
    assert store.read().count() == len(awkward()) + 1


def test_extra_columns_with_names_used_inside(spark):
    docs = spark.createDataFrame([(1, "a", "m", "s", "p", "f", "r", "q")], "doc_id long, text string, _metadata string, __shard string, __path string, file string, `row.x` string, path string").repartition(1)
    store = S.Store(spark, workdir(spark))
    for _ in range(4):
        store.append(docs)
    store.compact()
    out = store.read()
    assert len(store.shards(store.manifest())) == 1
    assert out.columns == [*docs.columns, "shard"] and [tuple(r)[:-1] for r in out.collect()] == [tuple(docs.first())] * 4


def test_full_shards_are_not_read_again(spark, monkeypatch):
    store = S.Store(spark, workdir(spark), target_bytes=3000)
    rng = random.Random(1)
    monkeypatch.setattr(S, "LIST_SHARDS", 2)
    store.append(frame(spark, [(k, prose(rng, 900, 10**6), "en", "a") for k in range(8)]).repartition(4))
    m = store.append(frame(spark, [(99, "x", "en", "a")]).repartition(1))
    full = [x for x in m["lists"] if not x["small"]]
    assert len(full) >= 2 and all(x["shards"] <= 2 for x in full)
    assert [x for x in store.append(frame(spark, [(100, "y", "en", "a")]))["lists"] if not x["small"]][: len(full)] == full


def test_other_schema_is_refused_and_unreferenced_data_is_removed(spark):
    store = S.Store(spark, workdir(spark))
    store.append(frame(spark, awkward()))
    with pytest.raises(ValueError):
        store.append(spark.range(3))
    frame(spark, awkward()).write.parquet(f"{store.root}/data/left-by-a-lost-job")
    assert store.vacuum() == 0  # it may be a running writer's
    assert store.vacuum(older_s=0) == 1
    assert store.read().count() == len(awkward())


def test_empty_table(spark):
    out = S.shard(frame(spark, []))
    assert out.count() == 0 and "shard" in out.columns


def test_target_sized_files(spark):
    rng = random.Random(1)
    docs = frame(spark, [(k, prose(rng, 400, 10**6), "en", "a") for k in range(300)]).repartition(24)
    store = S.Store(spark, workdir(spark), target_bytes=150_000)
    store.append(docs)
    sizes = [s["bytes"] for s in store.shards(store.compact())]
    assert all(s <= 1.3 * 150_000 for s in sizes)
    assert sum(s >= 75_000 for s in sizes) >= len(sizes) - S.FANOUT
