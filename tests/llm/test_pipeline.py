import collections
import os

import pytest

import corpus_pipeline as P
from docspark.llm import decontamination, mixing
from docspark.llm.queries import QUERIES

from .common import awkward, frame, prose
from .test_ngram_join import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus with planted cases, as the driver's tables."""
    import random

    rng = random.Random(4)
    d = str(tmp_path_factory.mktemp("tables"))
    items = [(k, prose(rng, 20, 9000)) for k in range(5)]
    rows = awkward() + [(500 + k, prose(rng, 40, 9000) + (" grolm" * 2 if k % 4 == 0 else ""), "en", f"s{k % 3}") for k in range(200)]
    rows += [(900 + k, prose(rng, 20, 9000) + " " + items[k][1], "en", "a") for k in range(5)]
    frame(spark, rows).select(*P.COLUMNS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(500 + k, 1, int(k % 4 == 0)) for k in range(0, 200)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, rows, items


def test_stages_against_brute_force(spark, folder):
    d, rows, items = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = P.drop_toxic(spark, docs, d)
    assert out.columns == P.COLUMNS
    left = collections.Counter(r.doc_id for r in out.collect())
    assert left == collections.Counter(i for i, t, *_ in rows if "grolm" not in (t or ""))
    one = P.keep_one_of_near_duplicates(spark, out, d)
    rest = [(r.doc_id, r.text, r.lang, r.source) for r in out.collect()]
    want = {(i, n == 0) for i, n, c in brute(rest) if n == 0 or i == c}
    assert {r.doc_id for r in one.collect()} >= {i for i, _ in want}
    assert len({r.doc_id for r in one.collect()} - {i for i, _ in want}) <= 1
    clean = P.drop_contaminated(spark, one, d)
    bad = {i for (i, *_), w in zip(rest, decontamination.text_words([r[1] for r in rest]), strict=True) if len(w) < 5000 for v in decontamination.text_words([t for _, t in items]) if decontamination.align(v, w)[0] <= len(v) // 5}
    assert bad == {900, 901, 902, 903, 904}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in one.collect()} - bad
    mixed = P.mix_sources(spark, clean, d)
    assert mixed.columns == P.COLUMNS
    assert collections.Counter(r.doc_id for r in mixed.collect()) == collections.Counter(r.doc_id for r in mixing.replicate(clean).collect())
    shards = P.write_shards(spark, mixed, d).collect()
    assert collections.Counter(r.doc_id for r in shards) == collections.Counter(r.doc_id for r in mixed.collect())


def test_run_equals_its_stages(spark, folder):
    d, *_ = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, f in P.STAGES:
        docs = f(spark, docs, d)
    assert collections.Counter(map(tuple, docs.collect())) == collections.Counter(map(tuple, P.run(spark, d).collect()))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_every_query_runs(spark):
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 11))
    for name, f in QUERIES.items():
        n = f(spark, SF).count()
        assert n or name.startswith("op3"), name
