import json
import os

import pytest
from pyspark.sql import functions as F

from docspark.functions import sql
from docspark.plans.prepare import prepare
from docspark.sources import corpus
from docspark.sources.snapshots import Snapshots


@pytest.fixture
def root(tmp_path):
    d = tmp_path / "vault"
    (d / ".obsidian").mkdir(parents=True)
    (d / "sub").mkdir()
    (d / "a.md").write_text("spring tax documents and deductions " * 100)
    (d / "sub" / "_page.HTML").write_text("<h1>Title</h1><p>body</p>")
    (d / "scan.pdf").write_bytes(b"%PDF-1.4")
    (d / "bad.txt").write_bytes(b"\xff\xfe\xfa")
    (d / "big.txt").write_text("x" * 9000)
    (d / "photo.png").write_bytes(b"png")
    (d / ".obsidian" / "hidden.md").write_text("no")
    os.symlink(d / "a.md", d / "link.md")
    return d


def test_walk(root):
    assert [os.path.basename(p) for p in corpus.walk(str(root))] == ["a.md", "bad.txt", "big.txt", "scan.pdf", "_page.HTML"]
    inside = root / ".git" / "x"
    inside.mkdir(parents=True)
    (inside / "a.md").write_text("x")
    assert corpus.walk(str(inside)) == []
    with pytest.raises(corpus.WalkError):
        corpus.walk(str(root / "missing"))


def test_extraction_states(spark, root):
    got = {r.name: r for r in corpus.read_files(spark, corpus.walk(str(root)), max_bytes=8000).collect()}
    assert {k: r.extract_status for k, r in got.items()} == {"a.md": "extracted", "_page.HTML": "extracted", "scan.pdf": "needs-ocr", "bad.txt": "failed", "big.txt": "excluded"}
    assert got["_page.HTML"].extracted_text == "Title\nbody"
    assert got["big.txt"].content_hash is not None and got["big.txt"].extracted_text is None
    assert corpus.extract("x.pdf", b"", pdf_text=lambda b: "y" * 50).status == "extracted"
    assert corpus.extract("x.pdf", b"", pdf_text=lambda b: "short") == corpus.Extracted("needs-ocr", "short", "too little text")
    assert corpus.extract("x.png", b"").status == "excluded"
    assert corpus.read_files(spark, ["/missing.md"]).first().extract_status == "failed"


def test_binary_files(spark, root):
    got = corpus.extract_binary(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(root)))
    assert sorted(r.name for r in got.collect()) == ["a.md", "bad.txt", "big.txt", "link.md", "scan.pdf"]


def test_prepare_is_incremental(spark, root, tmp_path):
    store = str(tmp_path / "store")
    first = prepare(spark, str(root), store, size=500, overlap=50, max_bytes=8000)
    assert first == {"seen": 5, "pruned": 0, "extracted": 2, "needs-ocr": 1, "failed": 1, "excluded": 1}
    chunks = Snapshots(spark, f"{store}/chunks", Snapshots(spark, f"{store}/files"))
    ids = {(r.file_id, r.ordinal, r.text) for r in chunks.read().collect()}
    assert len(ids) > 5
    again = prepare(spark, str(root), store, size=500, overlap=50, max_bytes=8000)
    assert again["skipped"] == 2 and again["needs-ocr"] == 1
    assert {(r.file_id, r.ordinal, r.text) for r in chunks.read().collect()} == ids
    (root / "a.md").write_text("short")
    (root / "sub" / "_page.HTML").unlink()
    changed = prepare(spark, str(root), store, size=500, overlap=50, max_bytes=8000)
    assert changed["pruned"] == 1 and changed["extracted"] == 1 and "skipped" not in changed
    assert [r.text for r in chunks.read().collect()] == ["short"]
    other = prepare(spark, str(root), store, size=3, overlap=1, max_bytes=8000)
    assert other["extracted"] == 1
    assert chunks.read().count() > 1
    assert chunks.pointer()["meta"]["fingerprint"] == "chunk=3;overlap=1;max=8000"


def test_query_set(spark, tmp_path):
    p = tmp_path / "q.json"
    p.write_text(json.dumps([{"id": "a", "text": "tax", "category": " ", "grades": {"x.md": 2}}, {"id": "b", "text": "t", "relevant_path_globs": ["*.md"]}]))
    got = {r.id: r for r in corpus.load_queries(spark, str(p)).collect()}
    assert got["a"].category == got["b"].category == "uncategorized"
    assert (got["a"].relevant_path_globs, got["a"].grades, got["b"].grades) == ([], {"x.md": 2}, {})
    p.write_text("[]")
    with pytest.raises(ValueError):
        corpus.load_queries(spark, str(p))


def test_snapshot_check_failure_changes_nothing(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path / "t"))
    assert s.read() is None
    s.write(spark.range(3), {"m": 1}, check=lambda df: None)

    def refuse(df):
        raise ValueError(df.count())

    with pytest.raises(ValueError):
        s.write(spark.range(5), check=refuse)
    assert s.read().count() == 3 and s.pointer()["meta"] == {"m": 1}
    assert s.write(spark.range(4).withColumn("p", F.col("id") % 2), partition_by=["p"])["version"] == 2
    assert s.read().count() == 4


def test_sql_functions(spark):
    sql.register(spark)
    r = spark.sql("SELECT vec_dot(array(1D, 2D), array(3D, 4D)) AS d, vec_l2(array(0D), array(2D)) AS l, l2_normalize(array(3D, 4D)) AS n, bm25_part(1, 10, 10, 2) AS b").first()
    assert (r.d, r.l, r.n, r.b) == (11.0, 2.0, [0.6, 0.8], pytest.approx(2.0))
    got = spark.sql("SELECT c.* FROM (SELECT 'hello big world' AS t) x, LATERAL chunk_text(x.t, 8, 2) c").collect()
    assert [x.text for x in got][0] == "hello"


@pytest.mark.parametrize("point", ["chunks", "files", "pointer"])
def test_prepare_that_fails_anywhere_changes_nothing_and_converges(spark, root, tmp_path, monkeypatch, point):
    from docspark.sources import snapshots

    store = str(tmp_path / "store")
    prepare(spark, str(root), store, size=500, overlap=50, max_bytes=8000)
    files = Snapshots(spark, f"{store}/files")
    seen = lambda: (sorted(map(str, files.read().collect())), sorted(map(str, Snapshots(spark, f"{store}/chunks", files).read().collect())), files.pointer())
    before = seen()
    (root / "added.txt").write_text("a new file with some words")
    with monkeypatch.context() as m:
        def stage(self, *a, plain=Snapshots.stage, **k):
            if self.root.endswith(point):
                raise OSError("lost")
            return plain(self, *a, **k)

        m.setattr(Snapshots, "stage", stage)
        if point == "pointer":
            m.setattr(snapshots, "claim", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            prepare(spark, str(root), store, size=500, overlap=50, max_bytes=8000)
    assert seen() == before
    prepare(spark, str(root), store, size=500, overlap=50, max_bytes=8000)
    after = seen()
    assert len(after[0]) == len(before[0]) + 1 and len(after[1]) == len(before[1]) + 1


def test_of_two_snapshot_writers_one_fails(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from docspark.sources.snapshots import claim

    s = Snapshots(spark, str(tmp_path / "race"))
    s.write(spark.range(1))
    for turn in range(10):
        def one(k):
            draft = s._path(f"pointers/_{turn}-{k}")
            s._fs.create(draft, False).close()
            return claim(spark, s._fs, draft, s._path(f"pointers/z{turn}"))

        with ThreadPoolExecutor(4) as pool:
            assert sum(pool.map(one, range(4))) == 1
