import json

import pytest

from docspark import cli


def test_prepare_embed_query_eval_status(spark, tmp_path, capsys):
    root, store = tmp_path / "vault", str(tmp_path / "store")
    (root / "sub").mkdir(parents=True)
    (root / "tax-notes.md").write_text("spring tax documents and deductions")
    (root / "invoice-4021.txt").write_text("invoice for consulting work")
    (root / "sub" / "meeting.md").write_text("talk about the garden")
    run = lambda *a: (cli.main(list(a), spark), capsys.readouterr().out)[1]
    with pytest.raises(SystemExit):
        run("status", store)
    assert "'extracted': 3" in run("prepare", store, str(root))
    assert run("embed", store, "--config", "hashing:256").startswith("3 ")
    assert run("embed", store, "--config", "hashing:256").startswith("0 ")
    (root / "tax-notes.md").write_text("spring tax documents and more deductions")
    run("prepare", store, str(root))
    assert run("embed", store, "--config", "hashing:256").startswith("1 ")
    assert run("embed", store, "--config", "hashing:256", "--force").startswith("3 ")
    run("embed", store, "--config", "hashing:128")
    assert "vectors hashing:256 3" in run("status", store)
    shown = run("query", store, "tax deductions", "--config", "hashing:256")
    assert shown.startswith("semantic:\n   1. tax-notes.md") and "keyword:" in shown
    asked = tmp_path / "q.json"
    asked.write_text(json.dumps([{"id": "a", "text": "tax deductions", "category": "notes", "relevant_path_globs": ["*tax*"], "grades": {"tax-notes": 2}}, {"id": "b", "text": "consulting invoice", "grades": {str(root / "invoice-4021.txt"): 1}}]))
    out = run("eval", store, str(asked), str(tmp_path / "report"), "--config", "hashing:256", "--config", "hashing:128")
    assert "dims" in out
    report = json.loads((tmp_path / "report.json").read_text())
    whole = [r for r in report["tables"]["configurations"] if r["category"] is None]
    assert [(r["config"], r["judged"], r["recall"]) for r in whole] == [("hashing:256", 2, 1.0), ("hashing:128", 2, 1.0)]
    asked.write_text(json.dumps([{"id": "a", "text": "x", "grades": {"no such file": 2}}]))
    with pytest.raises(SystemExit):
        run("eval", store, str(asked), str(tmp_path / "report"), "--config", "hashing:256")
