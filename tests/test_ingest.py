from __future__ import annotations

import os

import pytest

from lodestar.plans import ingest, search
from lodestar.plans.generations import Generations


def test_index_and_search(spark, tmp_path, capsys):
    root = tmp_path / "notes"
    (root / "sub").mkdir(parents=True)
    (root / "semaphores.md").write_text("# Semaphores\n\nA counting semaphore protects permits.\n")
    (root / "sub" / "graphs.txt").write_text("Shortest paths in graphs by priority queues.\n")
    (root / "search.py").write_text("def rank_fusion(a):\n    return a\n")
    (root / "bad.txt").write_bytes(b"\xffnope")
    held = Generations(spark, f"file://{tmp_path}/catalog")
    assert ingest.index(spark, str(root), held) == {"extract": 4}
    files = {r.relative_path: r for r in held.read("files").collect()}
    assert files["bad.txt"].error_code == "UNSUPPORTED_ENCODING" and files["bad.txt"].active_revision_id is None
    assert [r.symbol for r in held.read("chunks").where("kind = 'code'").collect()] == ["rank_fusion"]
    # unchanged files are skipped; a changed one is read again, a missing one goes
    (root / "semaphores.md").write_text("# Semaphores\n\nA binary semaphore and a mutex.\n")
    os.remove(root / "sub" / "graphs.txt")
    assert ingest.index(spark, str(root), held) == {"skipped": 1, "extract": 2, "deleted": 1}
    now = {r.relative_path: r.id for r in held.read("files").collect()}
    assert set(now) == {"semaphores.md", "search.py", "bad.txt"} and now["semaphores.md"] == files["semaphores.md"].id
    assert held.read("chunks").where("text like '%counting%'").count() == 0 and held.read("chunks", 1).where("text like '%counting%'").count() == 1
    q = spark.createDataFrame([("a", "mutex"), ("b", "rank fusion"), ("c", "graphs"), ("d", None)], "query_id string, query string")
    got = {r.query_id: r for r in search.hybrid(search.build(spark, held.folder()), q).where("place = 1").collect()}
    assert got["a"].relative_path == "semaphores.md" and got["a"].match_kind == "terms" and got["b"].relative_path == "search.py" and "d" not in got


def test_again(spark, tmp_path):
    """Unchanged files are not opened, touched ones read but kept, equal contents lent; a lost folder keeps its files."""
    root = tmp_path / "notes"
    root.mkdir()
    (root / "a.md").write_text("# A\n\nA counting semaphore protects permits.\n")
    (root / "b.py").write_text("def rank(a):\n    return a\n")
    held = Generations(spark, f"file://{tmp_path}/catalog")
    assert ingest.index(spark, str(root), held) == {"extract": 2}
    before = {r.relative_path: r.asDict() for r in held.read("files").collect()}
    os.chmod(root / "a.md", 0o000)
    assert ingest.index(spark, str(root), held) == {"skipped": 2}
    os.chmod(root / "a.md", 0o644)
    os.utime(root / "a.md", ns=(1, 1))
    (root / "c.md").write_text("# A\n\nA counting semaphore protects permits.\n")
    assert ingest.index(spark, str(root), held) == {"skipped": 1, "reuse_checked": 1, "extract": 1}
    after = {r.relative_path: r.asDict() for r in held.read("files").collect()}
    assert after["a.md"]["mtime_ns"] == 1 and after["a.md"]["active_revision_id"] == before["a.md"]["active_revision_id"]
    texts = {r.relative_path: r.text for r in held.read("chunks").join(held.read("files").withColumnRenamed("id", "f").withColumnRenamed("active_revision_id", "revision_id"), "revision_id").select("relative_path", "text").collect()}
    assert texts["c.md"] == texts["a.md"]
    assert ingest.index(spark, str(root), held, forced=["b.py"]) == {"skipped": 2, "reuse_checked": 1}
    with held.writing(), pytest.raises(RuntimeError, match="INDEX_BUSY"):
        ingest.index(spark, str(root), held)
    with pytest.raises(ValueError, match="OVERLAPPING_ROOT"):
        (root / "sub").mkdir()
        ingest.index(spark, str(root / "sub"), held)
    os.rename(root, tmp_path / "elsewhere")
    assert ingest.index(spark, str(root), held) == {"unavailable": 1}
    assert held.read("roots").first().status == "unavailable" and held.read("files").count() == 3
    assert ingest.forget(held, str(root)) == {"roots": 0, "files": 0, "revisions": 0, "chunks": 0}
    assert held.retire(1) and held.current()["generation"] > 4


def test_command_line(spark, tmp_path, capsys):
    import json

    from lodestar import cli

    root = tmp_path / "notes"
    root.mkdir()
    (root / "semaphores.md").write_text("# Semaphores\n\nA counting semaphore protects permits.\n")
    (root / "rank.py").write_text("def rank_fusion(a):\n    return a\n")
    (tmp_path / "q.jsonl").write_text('{"id": "1", "query": "counting semaphore", "category": "exact", "split": "dev"}\n\n{"id": "2", "query": "zebra", "category": "none", "split": "test"}\n')
    (tmp_path / "j.jsonl").write_text('{"query_id": "1", "path": "semaphores.md", "grade": 2}\n')
    at = f"file://{tmp_path}/catalog"
    run = lambda *a: (cli.main([at, *a]), [json.loads(x) for x in capsys.readouterr().out.splitlines()])[1]
    assert run("index", str(root)) == [{"extract": 2}]
    assert run("search", "counting", "semaphore", "--mode", "lexical")[0]["relative_path"] == "semaphores.md"
    assert run("search", "rank", "--modality", "text") == [] and run("search", "rank", "--extension", ".py")[0]["name"] == "rank.py"
    first = run("evaluate", f"file://{tmp_path}/q.jsonl", f"file://{tmp_path}/j.jsonl", "--mode", "lexical")
    whole = [r for r in first if r["category"] is None and r["split"] is None][0]
    assert whole["queries"] == 2 and whole["answerable"] == 1 and whole["mrr"] == 1.0 and whole["false_positive_rate"] == 0.0
    assert len(first) == 5 and run("failures") == []
    assert run("forget", str(root))[0]["files"] == 0
