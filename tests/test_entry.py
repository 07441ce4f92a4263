import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert {"kv_resolve_live", "kv_follow_stream"} <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_optional_parts(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries())"], cwd=tmp_path / "r", env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
    names = said.stdout.split()
    assert "kv_resolve_live" in names and not any(n.startswith("op") or n == "pipeline" for n in names), said.stderr


def test_nothing_else_imports_the_optional_part():
    for p in (ROOT / "siltlog").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "llm" not in p.read_text(), p
