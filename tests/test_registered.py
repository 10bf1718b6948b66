import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_finished_operators_are_registered():
    names = set(__spark_entry__.queries())
    assert {"p7_found", "p7_tables", "page_classify", "plain_text_render", "word_index"} <= names
    assert set(__spark_entry__.oracle_sql()) <= names


def _names(tmp_path, *, broken: bool) -> subprocess.CompletedProcess:
    """The registered names in a copy without the training-data package, or with one that cannot be imported."""
    for p in ROOT.rglob("*.py"):
        rel = p.relative_to(ROOT)
        if rel.parts[0] in ("foliospark", "__spark_entry__.py") and "llm" not in rel.parts:
            (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / rel).write_text(p.read_text())
    if broken:
        (tmp_path / "foliospark/llm").mkdir()
        (tmp_path / "foliospark/llm/__init__.py").write_text("")
        (tmp_path / "foliospark/llm/queries.py").write_text("import no_such_module\n")
    return subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries())"], cwd=tmp_path, capture_output=True, text=True)


def test_core_stands_alone(tmp_path):
    run = _names(tmp_path, broken=False)
    assert run.returncode == 0 and "p7_found" in run.stdout and "p1_found" not in run.stdout


def test_broken_package_is_not_hidden(tmp_path):
    assert "no_such_module" in _names(tmp_path, broken=True).stderr
