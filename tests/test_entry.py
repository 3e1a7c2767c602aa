"""The driver's contract, and that nothing outside needs the llm subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 60


def test_stands_without_llm(tmp_path):
    shutil.copytree(ROOT / "lectern", tmp_path / "lectern", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not any(k.startswith('op1_') for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_nothing_imports_llm():
    for path in (ROOT / "lectern").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "lectern.llm" not in path.read_text()


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["a", "b", "overlap"]
