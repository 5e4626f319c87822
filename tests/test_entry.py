"""The driver's entry points where the training-data subpackage is not there."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SAYS = "import __spark_entry__ as E; names = set(E.queries()); assert set(E.oracle_sql()) <= names; print(*sorted(names))"


@pytest.mark.parametrize("gone", [["vigil/llm"], ["vigil/llm", "corpus_pipeline.py"]])
def test_queries_without_the_subpackage(tmp_path, gone):
    for x in ("vigil", "__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / x).is_dir():
            shutil.copytree(ROOT / x, tmp_path / x, ignore=lambda d, names: [n for n in names if str(Path(d, n).relative_to(ROOT)) in gone])
        elif x not in gone and (ROOT / x).exists():
            shutil.copy(ROOT / x, tmp_path / x)
    got = subprocess.run([sys.executable, "-B", "-c", SAYS], cwd=tmp_path, capture_output=True, text=True, timeout=100)
    names = got.stdout.split()
    assert got.returncode == 0, got.stderr
    assert "alerts_fused" in names and not [n for n in names if n.startswith("op") or n == "pipeline"]


def test_other_errors_are_raised(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "vigil", tmp_path / "vigil")
    (tmp_path / "vigil/catalog.py").write_text("import no_such_module_at_all")
    got = subprocess.run([sys.executable, "-B", "-c", SAYS], cwd=tmp_path, capture_output=True, text=True, timeout=100)
    assert got.returncode and "no_such_module_at_all" in got.stderr
