"""The entry points: they import and answer with the corpus operators' folders in place or taken out."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SHOW = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), sum(k.startswith('op') or k == 'pipeline' for k in q))"


@pytest.mark.parametrize("gone", [(), ("corpus_pipeline.py",), ("loomgraph/llm", "tests/llm", "corpus_pipeline.py"), ("loomgraph/llm", "tests/llm")], ids=["whole", "no pipeline", "neither", "no subpackage"])
def test_imports_without(tmp_path, gone):
    for name in ("loomgraph", "__spark_entry__.py", "corpus_pipeline.py"):
        if (source := ROOT / name).is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif source.exists():
            shutil.copy(source, tmp_path / name)
    for name in gone:
        path = tmp_path / name
        shutil.rmtree(path) if path.is_dir() else path.unlink(missing_ok=True)
    out = subprocess.run([sys.executable, "-c", SHOW], cwd=tmp_path, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    total, corpus = map(int, out.stdout.split()[-2:])
    if "loomgraph/llm" in gone:
        assert total > 50 and not corpus
