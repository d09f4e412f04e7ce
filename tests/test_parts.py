"""The library without the parts that can be left out of an installation."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_without_text_operators(tmp_path):
    shutil.copytree(ROOT / "snapgrade", tmp_path / "snapgrade", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) == set(e.queries()) and len(e.queries()) > 90, len(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=300)
