"""The record engine stands without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent


def test_entry_module_without_the_corpus_operators(tmp_path):
    shutil.copytree(ROOT / "recordloom", tmp_path / "recordloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op') or n == 'pipeline' for n in e.queries()))"], cwd=tmp_path, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr[-500:]
    queries, oracles, corpus = said.stdout.split()[-3:]
    assert int(queries) == int(oracles) > 100 and corpus == "False"


def test_nothing_else_imports_them():
    assert not [p for p in (ROOT / "recordloom").rglob("*.py") if "llm" not in p.relative_to(ROOT).parts and "recordloom.llm" in p.read_text()]
