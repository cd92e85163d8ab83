"""The driver's contract."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from lexshoal.plans import files, lookups, models, registry


@pytest.mark.parametrize("module", [registry, files, lookups, models])
def test_every_query_of_the_engine_has_sql(module):
    assert set(module.QUERIES) == set(module.ORACLES)


def test_queries_include_the_engine():
    modules = (registry, files, lookups, models)
    assert set().union(*(m.QUERIES for m in modules)) <= set(entry.queries())
    assert len(set().union(*(m.QUERIES for m in modules))) == sum(len(m.QUERIES) for m in modules)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("pipeline", [True, False])
def test_the_rest_stands_without_the_training_data_operators(tmp_path, pipeline):
    """With the subpackage deleted, with or without the pipeline's file, the entry imports and has the engine's queries."""
    root = Path(entry.__file__).parent
    for name in ("__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline and (root / "corpus_pipeline.py").exists() else [])):
        shutil.copy(root / name, tmp_path)
    shutil.copytree(root / "lexshoal", tmp_path / "lexshoal", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=True)
    want = " ".join(sorted(registry.QUERIES | files.QUERIES | lookups.QUERIES | models.QUERIES))
    assert done.stdout.splitlines() == [want, want]


@pytest.mark.skipif(not entry.HAS_LLM, reason="the training-data subpackage is not installed")
def test_queries_include_the_pipeline():
    names = entry.queries()
    assert "pipeline" in names and all(any(x.startswith(f"op{n}_") for x in names) for n in range(1, 14))
