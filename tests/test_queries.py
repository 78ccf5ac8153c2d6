"""Every check query against its DuckDB oracle on the smallest tables."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry_point
from checks import QUERIES
from checks.verify import compare

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    ok, note = compare(spark, SF, name)
    assert ok, note


def test_oracles_belong_to_queries():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


def test_entry_without_the_operators(tmp_path):
    """With the operators' folders deleted the other queries still load, pipeline file or not."""
    root = Path(entry_point.__file__).parent
    for name in ("checks", "sitefold"):
        left_out = shutil.ignore_patterns("llm", "__pycache__")
        shutil.copytree(root / name, tmp_path / name, ignore=left_out)
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copy(root / "corpus_pipeline.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run(
        [sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True,
        env={"PATH": "", "PYTHONPATH": str(tmp_path)},
    )
    assert int(out.stdout.split()[0]) == len(QUERIES)
