"""Every registered query against its SQL, on the smallest tables; the entry point; the repository without its llm folders."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from phonoflow.plans import catalogue

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_against_sql(spark, sf, duck, same_rows, name):
    same_rows(catalogue.QUERIES[name](spark, sf), duck.execute(catalogue.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES.keys() - catalogue.ORACLES.keys() - {"parameter_grid", "beam_decode"}))
def test_runs(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


def test_greedy_selection_keeps_its_distance(spark, sf):
    words = [r["word"] for r in catalogue.QUERIES["greedy_confusion_select"](spark, sf).collect()]
    assert len(words) == len(set(words)) == 200
    assert not any(len(a) == len(b) and a != b and sum(x != y for x, y in zip(a, b, strict=True)) < 2 for a in words for b in words)


def test_without_llm(tmp_path):
    """The rest imports and lists its queries when the llm folders and the pipeline are gone."""
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'wb_bigram_prob' in q and not any(k.startswith('op') for k in q), q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "r", check=True)
