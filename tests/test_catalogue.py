import inspect
import os
import shutil
import subprocess
import sys

import pytest
from oracle import compare

from factloom.operators import scoring
from factloom.plans import catalogue

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, name):
    compare(spark, catalogue.QUERIES[name], catalogue.ORACLES[name], SF)


def test_queries_without_sql(spark):
    for name in set(catalogue.QUERIES) - set(catalogue.ORACLES):
        assert catalogue.QUERIES[name](spark, SF).collect()


def test_bootstrap_query_draws_the_published_resamples(spark, monkeypatch):
    asked, made = [], scoring.paired_bootstrap
    given = inspect.signature(made)

    def watched(*args, **named):
        bound = given.bind(*args, **named)
        bound.apply_defaults()
        asked.append(bound.arguments["resamples"])
        return made(*args, **named)

    monkeypatch.setattr(scoring, "paired_bootstrap", watched)
    catalogue.QUERIES["bootstrap_difference"](spark, SF)
    assert asked == [20_000]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 3
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("pipeline", [False, True])
def test_entry_without_the_training_data_operators(tmp_path, pipeline):
    """The whole repository without the llm folders, with and without the pipeline's file, also where a package is missing."""
    gone = ("llm", "__pycache__", ".git", *(() if pipeline else ("corpus_pipeline.py",)))
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(*gone))
    code = "import __spark_entry__ as e; q = e.queries(); assert not [k for k in q if k.startswith('op') and k[2].isdigit()] and 'pipeline' not in q and len(q) > 30 and e.oracle_sql()"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "repo", env=os.environ | {"PYTHONPATH": ""}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    if pipeline and os.path.isdir(os.path.join(ROOT, "factloom", "llm")):
        shutil.copytree(os.path.join(ROOT, "factloom", "llm"), tmp_path / "repo" / "factloom" / "llm")
        broken = "import sys; sys.modules['xxhash'] = None; " + code
        done = subprocess.run([sys.executable, "-B", "-c", broken], cwd=tmp_path / "repo", env=os.environ | {"PYTHONPATH": ""}, capture_output=True, text=True, timeout=120)
        assert done.returncode == 0, done.stderr
