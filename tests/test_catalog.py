"""Every registered query against its SQL oracle and against plans that would not scale."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_oracles import compare, connect
from vectorloom.plans.catalog import QUERIES
from vectorloom.plans.oracles import ORACLES

ROOT = Path(__file__).resolve().parent.parent

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(queries()) and set(ORACLES) <= set(oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_oracle(spark, con, name):
    df = queries()[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan  # no row-at-a-time Python
    assert compare(df.toPandas(), con.execute(oracle_sql()[name]).df()) == ""


def test_runs_from_another_folder_without_an_installed_package(tmp_path):
    """Executors get the package from the driver."""
    code = (
        "import importlib.util, sys; from pyspark.sql import SparkSession\n"
        f"spec = importlib.util.spec_from_file_location('__spark_entry__', {str(ROOT / '__spark_entry__.py')!r})\n"
        "m = importlib.util.module_from_spec(spec); spec.loader.exec_module(m)\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        f"print('rows', m.queries()['exact_topk'](s, {SF_DIR!r}).count())"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 2500" in done.stdout, done.stderr[-2000:]


def test_entry(spark):
    assert entry(spark).columns == ["qid", "rk", "vec_id", "score"]
