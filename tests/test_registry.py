"""Every registered query against its DuckDB oracle on the sf0.001 tables, plus entry()."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry_mod  # noqa: E402
from opsdeck.registry import QUERIES  # noqa: E402
from oracle_check import TABLES, _rows  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"create view {t} as select * from read_parquet('{path}')")
    return con


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(entry_mod.queries()) and set(QUERIES) <= set(entry_mod.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    sdf = entry_mod.queries()[name](spark, SF)
    got = pd.DataFrame(sdf.collect(), columns=sdf.columns)
    want = duck.execute(entry_mod.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want) and len(got) > 0
    assert _rows(got) == _rows(want)


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    """As if the subpackage, its tests and the pipeline had been deleted."""
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(home, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    script = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), e.llm)"
    said = subprocess.run([sys.executable, "-B", "-c", script], cwd=tmp_path / "repo", capture_output=True, text=True, check=True,
                          env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}).stdout.split()
    assert said == [str(len(QUERIES)), str(len(QUERIES)), "None"]


def test_entry_smoke(spark):
    df = entry_mod.entry(spark)
    rows = df.collect()
    assert df.columns == ["method", "url", "requests", "avg_resp_time_ms", "avg_resp_bytes", "n_2xx", "n_4xx", "n_5xx"]
    assert 0 < len(rows) <= 50


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_column_types_match_oracle(spark, duck, name):
    spark_types = {c: SPARK_TO_DUCK.get(t, t) for c, t in entry_mod.queries()[name](spark, SF).dtypes}
    duck_types = {r[0]: r[1] for r in duck.execute(f"describe {entry_mod.oracle_sql()[name]}").fetchall()}
    assert spark_types == duck_types


def _q(spark, name):
    return entry_mod.queries()[name](spark, SF)


def test_invariants_on_fixture_tables(spark):
    from pyspark.sql import functions as F
    stats = _q(spark, "endpoint_stats_all")
    assert stats.filter(F.col("n_2xx") + F.col("n_4xx") + F.col("n_5xx") > F.col("requests")).count() == 0
    total = _q(spark, "cost_totals").first().total_instances
    assert _q(spark, "cost_by_owner").agg(F.sum("instance_count")).first()[0] == total
    assert _q(spark, "cost_by_box").count() == total
    for name in ("fleet_listing", "running_listing", "build_last_wins", "broker_lookup"):
        df = _q(spark, name)
        assert df.count() == df.select("build").distinct().count(), name
    night = {r.instance_id for r in _q(spark, "nightly_plan").collect()}
    morning = {r.instance_id for r in _q(spark, "morning_plan").collect()}
    assert night and morning and not night & morning
    for name in ("age_digest", "expiry_digest"):
        df = _q(spark, name)
        per_owner = df.groupBy("owner").agg(F.count("*").alias("n"), F.min("n_instances").alias("lo"),
                                            F.max("n_instances").alias("hi"))
        assert per_owner.filter((F.col("n") != F.col("lo")) | (F.col("n") != F.col("hi"))).count() == 0, name
    counts = _q(spark, "listing_counts").first()
    assert (counts.n_fleet_builds, counts.n_running_builds) == (_q(spark, "fleet_listing").count(),
                                                                _q(spark, "running_listing").count())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_has_no_python_windows_or_cross_joins(spark, name):
    df = entry_mod.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for node in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin", "Window", "Expand"):
        assert node not in plan, (name, node)
