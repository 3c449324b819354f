import os
import sys

import duckdb
import pytest

from support import ROOT, SF_SMALL

sys.path.insert(0, os.path.join(ROOT, "tools"))
import __spark_entry__ as E  # noqa: E402
from check_oracle import TABLES, compare  # noqa: E402

from weekcast.plans.oracle import ORACLE as OWN  # noqa: E402
from weekcast.plans.queries import QUERIES  # noqa: E402

# the text operators have their own tests
ORACLE = {k: v for k, v in E.oracle_sql().items() if k in OWN}


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert "fcst_timeseries" in df.columns


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert all(callable(f) for f in E.queries().values())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    assert compare(spark, duck, name, E.queries()[name], ORACLE[name], SF_SMALL)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_udf_or_cross_join_in_plans(spark, name):
    if name.startswith(("dt_", "kmeans")):
        pytest.skip("ML fit runs jobs while building the frame")
    plan = _plan(E.queries()[name](spark, SF_SMALL))
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filters_reach_the_scan(spark):
    df = E.queries()["clean_volume"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(p_partkey), In(p_brand" in plan or \
        "In(p_brand, [Brand#1,Brand#2,Brand#3])" in plan


def test_seasonality_windows_share_one_exchange(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = E.queries()["seasonality_robust"](spark, SF_SMALL)
        plan = _plan(df)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # one exchange for the weekly aggregate, one for the three windows
    assert plan.count("Exchange hashpartitioning") == 2
    assert plan.count("Window [") == 3


def test_pipeline_series_chain_has_one_shuffle(spark):
    """Gap fill, moving average, active filter and forecast share one hash partitioning by the
    series keys: the generated weeks are never shuffled."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = _plan(E.queries()["demand_forecast"](spark, SF_SMALL))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    series_keys = "hashpartitioning(regionseg1#"
    exchanges = [ln for ln in plan.splitlines() if "Exchange hashpartitioning" in ln]
    on_series = [ln for ln in exchanges if series_keys in ln and "productseg3" in ln
                 and "yearweek" not in ln and "_wn" not in ln]
    assert len(on_series) == 1, exchanges
    assert "Generate posexplode" in plan and plan.count("Window [") >= 4


def test_top_n_limits_before_the_shuffle(spark):
    plan = _plan(E.queries()["top_n"](spark, SF_SMALL))
    assert "WindowGroupLimit" in plan


def test_year_filter_bounds_the_lineitem_scan(spark):
    plan = _plan(E.queries()["partition_ratio"](spark, SF_SMALL))
    scan = [ln for ln in plan.splitlines() if "lineitem.parquet" in ln][0]
    assert "GreaterThanOrEqual(l_shipdate,1996-01-01" in scan


@pytest.mark.parametrize("name", ["promo_lookup", "global_minmax", "group_minmax"])
def test_numeric_aggregates_stay_hashed(spark, name):
    assert "SortAggregate" not in _plan(QUERIES[name](spark, SF_SMALL))


@pytest.mark.parametrize("name", ["promo_join_using_inner", "promo_join_using_left",
                                  "promo_price_impute", "active_items", "missing_weeks",
                                  "item_clusters", "forecast_mean4"])
def test_twice_read_inputs_are_staged(spark, name):
    assert "lineitem.parquet" not in _plan(QUERIES[name](spark, SF_SMALL))


def test_week_threshold_is_computed_once(spark):
    """The date arithmetic on the global last week is inside its one-row aggregate."""
    plan = _plan(QUERIES["demand_forecast"](spark, SF_SMALL))
    keep = [ln for ln in plan.splitlines() if "Filter" in ln and "_kmax" in ln]
    assert keep and all("make_date" not in ln and "substring" not in ln for ln in keep)
