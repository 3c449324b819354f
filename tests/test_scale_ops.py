"""Blocks with a halo, tiled joins, category indices, weekly tables, bucketed stages."""

import os
import re

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from support import SF_SMALL, executed_plan, rows
from weekcast.operators import aggs, ml, seasonality, tiles, windows
from weekcast.plans import queries
from weekcast.plans.queries import QUERIES
from weekcast.sources import sinks


def same(a, b):
    return a.count() == b.count() and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


# ------------------------------------------------------------------ frames over hot partitions

def series(spark, n, key):
    return spark.range(n).select(key.alias("k"), F.col("id").alias("t"),
                                 F.when(F.col("id") % 11 > 0, F.col("id") * 7 % 101).cast("double").alias("v"))


@pytest.mark.parametrize("key,block", [("all", 5), ("third", 64), ("small", 5)])
def test_frames_in_blocks_equal_the_window(spark, key, block):
    i = F.col("id")
    k = {"all": F.lit("a"), "third": F.when(i % 3 == 0, "hot").when(i % 50 > 1, (i % 7).cast("string")),
         "small": (i / 3).cast("int").cast("string")}[key]
    df = series(spark, 700, k)
    for fn, width in ((windows.moving_avg, 1), (windows.moving_avg, 7), (windows.moving_stddev, 5)):
        got = fn(df, ["k"], ["t"], "v", width, "m", block_rows=block)
        assert same(got, fn(df, ["k"], ["t"], "v", width, "m"))


def test_one_key_on_all_rows_is_spread(spark):
    got = windows.moving_avg(series(spark, 4000, F.lit("a")), ["k"], ["t"], "v", 5, "m", block_rows=100)
    plan = executed_plan(got)
    assert "hashpartitioning(k" not in plan and "hashpartitioning(_block" in plan
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = windows.moving_avg(series(spark, 4000, F.lit("a")), ["k"], ["t"], "v", 5, "m", block_rows=100)
        sizes = [r["n"] for r in got.groupBy(F.spark_partition_id()).agg(
            F.count("m").alias("n"), F.sum("m")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) >= 6 and sum(sizes) == 4000 and max(sizes) < 1500


def test_chained_frames_in_blocks(spark):
    df = spark.range(900).select(
        F.when(F.col("id") < 600, "hot").when(F.col("id") < 640, F.lit(None)).otherwise("b").alias("k"),
        F.concat(F.lit("2016"), F.lpad((F.col("id") % 52 + 1).cast("string"), 2, "0")).alias("yearweek"),
        F.col("id").alias("t"), (F.col("id") * 13 % 97).cast("double").alias("qty"))
    got = seasonality.robust_seasonality(df, ["k"], tiebreak=["t"], block_rows=30)
    assert same(got, seasonality.robust_seasonality(df, ["k"], tiebreak=["t"]))


def test_blocks_of_empty_tables_and_bounds(spark):
    df = series(spark, 10, F.lit("a"))
    assert windows.moving_avg(df.limit(0), ["k"], ["t"], "v", 3, block_rows=4).count() == 0
    with pytest.raises(ValueError):
        windows.moving_avg(df, ["k"], ["t"], "v", 21, block_rows=5)


@pytest.mark.parametrize("name", ["moving_avg_coarse", "seasonality_robust_region"])
def test_coarse_frames_have_no_exchange_by_region(spark, name):
    plan = executed_plan(QUERIES[name](spark, SF_SMALL))
    assert not re.search(r"hashpartitioning\(region", plan)


# ------------------------------------------------------------------------- fan-out joins

def sides(spark):
    def side(n, name, mod):
        i = F.col("id")
        key = F.when(i % 3 == 0, "HOT").when(i % 10 == 1, F.lit(None)).otherwise((i % mod).cast("string"))
        return spark.range(n).select(key.alias("k"), (i / 2).cast("int").alias(name))  # rows come twice
    return side(2400, "x", 50), side(900, "y", 70)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_tiled_join_is_exact(spark, how):
    left, right = sides(spark)
    only_left = spark.createDataFrame([("L", i) for i in range(300)], "k string, x int")
    only_right = spark.createDataFrame([("R", i) for i in range(300)], "k string, y int")
    left, right = left.union(only_left), right.union(only_right)
    got = tiles.tiled_join(left, right, ["k"], how, least_rows=20, least_pairs=500)
    assert got.columns == ["k", "x", "y"] and same(got, left.join(right, "k", how))
    assert same(tiles.tiled_join(left, right, ["k"], how), left.join(right, "k", how))
    none = right.limit(0)
    assert tiles.tiled_join(left, none, ["k"], how).count() == (left.count() if how == "left" else 0)


def test_no_tile_above_its_share(spark):
    left, right = sides(spark)
    share = 1 / 16
    a, b = tiles.tiles(left, right, ["k"], share, least_rows=1, least_pairs=1, keep_null_keys=True)
    tile = ["k", "_tile_i", "_tile_j"]
    pairs = left.join(right, "k").count()
    la = {tuple(r[:3]): r[3] for r in a.groupBy(*tile).count().collect()}
    rb = {tuple(r[:3]): r[3] for r in b.groupBy(*tile).count().collect()}
    # parts are drawn by hash, so a tile may exceed its share a little
    assert max(la.values()) <= 1.5 * share * left.count()
    assert max(rb.values()) <= 1.5 * share * right.count()
    assert max(n * rb.get(t, 0) for t, n in la.items()) <= 1.5 * share * pairs
    assert sum(n * rb.get(t, 0) for t, n in la.items() if t[0] is not None) == pairs
    heavy = tiles.heavy_keys(left, right.filter("k is not null"), ["k"], share, 1, 1)
    assert 1 <= heavy.count() <= 3 / share


def test_tiled_join_rejects_what_it_cannot_do(spark):
    left, right = sides(spark)
    with pytest.raises(ValueError):
        tiles.tiled_join(left, right, ["k"], "full")
    with pytest.raises(ValueError):
        tiles.tiled_join(left, right.withColumnRenamed("y", "X"), ["k"])


@pytest.mark.parametrize("how", ["inner", "left"])
def test_tiled_join_counts_equal_right_rows(spark, how):
    left, right = sides(spark)
    left = left.union(spark.createDataFrame([("L", i) for i in range(300)], "k string, x int"))
    right = right.withColumn("y", F.when(F.col("y") % 7 > 0, F.col("y") % 7))  # some NULL, many equal
    got = tiles.tiled_join(left, right, ["k"], how, least_rows=20, least_pairs=500, times="n")
    again = got.select("k", "x", "y", F.explode(F.sequence(F.lit(1), "n")).alias("_")).drop("_")
    assert got.columns == ["k", "x", "y", "n"] and same(again, left.join(right, "k", how))
    assert got.count() == left.join(right.distinct(), "k", how).count()
    with pytest.raises(ValueError):
        tiles.tiled_join(left, right, ["k"], how, times="Y")
    with pytest.raises(ValueError):
        tiles.tiled_join(left, right, ["k"], how, right_number="y", times="n")


def test_payer_fanout_grows_with_the_rows(spark, monkeypatch):
    sold = spark.createDataFrame(
        [("HOT", 20001, "A", str(i), "200001", float(i % 9)) for i in range(200)]
        + [("one", 20001, "B", "7", "200002", 3.0), ("none", 20002, "B", "8", "200015", 5.0),
           (None, None, "B", "9", None, 2.0), ("one", 20003, "B", "7", "200027", None)],
        "payer string, quarter bigint, regionid string, accountid string, yearweek string, qty double")
    promo = spark.createDataFrame(
        [("HOT", 20001, i % 5) for i in range(50)] + [("HOT", 20001, None), ("one", 20001, 4), ("one", 20001, None),
         ("one", 20003, 0), ("other", 20001, 1), (None, None, 2)], "payer string, quarter bigint, percent bigint")
    made = []
    join = tiles.tiled_join
    monkeypatch.setattr(tiles, "tiled_join", lambda *a, **b: made.append(join(*a, **b)) or made[-1])
    monkeypatch.setattr(queries.ds, "payer_sellout", lambda *_: sold)
    counts = []
    for copies in (1, 40):
        each = promo.withColumn("_", F.explode(F.sequence(F.lit(1), F.lit(copies)))).drop("_")
        monkeypatch.setattr(queries.ds, "payer_promo", lambda *_, each=each: each)
        plain = sold.join(each, ["payer", "quarter"], "left").groupBy("regionid", "quarter").agg(
            F.count(F.lit(1)).alias("n_rows"), F.count("percent").alias("n_pairs"),
            F.sum(F.when(F.col("percent").isNull(), F.col("qty"))).alias("qty_unmatched"),
            F.sum(F.col("qty") * F.col("percent")).alias("qty_percent"))
        got = QUERIES["payer_fanout"](spark, SF_SMALL)
        assert got.dtypes == plain.dtypes and same(got, plain)
        counts.append(made[-1].count())
    assert counts[0] == counts[1] == 200 * 6 + 2 + 1 + 1 + 1


# --------------------------------------------------------------------------- category index

def test_category_index_ties_nulls_and_types(spark):
    df = spark.createDataFrame([("b", 1), ("a", 1), ("a", 2), ("b", None), ("c", 10), (None, 10), ("é", 2)],
                               "s string, n int")
    got = ml.category_index(df, ["s", "n"])
    assert rows(got) == [("n", "1", 0.0 + 0, 2), ("n", "10", 1.0, 2), ("n", "2", 2.0, 2),
                         ("s", "a", 0.0, 2), ("s", "b", 1.0, 2), ("s", "c", 2.0, 1), ("s", "é", 3.0, 1)]
    coded = ml.encode_categories(df, got, ["s", "n"])
    assert [r.s_in for r in coded.filter("s is null").collect()] == [4.0]
    assert {(r.n, r.n_in) for r in coded.collect()} == {(1, 0.0), (10, 1.0), (2, 2.0), (None, 3.0)}
    assert ml.category_index(df.limit(0), ["s"]).count() == 0


def test_category_index_agrees_with_the_indexer(spark):
    from pyspark.ml.feature import StringIndexer
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(
        (F.col("id") * F.col("id") % 811).cast("string")).alias("s"))
    want = StringIndexer(inputCol="s", outputCol="i").fit(df).transform(df).groupBy("s", "i").count()
    assert rows(ml.category_index(df, ["s"]).select("label", "category_index", "n")) == rows(want)


# ----------------------------------------------------------------------------- weekly tables

WEEKS = "yearweek string, k string, qty double"


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_weekly_table_runs_repeat(spark, tmp_path, fmt):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([("201601", "a", 1.0), ("201601", "b", 2.0), ("201602", "a", 3.0),
                                   ("201603", "a", 4.0)], WEEKS)
    again = spark.createDataFrame([("201602", "z", 9.0), ("201604", "a", 5.0)], WEEKS)

    def table():
        return rows(sinks.read_weeks(spark, path, fmt=fmt, schema=first.schema), "yearweek", "k", "qty")

    assert sinks.write_weeks(first, path, fmt=fmt) == []
    for _ in range(2):  # a repeated run leaves no copy
        sinks.write_weeks(again, path, fmt=fmt)
        assert table() == [("201601", "a", 1.0), ("201601", "b", 2.0), ("201602", "z", 9.0),
                           ("201603", "a", 4.0), ("201604", "a", 5.0)]
    # a delivered week without rows is withdrawn; others stay
    assert sinks.write_weeks(again.filter("yearweek = '201604'"), path, weeks=["201602", "201604", "201609"],
                             fmt=fmt) == ["201602"]
    assert [r[0] for r in table()] == ["201601", "201601", "201603", "201604"]
    # a row of a week that is not delivered: an error, and the table stays as it was
    before = table()
    with pytest.raises(Exception, match="not delivered: 201602"):
        sinks.write_weeks(again, path, weeks=["201604"], fmt=fmt)
    assert table() == before
    assert sinks.write_weeks(first.limit(0), path, fmt=fmt) == [] and table() == before
    assert sinks.write_weeks(first.limit(0), path, weeks=["201603"], fmt=fmt) == ["201603"]
    assert table() == [r for r in before if r[0] != "201603"]


def test_a_hot_week_gets_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "ROWS_PER_FILE", 100)
    df = spark.range(1000).select(F.when(F.col("id") % 10 > 0, "201601").otherwise("201602").alias("yearweek"), "id")
    sinks.write_weeks(df, str(tmp_path / "t"))
    files = {w: len([f for f in os.listdir(tmp_path / "t" / f"yearweek={w}") if f.startswith("part")])
             for w in ("201601", "201602")}
    assert files["201601"] >= 9 and files["201602"] <= 2
    assert sinks.read_weeks(spark, str(tmp_path / "t")).distinct().count() == 1000


def scans(df):
    """Partitions read by each file scan of an executed frame."""
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    if plan.getClass().getSimpleName() == "ResultQueryStageExec":
        plan = plan.plan()
    leaves = plan.collectLeaves()
    out = []
    for k in range(leaves.size()):
        found = leaves.apply(k).metrics().get("numPartitions")
        if found.isDefined():
            out.append(found.get().value())
    return out


def test_recent_weeks_open_only_their_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(400).select(F.concat(F.lit("2016"), F.lpad((F.col("id") % 40 + 1).cast("string"), 2, "0"))
                                 .alias("yearweek"), "id")
    sinks.write_weeks(df, path)
    got = sinks.read_weeks(spark, path, last=3)
    assert re.search(r"PartitionFilters: \[[^\]]*yearweek#\d+ >= Subquery", executed_plan(got))
    assert sorted({r.yearweek for r in got.collect()}) == ["201637", "201638", "201639", "201640"]
    assert scans(got) == [4]
    some = sinks.read_weeks(spark, path, since="201602", until="201603")
    assert some.count() == 20


def test_week_bound_with_dangling_newest_lines(spark, tmp_path):
    """Lines of the newest weeks without an order, customer or part: the last sales week is
    an earlier one, and the weeks before it must still be complete."""
    import sys

    from support import ROOT
    sys.path.insert(0, os.path.join(ROOT, "tools"))
    from check_oracle import compare

    from weekcast.plans.oracle import ORACLE
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "part", "orders"):
        con.execute(f"COPY (SELECT * FROM '{SF_SMALL}/{t}.parquet') TO '{tmp_path}/{t}.parquet'")
    con.execute(f"""COPY (
        SELECT * FROM '{SF_SMALL}/lineitem.parquet' UNION ALL
        SELECT * REPLACE (l_orderkey + 1000000000 AS l_orderkey, l_shipdate + INTERVAL 90 WEEK AS l_shipdate)
        FROM '{SF_SMALL}/lineitem.parquet') TO '{tmp_path}/lineitem.parquet'""")
    for t in ("region", "nation", "customer", "part", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    for name in ("item_clusters", "forecast_mean4"):
        assert compare(spark, con, name, QUERIES[name], ORACLE[name], str(tmp_path))
    con.execute(f"COPY (SELECT * FROM orders WHERE false) TO '{tmp_path}/none.parquet'")
    os.replace(tmp_path / "none.parquet", tmp_path / "orders.parquet")
    assert QUERIES["item_clusters"](spark, str(tmp_path)).count() == 0


# ------------------------------------------------------------------------ stages and groupings

def test_bucketed_join_has_no_exchange(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = executed_plan(QUERIES["promo_flag_bucketed"](spark, SF_SMALL))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan and plan.count("Bucketed: true") == 2


def test_aggregate_by_bucket_keys_has_no_exchange(spark):
    df = spark.range(500).select((F.col("id") % 20).alias("k"), (F.col("id") % 3).alias("w"), "id")
    stage = sinks.bucketed(df, "by-key", ["k"], 4)
    agg = stage.groupBy("k").agg(F.sum("id").alias("s"))
    assert "Exchange" not in executed_plan(agg)
    assert same(agg, df.groupBy("k").agg(F.sum("id").alias("s")))


def test_groupings_from_one_scan(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", None, 3.0), (None, "x", 5.0)], "r string, p string, v double")
    got = aggs.stats_by_sets(df, ["r", "p"], [["r", "p"], ["r"], []], "v")
    plan = executed_plan(got)
    assert plan.count("Expand") == 1 and plan.count("Exchange") == 1
    have = {(r.r, r.p, r.level): (r.cnt, r["sum"]) for r in got.collect()}
    assert have == {("a", "x", 0): (1, 1.0), ("a", None, 0): (1, 3.0), (None, "x", 0): (1, 5.0),
                    ("a", None, 1): (2, 4.0), (None, None, 1): (1, 5.0), (None, None, 3): (3, 9.0)}


# --------------------------------------------------------------------- lookups and models

def rows_read(df):
    """Rows that the file scans of an executed frame gave out."""
    plan = df._jdf.queryExecution().executedPlan()
    for name, step in (("AdaptiveSparkPlanExec", "executedPlan"), ("ResultQueryStageExec", "plan")):
        if plan.getClass().getSimpleName() == name:
            plan = getattr(plan, step)()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size()))


def test_point_lookup_skips_row_groups(spark, tmp_path):
    from weekcast.operators import joins
    df = spark.range(400_000).select((F.col("id") * 7919 % 100_003).cast("string").alias("k"),
                                     F.sha2(F.col("id").cast("string"), 256).alias("v")).repartition(4)
    stage = sinks.keyed(df, "by-k", "k", block_mb=1)
    got = joins.by_key(stage, {"k": "500"})
    assert "EqualTo(k,500)" in executed_plan(got)
    assert same(got, df.filter("k = '500'"))
    got = joins.by_key(stage, {"k": "500"})
    n = len(got.collect())
    assert 1 <= n < 10 and rows_read(got) < 40_000  # of 400,000
    # a key inside the range of every row group that is not there: the Bloom filters say so
    assert joins.by_key(stage, {"k": "5000000"}).count() == 0


def test_account_lookup_filters_the_stage(spark):
    plan = executed_plan(QUERIES["account_lookup"](spark, SF_SMALL))
    assert "EqualTo(accountid,7)" in plan and "Join" not in plan


def test_lloyd_rounds(spark):
    pts = [(i, float(i % 2) * 10 + i % 3, float(i % 5)) for i in range(40)] + [(100, None, 1.0)]
    df = spark.createDataFrame(pts, "id long, x double, y double")
    got = {r.id: r.prediction for r in ml.lloyd_segments(df, "id", ["x", "y"], k=2, rounds=20).collect()}
    assert got.pop(100) is None
    centres = [pts[0][1:], pts[1][1:]]
    for _ in range(20):
        lab = [min(range(2), key=lambda c: (sum((a - b) ** 2 for a, b in zip(p[1:], centres[c])), c)) for p in pts[:40]]
        centres = [tuple(sum(p[d] for p, z in zip(pts, lab) if z == c) / lab.count(c) for d in (1, 2)) for c in range(2)]
    assert got == dict(enumerate(lab))
    # fewer rows than centres, one point many times, an empty table
    assert [r.prediction for r in ml.lloyd_segments(df.limit(1), "id", ["x", "y"], k=3).collect()] == [0]
    one = spark.createDataFrame([(i, 1.0, 1.0) for i in range(5)], "id long, x double, y double")
    assert {r.prediction for r in ml.lloyd_segments(one, "id", ["x", "y"], k=2).collect()} == {0}
    assert ml.lloyd_segments(df.limit(0), "id", ["x", "y"]).count() == 0
