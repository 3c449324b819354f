"""Hot keys: one key holding a third of all rows must not change results, and the plans
must pre-aggregate before the shuffle instead of moving the hot key's rows."""

from pyspark.sql import functions as F

from support import rows
from weekcast.operators import aggs, joins, series


def _hot(spark, n=30000):
    # key "HOT" holds a third of the rows, spread over 3 weeks with gaps between them
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.concat(F.lit("K"),
                                                                      (F.col("id") % 500)
                                                                      .cast("string")))
        .alias("k"),
        F.element_at(F.array(F.lit("201601"), F.lit("201605"), F.lit("201609")),
                     (F.floor(F.col("id") / 3) % 3 + 1).cast("int")).alias("yearweek"),
        F.lit(1.0).alias("qty"))
    return df


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_key_is_pre_aggregated_then_filled(spark):
    raw = _hot(spark)
    weekly = aggs.sum_by_key(raw, ["k", "yearweek"], "qty", "qty")
    plan = _plan(weekly)
    assert "partial_sum" in plan  # map-side combine before the exchange
    filled = series.fill_weeks(weekly, ["k"], fill={"qty": 0.0})
    hot = filled.filter("k = 'HOT'")
    assert hot.count() == 9  # 201601..201609, one row per week
    assert hot.agg(F.sum("qty")).first()[0] == 10000.0


def test_stats_on_rows_uses_aggregate_not_window(spark):
    raw = _hot(spark)
    out = aggs.stats_on_rows(raw, ["k"], "qty")
    plan = _plan(out)
    assert "Window" not in plan and "partial_count" in plan
    assert rows(out.filter("k = 'HOT'").select("cnt").distinct()) == [(10000,)]


def test_lookup_dedupes_hot_key_map_side(spark):
    raw = _hot(spark).withColumn("ord", F.monotonically_increasing_id())
    left = spark.createDataFrame([("HOT",), ("K1",), ("ZZ",)], "k string")
    out = joins.lookup(left, raw, ["k"], ["k"], "yearweek", ["yearweek", "ord"], default="none")
    plan = _plan(out)
    assert "partial_min_by" in plan or "partial_min" in plan
    first = {r.k: r.w for r in raw.groupBy("k").agg(F.min("yearweek").alias("w")).collect()}
    assert rows(out) == [("HOT", first["HOT"]), ("K1", first["K1"]), ("ZZ", "none")]


def test_rank_within_groups_is_exact_and_splits_hot_groups(spark):
    from pyspark.sql import Window

    from weekcast.operators.windows import rank_within_groups
    n = 30000
    df = spark.range(n).select(
        F.when(F.col("id") < n // 3 * 2, F.lit("HOT")).otherwise(
            F.concat(F.lit("G"), (F.col("id") % 7).cast("string"))).alias("g"),
        F.col("id").cast("string").alias("item"),
        (F.col("id") % 997).cast("double").alias("v"))  # many ties
    # a NULL measure comes last, NULL is a group, and one value is shared by a whole hot group
    odd = spark.createDataFrame([(None, "x", 1.0), (None, "y", None), ("HOT", "n1", None),
                                 ("HOT", "n0", None)], "g string, item string, v double")
    ties = spark.range(5000).select(F.lit("TIED").alias("g"), F.col("id").cast("string").alias("item"),
                                    F.lit(0.0).alias("v"))
    df = df.union(odd).union(ties)
    got = rank_within_groups(df, ["g"], "v", ["item"])
    w = Window.partitionBy("g").orderBy(F.col("v").desc_nulls_last(), "item")
    want = df.withColumn("rank", F.row_number().over(w)) \
             .withColumn("cnt", F.count(F.lit(1)).over(Window.partitionBy("g")))

    def key(r):
        return tuple((x is None, x) for x in r)

    cols = ["g", "item", "rank", "cnt"]
    assert sorted(map(tuple, got.select(*cols).collect()), key=key) == \
        sorted(map(tuple, want.select(*cols).collect()), key=key)
    # no window over a group: the rows are sorted in range partitions
    assert "Window" not in _plan(got)


def test_join_backs_keep_null_keys(spark):
    from weekcast.operators import seasonality, windows
    df = spark.createDataFrame([(None, "201601", 4.0), (None, "201602", 2.0), ("a", "201601", 1.0)],
                               "k string, yearweek string, qty double")
    for out in (aggs.stats_on_rows(df, ["k"], "qty"), windows.partition_mean(df, ["k"], "qty"),
                windows.partition_ratio_exact(df, ["k"], "qty"),
                seasonality.simple_seasonality(df, ("k",)), seasonality.week_index(df, ("k",)),
                windows.rank_within_groups(df, ["k"], "qty", ["yearweek"])):
        assert out.count() == 3 and out.filter("k is null").count() == 2
    assert rows(windows.partition_ratio_exact(df, ["k"], "qty").filter("k is null"), "avg_qty",
                "ratio") == [(3.0, 0.67), (3.0, 1.33)]
