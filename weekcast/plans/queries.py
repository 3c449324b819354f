"""Registered queries: one per operator group of the workload.

Each query takes ``(spark, sf_dir)``, reads the provided tables through
``datasets`` and returns a DataFrame; nothing is collected.  Derived doubles
are rounded to 6 places at the very end (presentation only) so results can
be compared with an independent engine; integer hundredths are used where
two-place rounding is part of the semantics.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weekcast.functions import calendar as cal
from weekcast.functions import scalar as sc
from weekcast.operators import aggs, clean, cluster, forecast, joins, promo, seasonality, series, tiles
from weekcast.operators import windows as win
from weekcast.plans import datasets as ds
from weekcast.plans import flows
from weekcast.sources import files, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r6(c: str | Column, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, 6).alias(name or (c if isinstance(c, str) else None))


# --------------------------------------------------------------------------- seasonality

@register
def seasonality_robust(spark, sf_dir):
    s = seasonality.robust_seasonality(ds.weekly_sales(spark, sf_dir))
    return s.select("regionid", "product", "yearweek", "qty",
                    *[r6(c) for c in ("ma", "stddev", "upper_bound", "lower_bound", "refined",
                                      "smoothed", "seasonality_stable",
                                      "seasonality_unstable")])


@register
def seasonality_robust_region(spark, sf_dir):
    """The three chained frames by region alone (W5-W7): five hot keys, blocks with a halo."""
    s = seasonality.robust_seasonality(ds.weekly_sales(spark, sf_dir), ["regionid"],
                                       tiebreak=["product"], block_rows=win.BLOCK_ROWS)
    return s.select("regionid", "product", "yearweek", "qty",
                    *[r6(c) for c in ("ma", "stddev", "upper_bound", "lower_bound", "refined",
                                      "smoothed", "seasonality_stable",
                                      "seasonality_unstable")])


@register
def seasonality_profile(spark, sf_dir):
    s = seasonality.robust_seasonality(ds.weekly_sales(spark, sf_dir))
    p = seasonality.seasonality_profile(s, by_qty=True)
    return p.select("regionid", "product", "qty", "week", r6("seasonality_stable"),
                    r6("seasonality_unstable"))


@register
def seasonality_profile_by_week(spark, sf_dir):
    s = seasonality.robust_seasonality(ds.weekly_sales(spark, sf_dir))
    p = seasonality.seasonality_profile(s, by_qty=False)
    return p.select("regionid", "product", "week", r6("seasonality_stable"),
                    r6("seasonality_unstable"))


@register
def seasonality_forecast(spark, sf_dir):
    s = seasonality.robust_seasonality(ds.weekly_sales(spark, sf_dir))
    f = seasonality.seasonality_forecast(seasonality.seasonality_profile(s, by_qty=True))
    return f.select("regionid", "product", "qty", "week", r6("seasonality_stable"),
                    r6("forecast_qty"))


# --------------------------------------------------------------------------- calendar

@register
def week_arith(spark, sf_dir):
    w = ds.weekly_sales(spark, sf_dir).select("yearweek").distinct()
    return w.select("yearweek",
                    cal.week_add("yearweek", 1).alias("next_week"),
                    cal.week_add("yearweek", -20).alias("minus_20"),
                    cal.week_add("yearweek", 53).alias("plus_53"),
                    cal.week_add("yearweek", 110).alias("plus_110"),
                    cal.weeks_in_year(cal.year_of("yearweek")).alias("weeks_in_year"),
                    cal.monday("yearweek").alias("monday"),
                    cal.weeks_between("yearweek", F.lit("200101")).alias("weeks_to_200101"))


# --------------------------------------------------------------------------- cleaning (F*, X*)

@register
def clean_volume(spark, sf_dir):
    # the year filter also bounds the ship date at the scan (row-group skipping)
    ws = ds.weekly_sales(spark, sf_dir, since=cal.first_monday(1996))
    f = ws.filter(clean.conjunction(F.col("product").isin("Brand#1", "Brand#2", "Brand#3"),
                                    F.col("qty") > 10))
    f = clean.from_year(clean.valid_week(f, "yearweek", 52), "yearweek", 1996)
    f = clean.clamp_column(f, "qty", 20.0, 100.0)
    return f.select(F.concat("regionid", "product").alias("key"), "regionid", "product",
                    "yearweek", "qty")


@register
def raw_week_check(spark, sf_dir):
    raw = ds.sellout_raw(spark, sf_dir)
    wk = F.substring("yearweek", 5, 2).try_cast("int")
    return raw.select("regionid", "productgroup", "yearweek",
                      clean.key_length_ok("yearweek", 6).alias("len_ok"),
                      (F.length("yearweek") <= 6).alias("not_too_long"),
                      (clean.key_length_ok("yearweek", 6) & (wk <= 52)).alias("week_ok"))


@register
def null_report(spark, sf_dir):
    raw = ds.sellout_raw(spark, sf_dir)
    r = clean.rows_with_nulls(raw, ["volume", "target"])
    return r.select("regionid", "productgroup", "yearweek", "volume", "target",
                    clean.null_at_position(raw, -2).alias("volume_is_null"))


@register
def null_fill(spark, sf_dir):
    return clean.fill_nulls(ds.sellout_raw(spark, sf_dir), "0")


@register
def any_null_rows(spark, sf_dir):
    """Rows with a NULL in any column (F3), without naming the columns."""
    return clean.rows_with_nulls(ds.sellout_raw(spark, sf_dir))


@register
def typed_view(spark, sf_dir):
    """The raw strings as typed columns; what is no number becomes NULL (P3, X8), then a
    numeric fill of one named column (F21)."""
    t = files.typed(ds.sellout_raw(spark, sf_dir), ds.SELLOUT_TYPES)
    return clean.fill_nulls(t, 0.0, ["target"])


@register
def reject_report(spark, sf_dir):
    """Raw rows that do not convert, with the reasons."""
    return files.rejects(ds.sellout_raw(spark, sf_dir), ds.SELLOUT_TYPES, ("yearweek",)) \
        .withColumnRenamed("_reject_reason", "reason")


@register
def week_validity(spark, sf_dir):
    """Raw week keys and the Monday they name, NULL where they name none."""
    raw = ds.sellout_raw(spark, sf_dir).select("yearweek").distinct()
    padded = F.concat(F.substring("yearweek", 1, 4), F.lit("53"))
    return raw.select("yearweek", cal.valid_yearweek("yearweek").alias("valid"),
                      cal.monday("yearweek").alias("monday"),
                      cal.week_add("yearweek", 1).alias("next_week"),
                      cal.monday(padded).alias("monday_of_week_53"))


@register
def csv_roundtrip(spark, sf_dir):
    """Weekly sales written as CSV with other names and column order into the stage folder,
    read back by header name and typed (S1, S2, K1)."""
    ws = ds.weekly_sales(spark, sf_dir).select(
        F.col("qty").alias("QTY"), F.lit("x").alias("EXTRA"), F.col("yearweek").alias("YEARWEEK"),
        F.col("product").alias("PRODUCT"), F.col("regionid").alias("REGIONID"))
    path = sinks.stage_path(spark, "csv_roundtrip")
    sinks.write_csv(ws, path, sep=";")
    back = files.typed(files.load_csv(spark, path, "sellout", sep=";"), "sellout")
    return back.toDF("regionid", "product", "yearweek", "qty")


CORRECTED_YEAR, WITHDRAWN_WEEK = "1998", "199830"


@register
def weekly_sink(spark, sf_dir):
    """A weekly table that is written, corrected, extended and re-run (K1, K4).

    History up to 1999; a correction of 1998 that doubles the quantities and withdraws a week;
    the later weeks; then the last two deliveries once more, which must change nothing.
    """
    ws = sinks.materialize(ds.weekly_sales(spark, sf_dir), "weekly_sales")
    path = sinks.stage_path(spark, "weekly_sink")
    fixed = ws.filter(F.col("yearweek").startswith(CORRECTED_YEAR) & (F.col("yearweek") != WITHDRAWN_WEEK)) \
        .withColumn("qty", F.col("qty") * 2)
    weeks = [f"{CORRECTED_YEAR}{w:02d}" for w in range(1, 54)]
    later = ws.filter(F.col("yearweek") >= "200001")
    sinks.write_weeks(ws.filter(F.col("yearweek") < "200001"), path)
    for _ in range(2):
        sinks.write_weeks(fixed, path, weeks=weeks)
        sinks.write_weeks(later, path)
    return sinks.read_weeks(spark, path).select("regionid", "product", "yearweek", "qty")


@register
def recent_weeks(spark, sf_dir):
    """The last 20 weeks before the last one, read from a weekly table by a one-row bound on
    its partitions (F15)."""
    path = sinks.stage_path(spark, "sales_by_week")
    sinks.write_weeks(ds.weekly_sales(spark, sf_dir), path)
    return sinks.read_weeks(spark, path, last=20).select("regionid", "product", "yearweek", "qty")


@register
def complete_rows(spark, sf_dir):
    return clean.rows_without_nulls(ds.sellout_raw(spark, sf_dir))


@register
def clamp_variants(spark, sf_dir):
    ws = ds.weekly_sales(spark, sf_dir)
    return ws.select("regionid", "product", "yearweek", "qty",
                     sc.clamp_upper("qty", 100.0).alias("qty_cap"),
                     sc.clamp_lower("qty", 20.0).alias("qty_floor"),
                     sc.clamp("qty", 20.0, 100.0).alias("qty_clamped"),
                     (F.col("qty") * 1.2).alias("qty_x12"))


# --------------------------------------------------------------------------- joins

def _master_join(spark, sf_dir, how):
    j = joins.join_master(ds.weekly_sales(spark, sf_dir), ds.region_master(spark, sf_dir),
                          "regionid", "regionid", how, ["regionname"])
    return j.select("regionname", "regionid", "product", "yearweek", "qty")


@register
def region_join_inner(spark, sf_dir):
    return _master_join(spark, sf_dir, "inner")


@register
def region_join_left(spark, sf_dir):
    return _master_join(spark, sf_dir, "left")


@register
def region_join_right(spark, sf_dir):
    return _master_join(spark, sf_dir, "right")


# --------------------------------------------------------------------------- joins

def _volume(spark, sf_dir):
    return ds.weekly_sales(spark, sf_dir).select(
        "regionid", F.col("product").alias("productgroup"), "yearweek",
        F.col("qty").alias("volume"))


def _promo_join(spark, sf_dir, how):
    # both sides come from one pass over the lines, written once (a row per region, brand, week)
    base = sinks.materialize(ds.sales_and_returns(spark, sf_dir), "sales_and_returns")
    keys = ["regionid", "productgroup", "yearweek"]
    returned = base.filter("n_returned > 0").select(*keys, "price", "discount")
    j = joins.join_using(base.select(*keys, "volume"), returned, keys, how)
    return j.select("regionid", "productgroup", "yearweek", "volume", "price", "discount",
                    sc.discount_guard("discount", "price").alias("new_discount"))


@register
def promo_join_using_inner(spark, sf_dir):
    return _promo_join(spark, sf_dir, "inner")


@register
def promo_join_using_left(spark, sf_dir):
    return _promo_join(spark, sf_dir, "left")


@register
def discounted_price(spark, sf_dir):
    p = ds.promo_data(spark, sf_dir)
    nd = sc.discount_guard("discount", "price")
    return p.select(F.concat("regionid", "productgroup").alias("key"), "regionid",
                    "productgroup", "yearweek", "price", nd.alias("new_discount"),
                    r6(sc.discounted("price", nd / F.col("price")), "sale_price"))


@register
def promo_price_impute(spark, sf_dir):
    base = sinks.materialize(ds.sales_base(spark, sf_dir), "sales_base")
    p = promo.impute_promo_prices(ds.promotion(spark, sf_dir, base))
    return p.select("regionseg", "salesid", "productgroup", "item", "targetweek", "planweek",
                    r6("map_price"), r6("ir"), r6("pmap"), "pmap10", r6("pro_percent"))


def _sales_promo(spark, sf_dir, base=None):
    """Sales x cleaned promotions (C1 + C2).  Both sides and the plan-week subquery read
    ``base``; it is written once to the checkpoint folder when not given, so the star
    join runs once instead of three times."""
    if base is None:
        base = sinks.materialize(ds.sales_base(spark, sf_dir), "sales_base")
    return flows.sales_with_promotion(ds.sales_detail(spark, sf_dir, base),
                                      ds.promotion(spark, sf_dir, base))


@register
def promo_flag(spark, sf_dir):
    s = _sales_promo(spark, sf_dir)
    return s.select(*[r6(c) if c in ("map_price", "ir", "pmap", "pro_percent") else F.col(c)
                      for c in s.columns])


@register
def promo_lookup(spark, sf_dir):
    r = promo.promo_percent_lookup(ds.sellout(spark, sf_dir), ds.account_promo(spark, sf_dir))
    return r.select("regionid", "accountid", "yearweek", "qty", "pro_percent")


@register
def promo_fanout(spark, sf_dir):
    r = promo.promo_percent_fanout(ds.sellout(spark, sf_dir), ds.account_promo(spark, sf_dir))
    return r.orderBy("regionid", "accountid", "yearweek")


@register
def payer_fanout(spark, sf_dir):
    """Every promotion of a payer's quarter on every sell-out row of it (J7, C14 kept whole).

    One payer holds a segment's accounts, hot on both sides: its rows meet in tiles.  A sell-out
    row meets every different promotion of its quarter; equal ones count by their number, as
    the pairs of rows grow with the square of the segment.  Reported by region and quarter.
    """
    sold = ds.payer_sellout(spark, sf_dir).select("payer", "quarter", "regionid", "qty")  # it is stored
    j = tiles.tiled_join(sold, ds.payer_promo(spark, sf_dir), ["payer", "quarter"], how="left", times="times")
    percent, qty = F.col("percent"), F.col("qty") * F.col("times")
    return j.groupBy("regionid", "quarter").agg(
        F.sum("times").alias("n_rows"),
        F.sum(F.when(percent.isNull(), 0).otherwise(F.col("times"))).alias("n_pairs"),
        F.sum(F.when(percent.isNull(), qty)).alias("qty_unmatched"),
        F.sum(qty * percent).alias("qty_percent"))


@register
def promo_flag_bucketed(spark, sf_dir):
    """``promo_flag`` over stage tables bucketed and sorted by the join's keys: the join has no
    exchange, and neither would any later one by these keys (K5, J6)."""
    base = sinks.materialize(ds.sales_base(spark, sf_dir), "sales_base")
    sales = sinks.bucketed(ds.sales_detail(spark, sf_dir, base), "sales_by_item",
                           ["regionseg1", "productseg2", "regionseg2", "productseg3", "yearweek"])
    plans = sinks.bucketed(promo.impute_promo_prices(ds.promotion(spark, sf_dir, base)), "promo_by_item",
                           ["regionseg", "productgroup", "salesid", "item", "targetweek"])
    s = promo.attach_promotion(sales, plans)
    return s.select(*[r6(c) if c in ("map_price", "ir", "pmap", "pro_percent") else F.col(c)
                      for c in s.columns])


def _overlay(spark, sf_dir, pick):
    acc = ds.tax_accounts(spark, sf_dir)
    r = joins.lookup(acc, ds.key_fix(spark, sf_dir), ["suta_tin"], ["suta_tin"], "mata_tin",
                     order=["o_orderdate", "o_orderkey"], default=F.trim(acc.suta_tin),
                     pick=pick, out="updated_suta_tin", trim=True)
    return r.select("suta_tin", "c_name", "c_mktsegment", "updated_suta_tin")


@register
def key_overlay_first(spark, sf_dir):
    return _overlay(spark, sf_dir, "first")


@register
def key_overlay_last(spark, sf_dir):
    return _overlay(spark, sf_dir, "last")


@register
def key_overlay_fanout(spark, sf_dir):
    r = joins.overlay_fanout(ds.tax_accounts(spark, sf_dir), ds.key_fix(spark, sf_dir),
                             "suta_tin", "suta_tin", "mata_tin", out="updated_suta_tin")
    return r.select("updated_suta_tin", "updated_suta_tin_nvl2", "suta_tin", "c_name",
                    "c_mktsegment")


@register
def param_filter(spark, sf_dir):
    # Batch parameters (category, name, value): which regions / products to keep.
    params = spark.createDataFrame(
        [("COMMON", "VALID_REGION", "ASIA"), ("COMMON", "VALID_REGION", "EUROPE"),
         ("COMMON", "VALID_PRODUCT", "Brand#7")], "CATEGORY string, NAME string, VALUE string")
    return clean.params_filter(ds.weekly_sales(spark, sf_dir), params, "regionid", "product")


@register
def param_filter_all(spark, sf_dir):
    """``ALL`` and a missing parameter match everything (F13): the region set holds ALL, the
    product set is not given, and both must hold."""
    params = spark.createDataFrame([("COMMON", "VALID_REGION", "ALL"),
                                    ("OTHER", "VALID_PRODUCT", "Brand#7")],
                                   "CATEGORY string, NAME string, VALUE string")
    return clean.params_filter(ds.weekly_sales(spark, sf_dir), params, "regionid", "product",
                               combine="and")


@register
def account_by_key(spark, sf_dir):
    """Point lookup of a keyed result (K9): the filter reaches the scan."""
    return joins.by_key(ds.account_promo(spark, sf_dir), {"accountid": "7"}) \
        .select("accountid", "yearweek", "pro_percent", "o_orderkey")


@register
def account_lookup(spark, sf_dir):
    """Point lookup in a keyed stage of a join's result (K9): the sell-out of one account."""
    stage = sinks.keyed(ds.sellout(spark, sf_dir), "sellout_by_account", "accountid")
    return joins.by_key(stage, {"accountid": "7"})


@register
def sql_view(spark, sf_dir):
    """A named view queried with SQL."""
    ds.weekly_sales(spark, sf_dir).createOrReplaceTempView("weekly_sales_view")
    return spark.sql("""SELECT regionid, yearweek, sum(qty) AS qty, count(*) AS products
                        FROM weekly_sales_view GROUP BY regionid, yearweek""")


# ------------------------------------------------------------------- NULL keys are groups

def _by_name(spark, sf_dir):
    """Weekly sales with the region's name: the master lacks a region, so names are NULL."""
    return _master_join(spark, sf_dir, "left").select("regionname", "product", "yearweek", "qty")


@register
def null_key_stats(spark, sf_dir):
    r = aggs.stats_on_rows(_by_name(spark, sf_dir), ["regionname"], "qty")
    return r.select("regionname", "product", "yearweek", "qty", "cnt", "sum", r6("mean"),
                    r6("stddev"))


@register
def null_key_ratio(spark, sf_dir):
    r = win.partition_ratio(_by_name(spark, sf_dir), ["regionname"], "qty")
    return r.select("regionname", "product", "yearweek", "qty", r6("avg_qty"), r6("ratio"))


@register
def null_key_seasonality(spark, sf_dir):
    r = seasonality.simple_seasonality(_by_name(spark, sf_dir), ("regionname",))
    return r.select("regionname", "product", "yearweek", "qty", "avg_qty", "ratio")


@register
def null_key_week_index(spark, sf_dir):
    r = seasonality.week_index(_by_name(spark, sf_dir), ["regionname"])
    return r.select("yearweek", "regionname", "week_qty", r6("mean_week_qty"), r6("ratio"))


@register
def null_key_clusters(spark, sf_dir):
    c = cluster.item_clusters(sinks.materialize(_by_name(spark, sf_dir), "sales_named"),
                              ("regionname",), "product")
    return c.select("regionname", "product", "sum_qty", "rank", r6("ratio"), "cluster")


# --------------------------------------------------------------------------- aggregates (A*)

@register
def avg_by_key(spark, sf_dir):
    return aggs.mean_by_key(ds.weekly_sales(spark, sf_dir), ["regionid", "product"], "qty") \
        .select("regionid", "product", r6("avg_qty"))


@register
def sum_by_key(spark, sf_dir):
    return aggs.sum_by_key(ds.sales_detail(spark, sf_dir),
                           ["regionseg1", "productseg2", "productseg3"], "qty")


@register
def count_avg(spark, sf_dir):
    r = aggs.count_mean_by_key(ds.weekly_sales(spark, sf_dir), ["regionid", "product"], "qty")
    return r.select("regionid", "product", "cnt", r6("mean"))


@register
def global_minmax(spark, sf_dir):
    ws = ds.weekly_sales(spark, sf_dir).withColumn("yearweek", F.col("yearweek").cast("int"))
    weeks = aggs.min_max(ws, "yearweek", also=("qty",))
    return weeks.select(cal.yearweek_str("min_yearweek").alias("min_yearweek"),
                        cal.yearweek_str("max_yearweek").alias("max_yearweek"), "min_qty",
                        "max_qty")


@register
def group_minmax(spark, sf_dir):
    ws = ds.weekly_sales(spark, sf_dir).withColumn("yearweek", F.col("yearweek").cast("int"))
    weeks = aggs.min_max(ws, "yearweek", ["regionid", "product"])
    return weeks.select("regionid", "product",
                        cal.yearweek_str("min_yearweek").alias("min_yearweek"),
                        cal.yearweek_str("max_yearweek").alias("max_yearweek"))


@register
def group_stats(spark, sf_dir):
    r = aggs.stats_on_rows(ds.weekly_sales(spark, sf_dir), ["regionid", "product"], "qty")
    return r.select("regionid", "product", "yearweek", "qty", "cnt", "sum", r6("mean"),
                    r6("stddev"))


@register
def stats_grouping_sets(spark, sf_dir):
    """The statistics by key, by region, by product and in total from one scan."""
    r = aggs.stats_by_sets(ds.weekly_sales(spark, sf_dir), ["regionid", "product"],
                           [["regionid", "product"], ["regionid"], ["product"], []], "qty")
    return r.select("regionid", "product", "level", "cnt", "sum", r6("mean"), r6("stddev"))


@register
def nonzero_mean(spark, sf_dir):
    base = ds.sales_base(spark, sf_dir)
    r = aggs.nonzero_mean(ds.promotion(spark, sf_dir, base), ["productgroup", "item"], "map_price")
    return r.select("productgroup", "item", r6("nz_mean"))


@register
def distinct_totals(spark, sf_dir):
    return ds.sales_detail(spark, sf_dir).select("regionseg1", "productseg2").distinct()


@register
def mean_of_sums(spark, sf_dir):
    r = aggs.mean_of_sums(ds.sales_detail(spark, sf_dir), ["regionseg1", "productseg2"],
                          "yearweek", "qty")
    return r.select("regionseg1", "productseg2", r6("mean_of_sums"), "n_yearweek")


@register
def week_index(spark, sf_dir):
    r = seasonality.week_index(ds.sales_detail(spark, sf_dir), ["regionseg1", "productseg2"])
    return r.select("yearweek", "regionseg1", "productseg2", "week_qty", r6("mean_week_qty"),
                    r6("ratio"))


@register
def pivot_weeks(spark, sf_dir):
    return aggs.pivot_sum(ds.weekly_sales(spark, sf_dir), ["regionid", "product"], "yearweek",
                          ["199801", "199802"], "qty")


# --------------------------------------------------------------------------- windows (W*, O*)

@register
def partition_ratio(spark, sf_dir):
    ws = ds.weekly_sales(spark, sf_dir, since=cal.first_monday(1996))
    f = clean.drop_week(clean.from_year(ws, "yearweek", 1996), "yearweek", 53) \
        .filter(F.col("product").isin("Brand#1", "Brand#2"))
    r = win.partition_ratio_exact(f, ["regionid", "product"], "qty")
    return r.select("regionid", "product", "yearweek", "qty", "avg_qty", "ratio")


@register
def partition_ratio_net(spark, sf_dir):
    """Two-place mean and ratio of a fractional measure (W2, X13): each line's net quantity."""
    f = ds.line_facts(spark, sf_dir).select(
        F.col("r_name").alias("regionid"), F.col("p_brand").alias("product"), "l_orderkey",
        (F.col("l_quantity") * (1 - F.col("l_discount"))).alias("net"))
    r = win.partition_ratio_exact(f, ["regionid", "product"], "net", "avg_net", "ratio")
    return r.groupBy("regionid", "product", "avg_net", "ratio").agg(F.count(F.lit(1)).alias("n"))


@register
def moving_avg_3(spark, sf_dir):
    r = win.moving_avg(ds.weekly_sales(spark, sf_dir), ["regionid", "product"], ["yearweek"],
                       "qty", 3, "mv_avg")
    return r.select("regionid", "product", "yearweek", "qty", r6("mv_avg"))


@register
def moving_avg_5(spark, sf_dir):
    r = win.moving_avg(ds.weekly_sales(spark, sf_dir), ["regionid", "product"], ["yearweek"],
                       "qty", 5, "mv_avg")
    return r.select("regionid", "product", "yearweek", "qty", r6("mv_avg"))


@register
def moving_avg_coarse(spark, sf_dir):
    """Moving means over coarser partitions than the series (W3 by region; W4 by two of the
    three keys), in a total order.  A region holds a fifth of all rows or more, so the frames
    are taken in blocks of rows with a halo."""
    s = ds.sales_detail(spark, sf_dir).groupBy("regionseg1", "productseg2", "productseg3",
                                               "yearweek").agg(F.sum("qty").alias("qty"))
    r = win.moving_avg(s, ["regionseg1"], ["productseg2", "productseg3", "yearweek"], "qty", 3,
                       "mv_region", block_rows=win.BLOCK_ROWS)
    r = win.moving_avg(r, ["regionseg1", "productseg2"], ["yearweek", "productseg3"], "qty", 5,
                       "mv_type", block_rows=win.BLOCK_ROWS)
    return r.select("regionseg1", "productseg2", "productseg3", "yearweek", "qty",
                    r6("mv_region"), r6("mv_type"))


@register
def group_position(spark, sf_dir):
    return win.position_in_group(ds.weekly_sales(spark, sf_dir), ["regionid", "product"],
                                 ["yearweek"], "pos")


@register
def sort_mixed(spark, sf_dir):
    ws = ds.weekly_sales(spark, sf_dir).filter(clean.conjunction(F.col("qty") > 30))
    return ws.select(F.concat("regionid", "product").alias("key"), "regionid", "product",
                     "yearweek", "qty") \
             .orderBy(F.col("regionid").asc(), F.col("product").desc(), F.col("yearweek").asc())


@register
def first_match(spark, sf_dir):
    ws = ds.weekly_sales(spark, sf_dir)
    return ws.filter((F.col("product") == "Brand#7") & (F.col("qty") > 40)) \
             .orderBy("yearweek", "regionid").limit(1)


@register
def top_n(spark, sf_dir):
    s = aggs.sum_by_key(ds.weekly_sales(spark, sf_dir), ["regionid", "product"], "qty")
    t = win.top_n(s, ["regionid"], "sum_qty", ["product"], 3)
    return t.select("regionid", "product", "sum_qty")


# --------------------------------------------------------------------------- series

SEG6 = ["regionseg1", "productseg1", "productseg2", "regionseg2", "regionseg3", "productseg3"]
SEG5 = flows.SEG5


def _key_summary(df, keys, flag_col=None):
    aggs_ = [F.count(F.lit(1)).alias("n_rows"), F.sum("qty").alias("sum_qty"),
             F.count(F.when(F.col("qty") == 0, 1)).alias("n_zero"),
             cal.yearweek_str(F.min(F.col("yearweek").cast("int"))).alias("min_week"),
             cal.yearweek_str(F.max(F.col("yearweek").cast("int"))).alias("max_week")]
    if flag_col:
        aggs_.append(F.count(F.when(F.col(flag_col) == "N", 1)).alias("n_flag_n"))
    return df.groupBy(*keys).agg(*aggs_)


@register
def fill_weeks_6key(spark, sf_dir):
    f = series.fill_weeks(ds.sales_detail(spark, sf_dir), SEG6, fill={"qty": 0.0},
                          derived=series.week_parts())
    return _key_summary(f, SEG6)


def _filled5(spark, sf_dir):
    return series.fill_weeks(_sales_promo(spark, sf_dir), SEG5, fill=flows.PROMO_FILL,
                             derived=series.week_parts())


@register
def fill_weeks_5key(spark, sf_dir):
    return _key_summary(_filled5(spark, sf_dir), SEG5, "promotion_check")


@register
def future_weeks(spark, sf_dir):
    return series.extend_weeks(ds.weekly_sales(spark, sf_dir), ["regionid", "product"], 4,
                               fill={"qty": 0.0}, only_new=True)


@register
def history_and_future_weeks(spark, sf_dir):
    """The series followed by its coming weeks (U1: bag union of old and new rows)."""
    return series.extend_weeks(ds.weekly_sales(spark, sf_dir), ["regionid", "product"], 4,
                               fill={"qty": 0.0})


@register
def filled_weeks(spark, sf_dir):
    """Every row of a gap-filled series by region and type, one row a week."""
    keys = ["regionseg1", "productseg2", "productseg3"]
    s = ds.sales_detail(spark, sf_dir).groupBy(*keys, "yearweek", "year", "week").agg(
        F.sum("qty").alias("qty")).withColumn("promotion_check", F.lit("Y"))
    return series.fill_weeks(s, keys, fill={"qty": 0.0, "promotion_check": "N"},
                             derived=series.week_parts())


def _ratio_series(spark, sf_dir, ws=None):
    ws = ws if ws is not None else ds.weekly_sales(spark, sf_dir)
    f = series.fill_weeks(ws, ["regionid", "product"], fill={"qty": 0.0})
    return series.moving_ratio(f, ["regionid", "product"], ["yearweek"], "qty", 5)


@register
def seasonality_ratio(spark, sf_dir):
    r = _ratio_series(spark, sf_dir)
    return r.select("regionid", "product", "yearweek", "qty", r6("moving_avg"),
                    r6("seasonality"))


@register
def active_items(spark, sf_dir):
    # read twice (global last week, the series): the star join runs once
    return series.active_keys(sinks.materialize(ds.sales_detail(spark, sf_dir), "sales"), SEG5)


# --------------------------------------------------------------------------- clusters

@register
def item_clusters(spark, sf_dir):
    # only the weeks that count are joined; read twice (last week, recent sums), so staged
    c = cluster.item_clusters(ds.recent_sales(spark, sf_dir, 20, [
        "regionseg1", "productseg2", "productseg3", "yearweek", "qty"]))
    return c.select("regionseg1", "productseg2", "productseg3", "sum_qty", "rank", r6("ratio"),
                    "cluster")


# --------------------------------------------------------------------------- forecasts

@register
def forecast_mean4(spark, sf_dir):
    keys = ["regionseg1", "regionseg2", "productseg2", "productseg3"]
    sales = ds.recent_sales(spark, sf_dir, 4, [*keys, "yearweek", "qty"])
    f = forecast.mean_recent_forecast(sales, keys, recent=4, horizon=1)
    return f.select(*keys, "fcst_week", r6("fcst"))


@register
def forecast_level_seasonal(spark, sf_dir):
    ws = sinks.materialize(ds.weekly_sales(spark, sf_dir), "weekly_sales")
    last_week = ws.agg(F.max("yearweek").alias("w"))  # the fill adds no later week
    f = forecast.level_seasonal_forecast(_ratio_series(spark, sf_dir, ws), ["regionid", "product"],
                                         fill={"qty": 0.0, "moving_avg": 0.0},
                                         last_week=last_week)
    return f.select("regionid", "product", "yearweek", "qty", r6("moving_avg"),
                    r6("seasonality"), r6("fcst"), r6("fcst_timeseries"))


@register
def forecast_legacy(spark, sf_dir):
    """The forecast rows by the target-week formula as the source script wrote it."""
    ws = sinks.materialize(ds.weekly_sales(spark, sf_dir), "weekly_sales")
    f = forecast.level_seasonal_forecast(_ratio_series(spark, sf_dir, ws), ["regionid", "product"],
                                         fill={"qty": 0.0, "moving_avg": 0.0}, only_new=True,
                                         legacy_week=28)
    return f.select("regionid", "product", "yearweek", r6("seasonality"), r6("fcst"),
                    r6("fcst_timeseries"))


def _demand_forecast(spark, sf_dir, only_new=True):
    base = sinks.materialize(ds.sales_base(spark, sf_dir), "sales_base")
    return flows.demand_forecast_flow(ds.sales_detail(spark, sf_dir, base),
                                      ds.promotion(spark, sf_dir, base), stage=False,
                                      last_week=base.agg(F.max("yearweek").alias("w")),
                                      only_new=only_new)


@register
def demand_forecast(spark, sf_dir):
    """Flagship (E1): promotions -> price imputation -> sales x promotion -> discontinued-item
    filter -> week gap fill -> 5-week moving ratio -> level x seasonality forecast.

    The star join is aggregated once and written to the shared checkpoint
    folder (``sales_base`` feeds sales, promotions and the global last week);
    from there the series steps share one hash partitioning by the 5 keys
    (``flows.demand_forecast_flow``).
    """
    f = _demand_forecast(spark, sf_dir)
    return f.select(*SEG5, "yearweek", "year", "week", "promotion_check", r6("seasonality"),
                    r6("fcst"), r6("fcst_timeseries"))


@register
def demand_forecast_history(spark, sf_dir):
    """The flagship's whole result: the weekly history of the active items and their forecast
    rows, 19 columns (C7, U1)."""
    f = _demand_forecast(spark, sf_dir, only_new=False)
    return f.select(*SEG5, "yearweek", "year", "week", "qty", r6("map_price"), r6("ir"), r6("pmap"),
                    "pmap10", r6("pro_percent"), "promotion_check", r6("moving_avg"),
                    r6("seasonality"), r6("fcst"), r6("fcst_timeseries"))


# ------------------------------------------------------------------- simple seasonality

@register
def seasonality_simple(spark, sf_dir):
    r = seasonality.simple_seasonality(ds.weekly_sales(spark, sf_dir))
    return r.select("regionid", "product", "yearweek", "qty", "avg_qty", "ratio")


@register
def seasonality_simple_profile(spark, sf_dir):
    r = seasonality.simple_seasonality(ds.weekly_sales(spark, sf_dir))
    return seasonality.simple_profile(r)


# --------------------------------------------------------------------------- ML (M1-M7)

from weekcast.operators import ml, text  # noqa: E402

LAST_TRAIN_WEEK = 199952


def _dt_predictions(spark, sf_dir):
    # Each stage fit (two indexers, the tree) reads its input again: write the model input
    # once to the checkpoint folder instead of re-running the star join per fit.
    inp = sinks.materialize(ds.dt_input(spark, sf_dir), "dt_input")
    train, test = ml.split_by_week(inp, "yearweek", LAST_TRAIN_WEEK)
    return ml.fit_predict(ml.decision_tree_model(), train, test)


def _dt_split(spark, sf_dir):
    inp = sinks.materialize(ds.dt_input(spark, sf_dir), "dt_input")
    return ml.split_by_week(inp, "yearweek", LAST_TRAIN_WEEK)


@register
def ml_split(spark, sf_dir):
    """Both sides of the time split."""
    train, test = _dt_split(spark, sf_dir)
    cols = ["regionid", "product", "yearweek", "qty"]
    return train.select(F.lit("train").alias("side"), *cols).unionByName(
        test.select(F.lit("test").alias("side"), *cols))


@register
def ml_category_index(spark, sf_dir):
    """Indices of the categories by falling frequency (M1)."""
    train, _ = _dt_split(spark, sf_dir)
    return ml.category_index(train, ["holiday", "promotion"])


def _shipped_parts(spark, sf_dir):
    f = ds.line_facts(spark, sf_dir).select("l_partkey", cal.yearweek_int("l_shipdate").alias("yearweek"))
    return f.filter(F.col("yearweek") < FIRST_PARTS_UNTIL), f.filter(F.col("yearweek") >= FIRST_PARTS_UNTIL)


#: Parts are indexed by the lines shipped before this week; later lines have parts it lacks.
FIRST_PARTS_UNTIL = 199601


@register
def ml_part_index(spark, sf_dir):
    """The index of a column with as many categories as there are parts (M1)."""
    train, _ = _shipped_parts(spark, sf_dir)
    return ml.category_index(train, ["l_partkey"])


@register
def ml_part_codes(spark, sf_dir):
    """Later lines by the index of their part; parts without one share the next number (M1, M2)."""
    train, test = _shipped_parts(spark, sf_dir)
    index = sinks.materialize(ml.category_index(train, ["l_partkey"]), "part_index")
    coded = ml.encode_categories(test, index, ["l_partkey"])
    return coded.groupBy("l_partkey_in").agg(F.count(F.lit(1)).alias("n"),
                                             F.countDistinct("l_partkey").alias("n_parts"))


@register
def ml_features(spark, sf_dir):
    """The feature vectors of the test rows (M2, M4)."""
    train, test = _dt_split(spark, sf_dir)
    stages = ml.decision_tree_model().getStages()[:-1]
    out = Pipeline(stages=stages).fit(train).transform(test)
    v = vector_to_array("features")
    return out.select("regionid", "product", "yearweek", v[0].alias("holiday_in"),
                      v[1].alias("promotion_in"), v[2].alias("pro_percent"))


@register
def ml_mean_predictor(spark, sf_dir):
    """RMSE and MAE of the mean of each category (M5)."""
    train, test = _dt_split(spark, sf_dir)
    m = ml.regression_metrics(ml.mean_by_category(train, test, ["holiday", "promotion"]))
    return m.select(r6("rmse"), r6("mae"), "n")


@register
def dt_leaf_means(spark, sf_dir):
    """Every leaf of the tree predicts the mean of its training rows (M3)."""
    train, _ = _dt_split(spark, sf_dir)
    return ml.leaf_violations(ml.fit_predict(ml.decision_tree_model(), train, train))


@register
def kmeans_nearest(spark, sf_dir):
    """Every row of the segmentation sits with its nearest centre (M6)."""
    inp = sinks.materialize(ds.student_like(spark, sf_dir), "kmeans_input")
    return ml.centre_violations(inp, ["sw", "db", "and"], k=2)


@register
def dt_regression(spark, sf_dir):
    p = _dt_predictions(spark, sf_dir)
    return p.select("regionid", "product", "yearweek", "holiday", "promotion", "pro_percent",
                    "qty", "prediction").orderBy("yearweek")


def _exact_tree_predictions(spark, sf_dir):
    """A tree of depth 3 over percentages in whole hundredths: few enough values that every
    threshold is tried, so the tree is the exact greedy one."""
    inp = ds.dt_input(spark, sf_dir).withColumn("pro_percent", F.floor(F.col("pro_percent") * 100) / 100.0)
    train, test = ml.split_by_week(sinks.materialize(inp, "dt_input"), "yearweek", LAST_TRAIN_WEEK)
    return ml.fit_predict(ml.decision_tree_model(max_depth=3, max_bins=256), train, test)


@register
def dt_exact(spark, sf_dir):
    """Predictions of the exact greedy tree."""
    p = _exact_tree_predictions(spark, sf_dir)
    return p.select("regionid", "product", "yearweek", "qty", r6("prediction"))


@register
def dt_exact_metrics(spark, sf_dir):
    """RMSE and MAE of the exact greedy tree (M5)."""
    m = ml.regression_metrics(_exact_tree_predictions(spark, sf_dir))
    return m.select(r6("rmse"), r6("mae"), "n")


@register
def kmeans_lloyd(spark, sf_dir):
    """Segments after ten rounds from fixed starting rows."""
    inp = sinks.materialize(ds.student_like(spark, sf_dir), "kmeans_input")
    s = ml.lloyd_segments(inp, "c_custkey", ["sw", "db", "and"], k=2, rounds=10)
    return s.select("c_custkey", "prediction")


@register
def dt_metrics(spark, sf_dir):
    return ml.regression_metrics(_dt_predictions(spark, sf_dir))


@register
def kmeans_segments(spark, sf_dir):
    inp = sinks.materialize(ds.student_like(spark, sf_dir), "kmeans_input")
    return ml.kmeans_segments(inp, ["sw", "db", "and"], k=2)


# --------------------------------------------------------------------------- page lines

@register
def page_lines(spark, sf_dir):
    from weekcast.sources.tables import load
    pages = load(spark, sf_dir, "pages", ["page_id", "url", "html"])
    t = text.normalise_lines(pages, "html", "text")
    return t.select("page_id", "url", "n_lines", F.length("text").alias("n_chars"))


# ------------------------------------------------------------------- set ops, renames, sorts

@register
def missing_weeks(spark, sf_dir):
    """Expected weeks (each key's calendar from first to last week) minus present weeks
    (J13, U2): the rows a gap fill adds, found by an anti join."""
    ws = sinks.materialize(ds.weekly_sales(spark, sf_dir), "weekly_sales")  # both sides read it
    keys = ["regionid", "product"]
    b = ws.groupBy(*keys).agg(F.min(cal.monday("yearweek")).alias("mn"),
                              F.max(cal.monday("yearweek")).alias("mx"))
    calendar = b.select(*keys, F.explode(cal.week_sequence("mn", "mx")).alias("_wk")) \
                .select(*keys, cal.yearweek("_wk").alias("yearweek"))
    return joins.missing_from(calendar, ws, [*keys, "yearweek"])


@register
def sales_sorted(spark, sf_dir):
    """Rename every column (P4) and sort by a multi-column key (O1, O3)."""
    s = ds.sales_detail(spark, sf_dir).toDF(
        "REGIONSEG1", "PRODUCTSEG1", "PRODUCTSEG2", "REGIONSEG2", "REGIONSEG3", "PRODUCTSEG3",
        "YEARWEEK", "YEAR", "WEEK", "QTY")
    return s.orderBy("PRODUCTSEG2", "REGIONSEG3", "PRODUCTSEG3", "YEARWEEK", "REGIONSEG1",
                     "PRODUCTSEG1", "REGIONSEG2")


@register
def pivot_measures(spark, sf_dir):
    """Measures held as rows (REAL_QTY / PREDICTION_QTY, the moving-average level) pivoted
    back to columns with the values given (A15)."""
    r = _ratio_series(spark, sf_dir).select("regionid", "product", "yearweek",
                                            F.col("qty").alias("REAL_QTY"),
                                            F.col("moving_avg").alias("PREDICTION_QTY"))
    long = r.unpivot(["regionid", "product", "yearweek"], ["REAL_QTY", "PREDICTION_QTY"],
                     "measure", "sales")
    p = aggs.pivot_sum(long, ["regionid", "product", "yearweek"], "measure",
                       ["REAL_QTY", "PREDICTION_QTY"], "sales")
    return p.select("regionid", "product", "yearweek", "REAL_QTY", r6("PREDICTION_QTY"))
