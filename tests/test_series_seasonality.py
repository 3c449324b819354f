from pyspark.sql import functions as F

from support import rows
from weekcast.functions import calendar as cal
from weekcast.operators import cluster, forecast, promo, seasonality, series, windows


def test_gap_fill_fixture(spark):
    df = spark.createDataFrame([("A", "201552", 5.0), ("A", "201602", 7.0), ("B", "201601", 1.0)],
                               "k string, yearweek string, qty double")
    out = series.fill_weeks(df, ["k"], fill={"qty": 0.0})
    assert rows(out) == [("A", "201552", 5.0), ("A", "201553", 0.0), ("A", "201601", 0.0),
                         ("A", "201602", 7.0), ("B", "201601", 1.0)]


def test_gap_fill_properties(spark):
    import random
    rnd = random.Random(3)
    data = []
    for k in "abcdef":
        for w in rnd.sample(range(1, 53), 12):
            yw = f"{rnd.choice([2015, 2016])}{w:02d}"
            data.append((k, yw, float(rnd.randint(1, 9))))
            if rnd.random() < 0.2:
                data.append((k, yw, 1.0))  # duplicates are kept
    df = spark.createDataFrame(data, "k string, yearweek string, qty double") \
        .withColumn("year", F.lit(None).cast("int")).withColumn("week", F.lit(None).cast("int"))
    out = series.fill_weeks(df, ["k"], fill={"qty": 0.0}, derived=series.week_parts())
    # sum preserved, duplicates kept, every key contiguous, idempotent
    assert out.agg(F.sum("qty")).first()[0] == df.agg(F.sum("qty")).first()[0]
    assert out.filter("qty > 0").count() == df.count()
    spans = out.groupBy("k").agg(F.countDistinct("yearweek").alias("n"),
                                 cal.weeks_between(F.min("yearweek"), F.max("yearweek"))
                                 .alias("span"))
    assert all(r.n == r.span + 1 for r in spans.collect())
    again = series.fill_weeks(out, ["k"], fill={"qty": 0.0}, derived=series.week_parts())
    assert again.count() == out.count()
    assert out.filter("qty = 0").filter(F.col("year").isNull()).count() == 0


def test_extend_weeks(spark):
    df = spark.createDataFrame([("A", "201551"), ("B", "201553")], "k string, yearweek string")
    new = series.extend_weeks(df, ["k"], 2, only_new=True)
    assert rows(new) == [("A", "201552"), ("A", "201553"), ("A", "201601"), ("A", "201602"),
                         ("B", "201601"), ("B", "201602")]


def test_moving_average_and_guard(spark):
    df = spark.createDataFrame([("A", "201601", 1.0), ("A", "201602", 2.0), ("A", "201603", 6.0),
                                ("Z", "201601", 0.0)], "k string, yearweek string, qty double")
    out = series.moving_ratio(df, ["k"], ["yearweek"], "qty", 3)
    got = rows(out, "k", "moving_avg", "seasonality")
    assert got == [("A", 1.5, 1.0 / 1.5), ("A", 3.0, 2.0 / 3.0), ("A", 4.0, 1.5),
                   ("Z", 0.0, 1.0)]


def test_robust_one_row_group_is_unclipped(spark):
    df = spark.createDataFrame([("R", "P", "201601", 9.0)],
                               "regionid string, product string, yearweek string, qty double")
    r = seasonality.robust_seasonality(df).first()
    assert r.stddev is None and r.refined == 9.0 and r.seasonality_stable == 1.0


def test_simple_seasonality_hundredths(spark):
    df = spark.createDataFrame([("R", "P", "201601", 1.0), ("R", "P", "201602", 2.0),
                                ("R", "P", "201653", 50.0), ("R", "Q", "201601", 0.0)],
                               "regionid string, product string, yearweek string, qty double")
    r = seasonality.simple_seasonality(df)
    got = rows(r, "product", "yearweek", "avg_qty", "ratio")
    # mean of P is 1.5 -> 2 (half up), week 53 dropped; Q has mean 0 -> ratio 1.0
    assert got == [("P", "201601", 2, 0.5), ("P", "201602", 2, 1.0), ("Q", "201601", 0, 1.0)]
    prof = seasonality.simple_profile(r)
    assert rows(prof, "product", "week", "ratio") == [("P", "01", 0.5), ("P", "02", 1.0),
                                                      ("Q", "01", 1.0)]


def test_clusters_fixture(spark):
    data = [("R", "G", f"I{i}", "201601", float(100 - i)) for i in range(10)]
    df = spark.createDataFrame(data, "regionseg1 string, productseg2 string, "
                                     "productseg3 string, yearweek string, qty double")
    c = cluster.item_clusters(df)
    got = [r.cluster for r in c.orderBy("rank").collect()]
    assert got == [0, 0, 0, 1, 1, 1, 2, 2, 2, 2]


def test_price_imputation(spark):
    schema = ("regionseg string, salesid string, productgroup string, item string, "
              "targetweek string, planweek string, map_price double, ir double")
    df = spark.createDataFrame([("R", "S1", "G", "I", "201601", "201601", 100.0, 30.0),
                                ("R", "S2", "G", "I", "201602", "201601", 0.0, 30.0),
                                ("R", "S3", "G", "I", "201603", "201601", 200.0, 30.0),
                                ("R", "S1", "G", "Z", "201601", "201601", 0.0, 5.0),
                                ("R", "S2", "G", "Z", "201602", "201601", 0.0, 5.0)], schema)
    out = promo.impute_promo_prices(df)
    i = out.filter("item = 'I'").collect()
    assert len(i) == 3
    for r in i:
        assert r.map_price == 150.0 and r.pmap == 120.0 and r.pmap10 == 108
        assert abs(r.pro_percent - 0.28) < 1e-12
    for r in out.filter("item = 'Z'").collect():
        assert (r.map_price, r.ir, r.pmap, r.pmap10, r.pro_percent) == (0.0, 0.0, 0.0, 0, 0.0)


def test_mean_recent_forecast(spark):
    df = spark.createDataFrame([("A", "201550", 100.0), ("A", "201552", 2.0), ("A", "201553", 4.0),
                                ("A", "201601", 6.0), ("B", "201601", 1.0)],
                               "k string, yearweek string, qty double")
    f = forecast.mean_recent_forecast(df, ["k"], recent=4, horizon=2)
    assert rows(f) == [("A", "201602", 4.0), ("A", "201603", 4.0), ("B", "201602", 1.0),
                       ("B", "201603", 1.0)]


def test_level_seasonal_forecast(spark):
    data = [("A", f"2016{w:02d}", float(w), 1.0 + (w == 2)) for w in range(1, 9)]
    df = spark.createDataFrame(data, "k string, yearweek string, qty double, seasonality double")
    f = forecast.level_seasonal_forecast(df, ["k"], horizon=2, fill={"qty": 0.0},
                                         only_new=True)
    got = rows(f, "yearweek", "fcst", "seasonality", "fcst_timeseries")
    # fcst = (5+6+7+8)/4 = 6.5, avg_season = 1; no history for weeks 9, 10 -> target 0
    assert got == [("201609", 6.5, 0.0, 0.0), ("201610", 6.5, 0.0, 0.0)]


def test_top_n_and_position(spark):
    df = spark.createDataFrame([("R", "a", 5.0), ("R", "b", 7.0), ("R", "c", 7.0), ("S", "d", 1.0)],
                               "r string, p string, s double")
    assert rows(windows.top_n(df, ["r"], "s", ["p"], 2), "p") == [("b",), ("c",), ("d",)]
    pos = windows.position_in_group(df, ["r"], ["p"])
    assert rows(pos, "p", "pos") == [("a", 0), ("b", 1), ("c", 2), ("d", 0)]


def test_level_seasonal_forecast_legacy_formula(spark):
    # history weeks 201625..201632 with seasonality 1 except week 28 (=2)
    data = [("A", f"2016{w:02d}", float(w), 2.0 if w == 28 else 1.0) for w in range(25, 33)]
    df = spark.createDataFrame(data, "k string, yearweek string, qty double, seasonality double")
    f = forecast.level_seasonal_forecast(df, ["k"], horizon=1, fill={"qty": 0.0},
                                         only_new=True, legacy_week=28)
    r = f.collect()[0]
    # written formula: sum of all seasonality = 9 (key has week 28); shown = 9 / 4;
    # fcst = (29+30+31+32)/4 = 30.5, avg_season = 1; ts = 30.5 * 9 / 1
    assert (r.yearweek, r.seasonality, r.fcst, r.fcst_timeseries) == ("201633", 2.25, 30.5,
                                                                       274.5)
    no28 = df.filter("yearweek <> '201628'")
    r2 = forecast.level_seasonal_forecast(no28, ["k"], horizon=1, fill={"qty": 0.0},
                                          only_new=True, legacy_week=28).collect()[0]
    assert (r2.seasonality, r2.fcst_timeseries) == (0.0, 0.0)


def test_history_paths_keep_every_input_row(spark):
    df = spark.createDataFrame([("A", "201601", 3.0, 1.0), ("A", "201602", 5.0, 1.0),
                                ("B", "201602", 2.0, 1.0)],
                               "k string, yearweek string, qty double, seasonality double")
    ext = series.extend_weeks(df.select("k", "yearweek", "qty"), ["k"], 1, fill={"qty": 0.0})
    assert rows(ext) == [("A", "201601", 3.0), ("A", "201602", 5.0), ("A", "201603", 0.0),
                         ("B", "201602", 2.0), ("B", "201603", 0.0)]
    f = forecast.level_seasonal_forecast(df, ["k"], horizon=1, fill={"qty": 0.0})
    hist = f.filter(F.col("fcst") == 0).filter(F.col("qty") > 0)
    assert hist.count() == 3  # history rows carry fcst = fcst_timeseries = 0
    assert rows(f.filter("yearweek = '201603'"), "k", "fcst") == [("A", 2.0), ("B", 0.5)]


def test_series_operators_on_upper_case_frames(spark):
    df = spark.createDataFrame([("A", "201552", 5.0), ("A", "201602", 7.0)],
                               "REGIONID string, YEARWEEK string, QTY double")
    out = series.fill_weeks(df, ["regionid"], fill={"qty": 0.0})
    assert rows(out) == [("A", "201552", 5.0), ("A", "201553", 0.0), ("A", "201601", 0.0),
                         ("A", "201602", 7.0)]
    ext = series.extend_weeks(df, ["regionid"], 1, fill={"qty": 0.0}, only_new=True)
    assert rows(ext) == [("A", "201603", 0.0)]
    assert series.active_keys(df, ["regionid"]).count() == 2
    ratio = series.moving_ratio(out, ["regionid"], ["yearweek"], "qty", 3)
    f = forecast.level_seasonal_forecast(ratio, ["regionid"], horizon=1, fill={"qty": 0.0})
    new = f.filter("YEARWEEK = '201603'").first()
    assert (new.REGIONID, new.QTY, new.fcst) == ("A", 0.0, 3.0) and f.count() == 5
    from weekcast.operators import clean
    assert rows(clean.clamp_column(df, "qty", 6.0, None), "QTY") == [(6.0,), (7.0,)]


def test_gap_fill_leaves_rows_without_a_week(spark):
    df = spark.createDataFrame([("A", "201601", 1.0), ("A", "999901x", 2.0), ("A", "201660", 3.0),
                                ("A", "201603", 4.0)], "k string, yearweek string, qty double")
    out = series.fill_weeks(df, ["k"], fill={"qty": 0.0})
    assert rows(out, "yearweek", "qty") == [("201601", 1.0), ("201602", 0.0), ("201603", 4.0),
                                            ("201660", 3.0), ("999901x", 2.0)]
