"""The demand forecast flow on CSV files in the workload's layouts, as a user would run it."""

from pyspark.sql import functions as F

from support import SF_SMALL, rows
from weekcast.operators import clean
from weekcast.plans import datasets as ds
from weekcast.plans import flows
from weekcast.plans.queries import QUERIES
from weekcast.sources import files, sinks


def _round(df, cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


def test_flow_on_csv_layouts_matches_the_registered_query(spark, tmp_path):
    base = ds.sales_base(spark, SF_SMALL)
    sales = ds.sales_detail(spark, SF_SMALL, base)
    sales_csv = str(tmp_path / "pro_actual_sales")
    sinks.write_csv(sales.select(*[F.col(c).alias(c.upper()) for c in sales.columns]), sales_csv)
    plans = ds.promotion(spark, SF_SMALL, base)
    promo_csv = str(tmp_path / "pro_promotion")
    sinks.write_csv(plans.select(*[F.col(c).alias(c.upper()) for c in plans.columns],
                                 *[F.lit(None).cast("string").alias(c)
                                   for c in ("PMAP", "PMAP10", "PRO_PERCENT")]), promo_csv)

    s = files.typed(files.load_csv(spark, sales_csv, "actual_sales"), "actual_sales")
    p = files.typed(files.load_csv(spark, promo_csv, "promotion"), "promotion")
    out = flows.demand_forecast_flow(s, p)
    out = out.toDF(*[c.lower() for c in out.columns])
    cols = ["regionseg1", "productseg2", "regionseg2", "regionseg3", "productseg3", "yearweek",
            "seasonality", "fcst", "fcst_timeseries"]
    got = _round(out, {"seasonality", "fcst", "fcst_timeseries"})
    want = QUERIES["demand_forecast"](spark, SF_SMALL)
    assert rows(got, *cols) == rows(want, *cols)


def test_semicolon_parameter_table_drives_the_filter(spark, tmp_path):
    p = tmp_path / "season_mpara.csv"
    p.write_text("CATEGORY;NAME;VALUE\nCOMMON;VALID_REGION;ASIA\nCOMMON;VALID_PRODUCT;Brand#7\n")
    params = files.load_csv(spark, str(p), "parameters", sep=";")
    ws = ds.weekly_sales(spark, SF_SMALL)
    got = clean.params_filter(ws, params, "regionid", "product")
    want = ws.filter((F.col("regionid") == "ASIA") | (F.col("product") == "Brand#7"))
    assert rows(got) == rows(want)


def test_flow_with_history_and_coarser_mean(spark):
    base = sinks.materialize(ds.sales_base(spark, SF_SMALL), "base")
    sales, plans = ds.sales_detail(spark, SF_SMALL, base), ds.promotion(spark, SF_SMALL, base)
    new = flows.demand_forecast_flow(sales, plans)
    whole = flows.demand_forecast_flow(sales, plans, only_new=False)
    assert whole.columns == new.columns and len(whole.columns) == 19
    assert rows(whole.filter("fcst > 0")) == rows(new.filter("fcst > 0"))
    coarse = flows.demand_forecast_flow(sales, plans, only_new=False,
                                        mean_partition=["regionseg1", "productseg2", "regionseg2"])
    key = ["regionseg1", "productseg2", "regionseg2", "regionseg3", "productseg3", "yearweek", "qty"]
    assert rows(coarse, *key) == rows(whole, *key)
    assert rows(coarse, "moving_avg") != rows(whole, "moving_avg")
