"""End-to-end flows over user tables in the workload's layouts.

``demand_forecast_flow`` takes the weekly sales table (``actual_sales``
layout: six segments, yearweek, year, week, qty) and the promotion plan table
(``promotion`` layout) as DataFrames, e.g. loaded with
``sources.load_csv`` + ``sources.typed``, and returns the forecast rows.
Column names resolve case-insensitively, so upper-case CSV headers work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekcast.operators import forecast, promo, series
from weekcast.sources import sinks

SEG5 = ["regionseg1", "productseg2", "regionseg2", "regionseg3", "productseg3"]
PROMO_FILL = {"qty": 0.0, "map_price": 0.0, "ir": 0.0, "pmap": 0.0, "pmap10": 0,
              "pro_percent": 0.0, "promotion_check": "N"}


def sales_with_promotion(sales: DataFrame, promotion: DataFrame) -> DataFrame:
    """Promotion cleansing + price imputation (C1), then sales x promotion with the
    promotion flag (C2)."""
    return promo.attach_promotion(sales, promo.impute_promo_prices(promotion))


def demand_forecast_flow(sales: DataFrame, promotion: DataFrame, horizon: int = 4,
                         recent: int = 4, width: int = 5, lookback: int = 7,
                         stage: bool = True, last_week: DataFrame | None = None,
                         legacy_week: int | None = None, only_new: bool = True,
                         mean_partition=None) -> DataFrame:
    """Sales x promotion -> discontinued-item filter -> week gap fill -> moving ratio ->
    level x seasonality forecast (C1, C2, C6, C3, C5, C7).

    Returns the forecast rows; with ``only_new=False`` the weekly history of
    the active items too (fcst = fcst_timeseries = 0), 19 columns either way.
    ``mean_partition`` names the keys of the moving mean (default: the full
    series key; the source script used three of the five).

    The discontinued-item test depends only on each key's last week and the
    global last week; gap fill adds weeks only inside a key's span and the
    moving ratio is per key, so filtering first is exact and only active
    series are expanded.  With ``stage`` the sales x promotion table is
    written once to the shared checkpoint folder, since it feeds both the
    series and the global last week.  ``last_week`` (a one-row frame of the global
    last week key) may be given when a cheaper source for it exists; ``legacy_week``
    selects the source script's written target-week formula (see
    ``forecast.level_seasonal_forecast``).
    """
    joined = sales_with_promotion(sales, promotion)
    if stage:
        joined = sinks.materialize(joined, "sales_promotion")
    if last_week is None:
        last_week = joined.agg(F.max("yearweek").alias("w"))
    alive = series.active_keys(joined, SEG5, last_week=last_week, lookback=lookback)
    filled = series.fill_weeks(alive, SEG5, fill=PROMO_FILL, derived=series.week_parts(),
                               monday_col="_monday")
    partition = list(mean_partition or SEG5)
    tiebreak = [*[k for k in SEG5 if k not in partition], "qty", "map_price", "ir", "pmap",
                "pmap10", "pro_percent", "promotion_check"]
    ratio = series.moving_ratio(filled, partition, ["_monday", *tiebreak], "qty", width,
                                "moving_avg", "seasonality")
    return forecast.level_seasonal_forecast(ratio, SEG5, recent=recent, horizon=horizon,
                                            fill={**PROMO_FILL, "moving_avg": 0.0},
                                            only_new=only_new, last_week=last_week,
                                            legacy_week=legacy_week, monday_col="_monday")
