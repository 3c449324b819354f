"""Forecasts.

Both are per-key aggregates plus generated horizon rows; the global last
week is an uncorrelated scalar subquery, computed once.  Week differences use
Mondays (``datediff / 7``), never ``YYYYWW`` integer subtraction, so the
"last 4 weeks" window is right across New Year (Q4).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekcast.functions.calendar import monday, week_of, week_sequence, yearweek
from weekcast.operators.names import resolve, resolve_all, resolve_keys


def mean_recent_forecast(df: DataFrame, keys, week_col: str = "yearweek", value: str = "qty",
                         recent: int = 4, horizon: int = 1) -> DataFrame:
    """Mean of the rows present in the last ``recent`` weeks, as the forecast for each of the
    next ``horizon`` weeks (C12, F16, A16).  One row per key per horizon week."""
    keys = list(keys)
    last = df.agg(F.max(monday(week_col)).alias("_g"))  # Monday of the last week
    gmax = last.scalar()
    rec = df.filter(monday(week_col) > last.select(F.date_add("_g", -7 * recent).alias("from")).scalar())
    m = rec.groupBy(*keys).agg(F.avg(value).alias("fcst")).withColumn("_gmax", gmax)
    steps = F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("_h")
    return (m.select(*keys, "fcst", "_gmax", steps)
             .select(*keys, yearweek(F.date_add("_gmax", F.col("_h") * 7)).alias("fcst_week"),
                     "fcst"))


def level_seasonal_forecast(df: DataFrame, keys, week_col: str = "yearweek",
                            value: str = "qty", season_col: str = "seasonality",
                            recent: int = 4, horizon: int = 4, fill: dict | None = None,
                            only_new: bool = False, last_week: DataFrame | None = None,
                            legacy_week: int | None = None,
                            monday_col: str | None = None) -> DataFrame:
    """Level x seasonality forecast per key.

    fcst        = sum(qty of the last ``recent`` weeks) / recent
    avg_season  = sum(seasonality of those weeks) / recent
    target      = mean seasonality of the same week number in the key's history
                  (0 when that week number never occurred)
    fcst_timeseries = fcst * target / avg_season  (0 when avg_season is 0)

    New rows cover the weeks after each key's last week through ``horizon``
    weeks past the global last week (``last_week``, computed from ``df`` when
    not given), with ``fill`` constants for the other measures; history rows
    get fcst = fcst_timeseries = 0.  ``only_new`` returns just the new rows.

    Plan: one partial aggregate of ``df`` at (key, week number) grain (at most
    53 rows per key), then per-key totals as windows over that small result;
    each (key, week number) row emits the future weeks carrying its week
    number, and the key's first row also emits the future weeks whose number
    never occurred.  ``df`` is read once when ``only_new``.  ``monday_col``
    names a column that holds each row's Monday already (it is left out of
    the result).

    ``legacy_week`` reproduces the formula as the source script wrote it
    (Q6): when the key's history holds week number ``legacy_week`` the target
    is the sum of *all* its seasonality values, else 0; the output
    seasonality is that sum / ``recent`` and ``fcst_timeseries`` uses the
    undivided sum.
    """
    keys, week_col = resolve_all(df, keys), resolve(df, week_col)
    value, season_col = resolve(df, value), resolve(df, season_col)
    fill = resolve_keys(df, fill)
    wk = F.col(monday_col) if monday_col else monday(week_col)
    gmax = last_week.select(monday(last_week.columns[0]).alias("g")).scalar() if last_week is not None \
        else df.agg(F.max(wk).alias("_g")).scalar()
    number = F.weekofyear(wk) if monday_col else week_of(week_col)
    rec = df.withColumn("_wk", wk).withColumn("_number", number).withColumn(
        "_recent", F.datediff(gmax, F.col("_wk")) <= 7 * (recent - 1))
    g1 = rec.groupBy(*keys, F.col("_number").alias("_wn")).agg(
        F.avg(season_col).alias("_target"), F.count(season_col).alias("_n"),
        F.sum(F.when(F.col("_recent"), F.col(value))).alias("_rq"),
        F.sum(F.when(F.col("_recent"), F.col(season_col))).alias("_rs"),
        F.max("_wk").alias("_kmax_wn"))
    kw = Window.partitionBy(*keys)
    g2 = (g1.withColumn("fcst", F.coalesce(F.sum("_rq").over(kw), F.lit(0.0)) / recent)
            .withColumn("avg_season", F.coalesce(F.sum("_rs").over(kw), F.lit(0.0)) / recent)
            .withColumn("_kmax", F.max("_kmax_wn").over(kw))
            .withColumn("_wns", F.collect_set("_wn").over(kw))  # <= 53 week numbers
            .withColumn("_first", F.row_number().over(kw.orderBy("_wn")) == 1)
            .withColumn("_gmax", gmax))
    if legacy_week is not None:
        g2 = g2.withColumn("_legacy", F.when(
            F.array_contains("_wns", F.lit(legacy_week)),
            F.coalesce(F.sum(F.col("_target") * F.col("_n")).over(kw), F.lit(0.0)))
            .otherwise(F.lit(0.0)))
    weeks = week_sequence(F.date_add("_kmax", 7), F.date_add("_gmax", 7 * horizon))
    mine = F.filter(weeks, lambda d: (F.weekofyear(d) == F.col("_wn")) |
                    (F.col("_first") & ~F.array_contains(F.col("_wns"), F.weekofyear(d))))
    extra = ["_legacy"] if legacy_week is not None else []
    f = g2.select(*keys, "fcst", "avg_season", "_wn", "_target", *extra,
                  F.explode(mine).alias("_wk"))
    if legacy_week is None:
        target = F.when(F.weekofyear("_wk") == F.col("_wn"),
                        F.coalesce("_target", F.lit(0.0))).otherwise(F.lit(0.0))
        shown = target
    else:
        target, shown = F.col("_legacy"), F.col("_legacy") / recent
    ts = F.when(F.col("avg_season") != 0, F.col("fcst") * target / F.col("avg_season")) \
          .otherwise(F.lit(0.0))
    f = f.withColumn(week_col, yearweek("_wk")).withColumn("fcst_timeseries", ts) \
         .withColumn(season_col, shown)
    cols = []
    df = df.drop(monday_col) if monday_col else df
    for fld in df.schema.fields:
        c = fld.name
        if c in keys or c in (week_col, season_col):
            cols.append(F.col(c).cast(fld.dataType).alias(c))
        elif c.lower() in ("year", "week"):
            part = F.substring(week_col, 1, 4) if c.lower() == "year" else \
                F.substring(week_col, 5, 2)
            cols.append(part.cast(fld.dataType).alias(c))
        elif c in fill:
            cols.append(F.lit(fill[c]).cast(fld.dataType).alias(c))
        else:
            cols.append(F.lit(None).cast(fld.dataType).alias(c))
    new = f.select(*cols, "fcst", "fcst_timeseries")
    if only_new:
        return new
    hist = df.withColumn("fcst", F.lit(0.0)).withColumn("fcst_timeseries", F.lit(0.0))
    return hist.unionByName(new)
