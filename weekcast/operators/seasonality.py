"""Seasonality indices.

C8's three centred windows share PARTITION BY (keys) ORDER BY week, so the
physical plan has one exchange and one sort for all of them; its profile
aggregate groups by a superset of the window keys and reuses that
partitioning too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekcast.functions.calendar import wing_length
from weekcast.functions.scalar import clamp, clip_band, int_div, round_half_up, safe_div
from weekcast.operators.clean import drop_week, valid_week
from weekcast.operators.joins import join_back
from weekcast.operators.windows import centred, in_blocks


def robust_seasonality(df: DataFrame, keys=("regionid", "product"), week_col: str = "yearweek",
                       value: str = "qty", ma_width: int = 17, sd_width: int = 5,
                       smooth_width: int = 5, max_week: int = 52, tiebreak=(),
                       block_rows: int | None = None) -> DataFrame:
    """Clip-and-smooth seasonality index per key.

    qty < 0 -> 0 and weeks > ``max_week`` dropped; ``ma`` = centred mean of
    qty over ``ma_width`` rows; ``stddev`` = centred sample stddev *of ma*
    over ``sd_width`` rows; ``refined`` = qty clipped to ma +- stddev (a NULL
    stddev leaves qty as is); ``smoothed`` = centred mean of refined over
    ``smooth_width`` rows; the indices divide qty / refined by smoothed (1 when
    smoothed is 0).

    ``block_rows``: for keys that may be hot, the three chained frames are taken in blocks
    with a halo of their wings' sum (``windows.in_blocks``).
    """
    keys = list(keys)
    order = [week_col, *tiebreak]
    q = F.col(value)
    clean = valid_week(df.withColumn(value, F.when(q < 0, F.lit(0.0)).otherwise(q)),
                       week_col, max_week)

    def frames(rows, part, by):
        ma = rows.withColumn("ma", F.avg(value).over(centred(part, by, ma_width)))
        sd = ma.withColumn("stddev", F.stddev_samp("ma").over(centred(part, by, sd_width)))
        ref = (sd.withColumn("upper_bound", F.col("ma") + F.col("stddev"))
                 .withColumn("lower_bound", F.col("ma") - F.col("stddev"))
                 .withColumn("refined", clip_band(value, "ma", "stddev")))
        return ref.withColumn("smoothed", F.avg("refined").over(centred(part, by, smooth_width)))

    if block_rows is None:
        sm = frames(clean, keys, order)
    else:
        reach = sum(wing_length(w) for w in (ma_width, sd_width, smooth_width))
        sm = in_blocks(clean, keys, order, reach, frames, block_rows)
    return (sm.withColumn("seasonality_stable", safe_div(F.col(value), F.col("smoothed"), 1.0))
              .withColumn("seasonality_unstable",
                          safe_div(F.col("refined"), F.col("smoothed"), 1.0)))


def seasonality_profile(seasonal: DataFrame, keys=("regionid", "product"),
                        week_col: str = "yearweek", value: str = "qty",
                        by_qty: bool = True) -> DataFrame:
    """Mean indices per key and week number (C8 final step, A13).

    ``by_qty=True`` groups by the quantity as well, as the source query is
    written (Q10); ``by_qty=False`` is the per-week profile.  The week is
    the two-character week string.
    """
    g = [*keys, *([value] if by_qty else []), F.substring(week_col, 5, 2).alias("week")]
    return seasonal.groupBy(*g).agg(
        F.avg("seasonality_stable").alias("seasonality_stable"),
        F.avg("seasonality_unstable").alias("seasonality_unstable"))


def seasonality_forecast(profile: DataFrame, value: str = "qty") -> DataFrame:
    """``forecast_qty = qty * seasonality_stable`` over the profile grouped by qty."""
    return profile.withColumn("forecast_qty", F.col(value) * F.col("seasonality_stable"))


def simple_seasonality(df: DataFrame, keys=("regionid", "product"), week_col: str = "yearweek",
                       value: str = "qty", lo: float = 0.0, hi: float = 700000.0,
                       except_week: int = 53) -> DataFrame:
    """Per-row ratio to the rounded key mean, in integer hundredths.

    qty clamped to [lo, hi], one week number dropped; ``avg_qty`` = key mean
    rounded half-up to an integer; ``ratio_h`` = round-half-up of
    qty/avg_qty*100 (100 when avg_qty is 0); ``ratio`` = ratio_h / 100.
    The key mean is an aggregate joined back (skew-safe, see ``aggs``).
    """
    keys = list(keys)
    c = drop_week(df.withColumn(value, clamp(F.col(value).cast("double"), lo, hi)),
                  week_col, except_week)
    m = c.groupBy(*keys).agg(round_half_up(F.avg(value)).alias("avg_qty"))
    j = join_back(c, m, keys)
    h = F.when(F.col("avg_qty") == 0, F.lit(100).cast("bigint")) \
         .otherwise(round_half_up(F.col(value) / F.col("avg_qty") * 100))
    return j.withColumn("ratio_h", h).withColumn("ratio", F.col("ratio_h") / 100.0)


def simple_profile(ratios: DataFrame, keys=("regionid", "product"),
                   week_col: str = "yearweek") -> DataFrame:
    """Mean ratio per key and week number, rounded half-up to 2 places (C9 profile).

    The mean is taken on integer hundredths and rounded with integer
    arithmetic, so the result does not depend on summation order.
    """
    g = ratios.groupBy(*keys, F.substring(week_col, 5, 2).alias("week")).agg(
        F.sum("ratio_h").alias("_s"), F.count(F.lit(1)).alias("_n"))
    return g.select(*keys, "week",
                    (int_div(F.col("_s") * 2 + F.col("_n"), F.col("_n") * 2) / 100.0)
                    .alias("ratio"))


def week_index(df: DataFrame, keys=("regionid", "product"), week_col: str = "yearweek",
               value: str = "qty") -> DataFrame:
    """Weekly sum per key relative to the key's mean weekly sum.

    Returned flat, one row per (week, key), rather than as one list per week:
    a week's list would grow with the number of keys and land in one row.
    """
    keys = list(keys)
    a = df.groupBy(*keys, week_col).agg(F.sum(value).alias("week_qty"))
    b = a.groupBy(*keys).agg(F.avg("week_qty").alias("mean_week_qty"))
    j = join_back(a, b, keys)
    return j.withColumn("ratio", safe_div(F.col("week_qty"), F.col("mean_week_qty"), 0.0))
