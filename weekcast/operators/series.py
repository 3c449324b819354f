"""Weekly time series per key: gap fill, horizon rows, moving ratio, active keys
(C3-C6, S10, U1, F15-F18).

A weekly series has at most one row per week and key (plus the source's
duplicates), so the work of a per-key window is bounded by the calendar
span, not by the data size.  The series operators are written so that gap
fill, moving averages and the active-key test all run on one hash
partitioning by the key: one shuffle of the input rows, and generated rows
never cross the network.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekcast.functions.calendar import monday, week_add, yearweek
from weekcast.functions.scalar import safe_div
from weekcast.operators.joins import with_global
from weekcast.operators.names import resolve, resolve_all, resolve_keys
from weekcast.operators.windows import centred


def _one_week():
    return F.expr("INTERVAL 7 DAYS")


def _new_rows(df: DataFrame, gaps: DataFrame, keys, week_col: str, fill: dict,
              derived: dict) -> DataFrame:
    """Rows for generated Mondays ``_wk``, shaped like ``df``.

    Columns come from: the keys, ``week_col`` (formatted), ``derived``
    (expressions over ``week_col``), ``fill`` (constants), else NULL.
    """
    base = gaps.select(*keys, "_wk", yearweek("_wk").alias(week_col))
    cols = []
    for f in df.schema.fields:
        c = f.name
        if c in keys or c == week_col:
            cols.append(F.col(c))
        elif c in derived:
            cols.append(derived[c].cast(f.dataType).alias(c))
        elif c in fill:
            cols.append(F.lit(fill[c]).cast(f.dataType).alias(c))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(c))
    return base.select(*cols)


def fill_weeks(df: DataFrame, keys, week_col: str = "yearweek", fill: dict | None = None,
               derived: dict[str, Column] | None = None,
               monday_col: str | None = None) -> DataFrame:
    """Add a row for every week missing between each key's first and last week.

    Existing rows (duplicates included) are kept as they are; added rows get
    ``fill`` constants (e.g. ``{"qty": 0.0}``), ``derived`` expressions of the
    week key (e.g. year / week parts), and NULL elsewhere.

    One pass: rows are shuffled once by the keys, ``lead`` gives each row's
    next week, and ``posexplode`` emits the row itself (position 0) followed
    by the Mondays of the gap after it.  Generated rows are produced inside
    the key's partition and never shuffled, and the output stays partitioned
    by the keys, so a following per-series window adds no exchange.  The
    work per key is bounded by its calendar span (weeks x duplicates).

    The input is a weekly series (a few rows per key and week).  Raw
    transactions must be summed to (keys, week) first (``aggs.sum_by_key``):
    that aggregate runs partial before its shuffle, so a key holding a large
    share of the raw rows reaches this operator as one row per week.  Rows
    whose key names no week stay as they are and get no weeks around them.
    ``monday_col`` adds each row's Monday as a date, for steps that go on with
    dates instead of parsing the key again.
    """
    keys, week_col = resolve_all(df, keys), resolve(df, week_col)
    fill, derived = resolve_keys(df, fill), resolve_keys(df, derived)
    wk = monday(week_col)
    columns = df.columns
    x = df.withColumn("_wk", wk) \
          .withColumn("_next", F.lead("_wk").over(Window.partitionBy(*keys).orderBy("_wk")))
    gaps = F.when(F.datediff("_next", "_wk") > 7,
                  F.sequence(F.date_add("_wk", 7), F.date_sub("_next", 7), _one_week())) \
            .otherwise(F.array().cast("array<date>"))
    x = x.select(*columns, "_wk", F.posexplode(F.concat(F.array(F.lit(None).cast("date")), gaps))
                 .alias("_pos", "_gap"))
    orig = F.col("_pos") == 0
    x = x.withColumn(week_col, F.when(orig, F.col(week_col)).otherwise(yearweek("_gap")))
    cols = []
    for f in df.schema.fields:
        c = f.name
        if c in keys or c == week_col:
            cols.append(F.col(c))
        elif c in derived:
            cols.append(F.when(orig, F.col(c)).otherwise(derived[c].cast(f.dataType)).alias(c))
        elif c in fill:
            cols.append(F.when(orig, F.col(c)).otherwise(F.lit(fill[c]).cast(f.dataType))
                        .alias(c))
        else:
            cols.append(F.when(orig, F.col(c)).alias(c))
    if monday_col:
        cols.append(F.coalesce("_gap", "_wk").alias(monday_col))
    return x.select(*cols)


def extend_weeks(df: DataFrame, keys, horizon: int, week_col: str = "yearweek",
                 fill: dict | None = None, derived: dict[str, Column] | None = None,
                 only_new: bool = False) -> DataFrame:
    """Add rows after each key's last week up to ``horizon`` weeks past the global last week
    (S10, U1).  Keys ending before the global last week get those weeks too."""
    keys, week_col = resolve_all(df, keys), resolve(df, week_col)
    fill, derived = resolve_keys(df, fill), resolve_keys(df, derived)
    last = df.groupBy(*keys).agg(F.max(monday(week_col)).alias("_kmax"))
    last = with_global(last, _gmax=F.max("_kmax"))
    gaps = last.select(*keys, F.explode(F.sequence(
        F.date_add("_kmax", 7), F.date_add("_gmax", 7 * horizon), _one_week())).alias("_wk"))
    new = _new_rows(df, gaps, keys, week_col, fill, derived)
    return new if only_new else df.unionByName(new)


def week_parts(week_col: str = "yearweek") -> dict[str, Column]:
    """``year`` / ``week`` integer columns derived from the week key, for added rows."""
    return {"year": F.substring(F.col(week_col), 1, 4).cast("int"),
            "week": F.substring(F.col(week_col), 5, 2).cast("int")}


def moving_ratio(df: DataFrame, partition, order, value: str = "qty", width: int = 5,
                 avg_name: str = "moving_avg", ratio_name: str = "seasonality") -> DataFrame:
    """Centred moving mean and ``value / mean`` (1.0 when the mean is 0)."""
    w = centred(partition, order, width)
    return (df.withColumn(avg_name, F.avg(value).over(w))
              .withColumn(ratio_name, safe_div(F.col(value), F.col(avg_name), 1.0)))


def active_keys(df: DataFrame, keys, week_col: str = "yearweek", threshold: str | None = None,
                lookback: int = 7, last_week: DataFrame | None = None) -> DataFrame:
    """Rows of keys whose last week is >= ``threshold``.

    Default threshold: ``lookback`` weeks before the global last week (a key
    with no sales in the last ``lookback + 1`` weeks is discontinued); pass
    ``last_week`` (a one-row frame, e.g. from a cheaper source) to avoid a
    separate pass over ``df``.  The threshold is computed in that one row.  The key's last week is a window
    maximum over the key, which shares the exchange and sort of any other
    per-series window on the same keys.
    """
    keys, week_col = resolve_all(df, keys), resolve(df, week_col)
    kmax = F.max(week_col).over(Window.partitionBy(*keys))
    if threshold is not None:
        thr = F.lit(threshold)
    else:
        one = last_week if last_week is not None else df.agg(F.max(week_col).alias("w"))
        thr = one.select(week_add(one.columns[0], -lookback).alias("threshold")).scalar()
    return df.withColumn("_kmax", kmax).filter(F.col("_kmax") >= thr).drop("_kmax")


def global_value(df: DataFrame, expr: Column) -> Column:
    """A whole-table aggregate as a scalar-subquery Column (J14): evaluated once per query
    by a partial + final aggregate; no join, no driver round trip."""
    return df.agg(expr.alias("_v")).scalar()


def last_weeks(df: DataFrame, n: int, week_col: str = "yearweek",
               inclusive: bool = True) -> DataFrame:
    """Rows in the last weeks relative to the global last week.

    ``inclusive``: keep ``week >= last - n`` (n+1 weeks); else ``week > last - n`` (n weeks).
    """
    start = df.agg(F.max(week_col).alias("w")).select(week_add("w", -n).alias("start")).scalar()
    return df.filter(F.col(week_col) >= start if inclusive else F.col(week_col) > start)


