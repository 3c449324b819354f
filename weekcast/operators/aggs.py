"""Aggregations.

All are hash aggregates with partial (map-side) aggregation, so a key holding
a large share of the rows is reduced to one partial row per map task before
the shuffle.  "Per key, repeated on every row" is an aggregate joined back on
the key rather than an unordered window: a window would put a hot key's rows
into one task, the join lets AQE broadcast the small aggregate or split a
skewed partition.  The join back is null-safe: rows with a NULL key stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekcast.operators.joins import join_back


def mean_by_key(df: DataFrame, keys, value: str, name: str = "avg_qty") -> DataFrame:
    """Mean per key (A1); an empty key cannot occur, so no size-0 guard is needed."""
    return df.groupBy(*keys).agg(F.avg(value).alias(name))


def sum_by_key(df: DataFrame, keys, value: str, name: str = "sum_qty") -> DataFrame:
    """Sum per key (A2)."""
    return df.groupBy(*keys).agg(F.sum(value).alias(name))


def count_mean_by_key(df: DataFrame, keys, value: str) -> DataFrame:
    """(count, mean) per key (A3)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt"), F.avg(value).alias("mean"))


def min_max(df: DataFrame, col: str, keys=(), also=()) -> DataFrame:
    """Global (A4) or per-key (A5) min and max of ``col`` and the columns ``also``.

    Numbers and dates keep the aggregate hashed; strings make Spark sort the rows.
    """
    aggs = [f(c).alias(f"{n}_{c}") for c in (col, *also) for n, f in (("min", F.min), ("max", F.max))]
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def stats_on_rows(df: DataFrame, keys, value: str, prefix: str = "") -> DataFrame:
    """Count, sum, mean and population stddev per key on every row."""
    s = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(prefix + "cnt"),
                              F.sum(value).alias(prefix + "sum"),
                              F.avg(value).alias(prefix + "mean"),
                              F.stddev_pop(value).alias(prefix + "stddev"))
    return join_back(df, s, keys)


def nonzero_mean(df: DataFrame, keys, value: str, name: str = "nz_mean") -> DataFrame:
    """sum(value) / count(value > 0) per key, 0 when no value is positive."""
    nz = F.count(F.when(F.col(value) > 0, 1))
    return df.groupBy(*keys).agg(
        F.when(nz == 0, F.lit(0.0)).otherwise(F.sum(value) / nz).alias(name))


def mean_of_sums(df: DataFrame, keys, sub_key: str, value: str) -> DataFrame:
    """Two-level aggregate: sum per (keys, sub_key), then mean of the sums per key."""
    s = df.groupBy(*keys, sub_key).agg(F.sum(value).alias("_s"))
    return s.groupBy(*keys).agg(F.avg("_s").alias("mean_of_sums"),
                                F.count(F.lit(1)).alias("n_" + sub_key))


def pivot_sum(df: DataFrame, keys, pivot_col: str, values, measure: str) -> DataFrame:
    """Pivot with given values, summing ``measure``.

    The values are always given, which avoids the extra distinct-values job
    Spark would run otherwise.
    """
    return df.groupBy(*keys).pivot(pivot_col, list(values)).agg(F.sum(measure))


def stats_by_sets(df: DataFrame, keys, sets, value: str, level: str = "level") -> DataFrame:
    """Count, sum, mean and population stddev for several groupings at once.

    ``sets`` lists the groupings, each a list of ``keys`` (empty: the total).  One scan, one
    expand and one exchange for all of them, combined before the shuffle.  ``level`` is the
    grouping id (bit ``i`` from the left is 1 where key ``i`` is not grouped by), which tells a
    key that is rolled up from a key that is NULL.
    """
    keys = list(keys)
    return df.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys]).agg(
        F.grouping_id().alias(level), F.count(F.lit(1)).alias("cnt"), F.sum(value).alias("sum"),
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("stddev"))
