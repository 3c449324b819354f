"""Rank-ratio item clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekcast.operators.series import last_weeks
from weekcast.operators.windows import rank_ratio_bucket, rank_within_groups


def item_clusters(df: DataFrame, group_keys=("regionseg1", "productseg2"),
                  item_key: str = "productseg3", week_col: str = "yearweek",
                  value: str = "qty", recent_weeks: int = 20,
                  thresholds=(0.3, 0.6)) -> DataFrame:
    """Cluster items of each group by the rank of their recent sales.

    Rows in the last ``recent_weeks`` weeks (inclusive start, so
    ``recent_weeks + 1`` weeks) are summed per item; inside each group items
    are ranked by the sum descending (ties by item key); ``ratio`` =
    rank / items-in-group; cluster 0 for ratio <= thresholds[0], 1 for <=
    thresholds[1], else 2.  The rank is computed without sorting a whole
    group in one task (``windows.rank_within_groups``), so a group holding a
    large share of the items is split over several tasks.
    """
    group_keys = list(group_keys)
    recent = last_weeks(df, recent_weeks, week_col, inclusive=True)
    s = recent.groupBy(*group_keys, item_key).agg(F.sum(value).alias("sum_qty"))
    r = rank_within_groups(s, group_keys, "sum_qty", [item_key], name="rank", count_name="cnt")
    ratio = F.col("rank") / F.col("cnt")
    return r.select(*group_keys, item_key, "sum_qty", "rank", ratio.alias("ratio"),
                    rank_ratio_bucket(ratio, thresholds).alias("cluster"))
