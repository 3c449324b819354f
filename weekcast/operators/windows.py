"""Window operators.

Every ordered frame gets a *total* order: the reference's frames without
ORDER BY (Q1) depend on the row order of an earlier sort, which Spark does
not keep across a shuffle.  Windows that share a PARTITION BY / ORDER BY
share one exchange and one sort in the physical plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekcast.functions.calendar import wing_length
from weekcast.functions.scalar import half_up_div, safe_div, to_micros
from weekcast.operators.joins import join_back
from weekcast.sources.sinks import materialize


def centred(partition, order, width: int) -> Window:
    """Row frame of ``width`` rows centred on the current row."""
    wing = wing_length(width)
    return Window.partitionBy(*partition).orderBy(*order).rowsBetween(-wing, wing)


def moving_avg(df: DataFrame, partition, order, value: str, width: int,
               name: str = "moving_avg", block_rows: int | None = None) -> DataFrame:
    """Centred moving mean over ``width`` rows.

    ``block_rows``: the partition may be hot; frames are then taken in blocks of so many
    rows (``in_blocks``).
    """
    def add(rows, keys, by):
        return rows.withColumn(name, F.avg(value).over(centred(keys, by, width)))
    if block_rows is None:
        return add(df, partition, order)
    return in_blocks(df, partition, order, wing_length(width), add, block_rows)


def moving_stddev(df: DataFrame, partition, order, value: str, width: int,
                  name: str = "stddev", block_rows: int | None = None) -> DataFrame:
    """Centred moving *sample* stddev (W6); NULL for a one-row frame.  ``block_rows`` as in
    ``moving_avg``."""
    def add(rows, keys, by):
        return rows.withColumn(name, F.stddev_samp(value).over(centred(keys, by, width)))
    if block_rows is None:
        return add(df, partition, order)
    return in_blocks(df, partition, order, wing_length(width), add, block_rows)


#: Rows of a block of ``in_blocks``: one task's sort and frames.
BLOCK_ROWS = 1 << 16


def in_blocks(df: DataFrame, partition, order, reach: int, fn, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Row frames over partitions of any size: windows with a halo.

    All rows are sorted once by (partition, order) in range partitions and numbered
    (``global_index``).  A block is ``block_rows`` consecutive rows; it also gets the
    ``reach`` rows before and after it from its neighbours.  ``fn(rows, partition, order)``
    adds columns by windows over the ``partition`` and ``order`` that it is given; frames of
    chained windows must not reach further than ``reach`` rows in all.  The partition keys
    stay among the window's keys, so frames end where a partition ends; rows of a
    neighbouring block are dropped again.  A hot key, or one key on all rows, is spread over
    as many tasks as it has blocks.  ``order`` must make the order total; NULL keys are a
    group.
    """
    if not 0 <= reach <= block_rows:
        raise ValueError("reach must not exceed block_rows")
    order_by = [F.col(k).asc_nulls_first() if isinstance(k, str) else k for k in [*partition, *order]]
    rows = global_index(df, order_by, "_at", "blocks")
    block, at = F.floor(F.col("_at") / block_rows), F.col("_at") % block_rows
    near = F.array(block, F.when((at < reach) & (block > 0), block - 1),
                   F.when(at >= block_rows - reach, block + 1))
    spread = rows.withColumn("_own", block).withColumn("_block", F.explode(F.array_compact(near)))
    out = fn(spread, ["_block", *partition], ["_at"])
    return out.filter(F.col("_block") == F.col("_own")).drop("_block", "_own", "_at")


def partition_mean(df: DataFrame, keys, value: str, name: str = "avg_qty") -> DataFrame:
    """Whole-partition mean on every row (W1), as aggregate + join (see ``aggs``)."""
    return join_back(df, df.groupBy(*keys).agg(F.avg(value).alias(name)), keys)


def partition_ratio(df: DataFrame, keys, value: str, default=1.0, mean_name="avg_qty",
                    ratio_name="ratio") -> DataFrame:
    """Mean per partition and the guarded ratio value/mean."""
    return partition_mean(df, keys, value, mean_name) \
        .withColumn(ratio_name, safe_div(F.col(value), F.col(mean_name), default))


def partition_ratio_exact(df: DataFrame, keys, value: str, mean_name: str = "avg_qty",
                          ratio_name: str = "ratio") -> DataFrame:
    """Mean per partition and value/mean, both rounded half-up to 2 places.

    The values are taken to six places as exact integers, so neither result depends on the
    order of summation; a mean of 0 gives ratio 1.  NULL values stay out of the mean.
    """
    x = df.withColumn("_micros", to_micros(value))
    per_key = x.groupBy(*keys).agg(F.sum("_micros").alias("_s"), F.count("_micros").alias("_n"))
    x = join_back(x, per_key.withColumn("_mean_h", F.when(
        F.col("_n") > 0, half_up_div(F.col("_s"), F.col("_n") * 10_000))), keys)
    ratio_h = F.when(F.col("_mean_h") == 0, F.lit(100).cast("bigint")).otherwise(
        half_up_div(F.col("_micros"), F.col("_mean_h") * 100))
    return x.withColumn(mean_name, F.col("_mean_h") / 100.0) \
            .withColumn(ratio_name, ratio_h / 100.0).drop("_micros", "_s", "_n", "_mean_h")


def rank_desc(df: DataFrame, partition, measure: str, tiebreak, name: str = "rank") -> DataFrame:
    """1-based row number by ``measure`` descending, ties broken by ``tiebreak``."""
    w = Window.partitionBy(*partition).orderBy(F.col(measure).desc(),
                                               *[F.col(c) for c in tiebreak])
    return df.withColumn(name, F.row_number().over(w))


def position_in_group(df: DataFrame, partition, order, name: str = "pos") -> DataFrame:
    """0-based position of each row inside its group."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w) - 1)


def rank_ratio_bucket(ratio: Column, thresholds=(0.3, 0.6)) -> Column:
    """Bucket 0..len(thresholds) of a rank ratio: ratio <= t0 -> 0, <= t1 -> 1, ...."""
    e = None
    for i, t in enumerate(thresholds):
        e = F.when(ratio <= t, i) if e is None else e.when(ratio <= t, i)
    return e.otherwise(len(thresholds))


def top_n(df: DataFrame, partition, measure: str, tiebreak, n: int) -> DataFrame:
    """Top ``n`` rows per group by ``measure`` descending (a top-k report; the limit is the
    feature).  Spark plans this as a per-partition group limit before the window."""
    return rank_desc(df, partition, measure, tiebreak, "_rn").filter(F.col("_rn") <= n) \
        .drop("_rn")


def global_index(df: DataFrame, order, name: str = "pos", stage: str = "sorted") -> DataFrame:
    """Number the rows 0, 1, 2, ... in the total order ``order``, without a single task.

    Rows are sorted in range partitions and written once to the shared stage folder (their
    numbers must not change between two readings); the partitions' row counts, as many as
    there are partitions, give each partition its first number.
    """
    mono = f"_{name}_in_part"
    staged = materialize(df.orderBy(*order).withColumn(mono, F.monotonically_increasing_id()), stage)
    part = F.shiftright(F.col(mono), 33)
    sizes = staged.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect()
    first, pairs = 0, []
    for row in sizes:
        pairs += [F.lit(row["p"]), F.lit(first).cast("long")]
        first += row["n"]
    starts = F.create_map(*pairs) if pairs else F.create_map(F.lit(0).cast("long"), F.lit(0).cast("long"))
    inside = F.col(mono).bitwiseAND(F.lit((1 << 33) - 1))
    return staged.withColumn(name, starts[part] + inside).drop(mono)


def rank_within_groups(df: DataFrame, group_keys, measure: str, tiebreak,
                       name: str = "rank", count_name: str = "cnt") -> DataFrame:
    """Exact 1-based rank by ``measure`` descending (NULL last, ties by ``tiebreak``) inside
    each group, plus the group size, without sorting a whole group in one task.

    All rows are sorted once by (group, measure, tiebreak) in range partitions and numbered;
    a row's rank is its number less the smallest of its group.  The range bounds cut on the
    whole sort key, so neither a large group nor one value shared by a whole group lands in
    one task.  NULL keys are a group.  The tiebreak must make the order total.
    """
    gk = list(group_keys)
    order = [F.col(k).asc_nulls_first() for k in gk] + [F.col(measure).desc_nulls_last()] + \
        [F.col(c).asc_nulls_first() for c in tiebreak]
    numbered = global_index(df, order, "_at", "ranked")
    per_group = numbered.groupBy(*gk).agg(F.min("_at").alias("_from"),
                                          F.count(F.lit(1)).alias(count_name))
    return join_back(numbered, per_group, gk) \
        .withColumn(name, (F.col("_at") - F.col("_from") + 1).cast("int")).drop("_at", "_from")
