"""Joins: master joins, deterministic lookups, key overlays, global values.

The reference's lookups pull the right table to the driver
(``collectAsMap``) and probe it inside a closure.  Here a lookup is a
de-duplicating aggregate (partial, so a hot key collapses map-side) followed
by a left join; Catalyst/AQE choose broadcast-hash when the de-duplicated
side is small at runtime and sort-merge (with skew splitting) when it is not.
Nothing goes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_HOW = {"inner": "inner", "left": "left", "left_outer": "left", "right": "right",
        "right_outer": "right", "semi": "left_semi", "left_semi": "left_semi",
        "anti": "left_anti", "left_anti": "left_anti"}


def join_using(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Equi-join on same-named key columns (J4, J5); keys appear once in the output."""
    return left.join(right, on=list(keys), how=_HOW[how])


def join_master(facts: DataFrame, master: DataFrame, left_key: str, right_key: str,
                how: str = "inner", master_cols=None) -> DataFrame:
    """Join facts to a master table on one key.

    Output: the master's ``master_cols`` first, then all fact columns; for a
    right join the unmatched master rows carry NULL facts.
    """
    master_cols = list(master_cols or [c for c in master.columns if c != right_key])
    m = master.select(F.col(right_key).alias("_mk"), *master_cols)
    j = facts.join(m, facts[left_key] == m._mk, _HOW[how])
    return j.select(*master_cols, *[facts[c] for c in facts.columns])


def dedupe_lookup(right: DataFrame, keys, value: str, order, pick: str = "first") -> DataFrame:
    """One row per key: the value of the first (or last) row by ``order``.

    ``order`` is a list of columns that totally orders the rows of a key;
    arrival order is never used (Q8).
    """
    if pick not in ("first", "last"):
        raise ValueError("pick must be 'first' or 'last'")
    # a single column is passed plainly: fixed-width order and value keep the aggregate hashed
    ordk = F.col(order[0]) if len(order) == 1 else F.struct(*[F.col(c) for c in order])
    agg = F.min_by if pick == "first" else F.max_by
    return right.groupBy(*keys).agg(agg(F.col(value), ordk).alias(value))


def lookup(left: DataFrame, right: DataFrame, left_keys, right_keys, value: str, order,
           default=None, pick: str = "first", out: str | None = None,
           trim: bool = False) -> DataFrame:
    """Left ``left`` with one looked-up ``value`` per row.

    The right side is de-duplicated per key first, so the left row count is
    preserved.  Missing keys get ``default`` (a literal or a Column such as
    the row's own key).  With ``trim`` both key sides are trimmed (X4).
    """
    out = out or value
    lk = [F.trim(F.col(k)) if trim else F.col(k) for k in left_keys]
    rk_names = [f"_rk{i}" for i in range(len(right_keys))]
    r = right.select(*[(F.trim(F.col(k)) if trim else F.col(k)).alias(n)
                       for k, n in zip(right_keys, rk_names)],
                     F.col(value).alias("_val"), *[F.col(c) for c in order])
    d = dedupe_lookup(r, rk_names, "_val", order, pick)
    cond = None
    for a, n in zip(lk, rk_names):
        c = a == d[n]
        cond = c if cond is None else cond & c
    j = left.join(d, cond, "left")
    v = F.col("_val")
    if default is not None:
        v = F.coalesce(v, default if isinstance(default, Column) else F.lit(default))
    return j.select(*[left[c] for c in left.columns], v.alias(out))


def overlay_fanout(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
                   new_col: str, out: str = "updated_key", trim: bool = True) -> DataFrame:
    """Key overlay keeping every match (J8, X11): a key with k corrections gives k rows.

    ``out`` = the correction when one matched, else the row's own key,
    written both as ``CASE WHEN .. IS NULL`` and as ``nvl2``.
    """
    lk = F.trim(F.col(left_key)) if trim else F.col(left_key)
    r = right.select((F.trim(F.col(right_key)) if trim else F.col(right_key)).alias("_rk"),
                     F.col(new_col).alias("_new"))
    j = left.withColumn("_lk", lk).join(r, F.col("_lk") == F.col("_rk"), "left")
    return j.select(
        F.when(F.col("_rk").isNull(), F.col("_lk")).otherwise(F.col("_new")).alias(out),
        F.nvl2(F.col("_rk"), F.col("_new"), F.col("_lk")).alias(out + "_nvl2"),
        *[left[c] for c in left.columns])


def by_key(df: DataFrame, key: dict) -> DataFrame:
    """The rows of one key (K9): a plain predicate that the scan can use."""
    cond = F.lit(True)
    for c, v in key.items():
        cond = cond & (F.col(c) == F.lit(v))
    return df.filter(cond)


def with_global(df: DataFrame, **aggs: Column) -> DataFrame:
    """Attach whole-table aggregates (e.g. ``max_week=F.max('yearweek')``) to every row.

    Each aggregate is an uncorrelated scalar subquery: computed once by a
    partial + final aggregate and inlined as a value, so there is neither a
    join nor a shuffle of the detail rows.
    """
    return df.select("*", *[df.agg(e.alias(k)).scalar().alias(k) for k, e in aggs.items()])


def join_back(df: DataFrame, per_key: DataFrame, keys) -> DataFrame:
    """``df`` with the columns of ``per_key`` (one row per key) on every row.

    The keys are compared null-safe, so rows with a NULL key get the values of the NULL key
    and no row is lost; AQE broadcasts a small ``per_key`` or splits a skewed partition.
    """
    keys = list(keys)
    names = {k: f"_back_{i}" for i, k in enumerate(keys)}
    right = per_key.select(*[F.col(k).alias(n) for k, n in names.items()],
                           *[c for c in per_key.columns if c not in names])
    cond = None
    for k, n in names.items():
        c = df[k].eqNullSafe(right[n])
        cond = c if cond is None else cond & c
    return df.join(right, cond).drop(*names.values())


def missing_from(expected: DataFrame, present: DataFrame, keys) -> DataFrame:
    """Rows of ``expected`` whose keys are absent from ``present``."""
    return expected.join(present.select(*keys).distinct(), on=list(keys), how="left_anti")
