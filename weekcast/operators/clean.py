"""Row filters, week-key validity, clamps and null handling.

Every predicate is a Column expression, so Catalyst can push it into the
Parquet / JDBC scan; none is a Python lambda.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekcast.functions.calendar import week_of, year_of
from weekcast.functions.scalar import any_null, clamp
from weekcast.operators.names import resolve


def valid_week(df: DataFrame, col: str = "yearweek", max_week: int = 52) -> DataFrame:
    """Keep rows whose week part is <= ``max_week`` (F8; ``max_week=52`` drops week 53)."""
    return df.filter(week_of(col) <= max_week)


def drop_week(df: DataFrame, col: str = "yearweek", week: int = 53) -> DataFrame:
    """Drop rows of one week number."""
    return df.filter(week_of(col) != week)


def from_year(df: DataFrame, col: str = "yearweek", year: int = 2015) -> DataFrame:
    """Keep rows from ``year`` on."""
    return df.filter(year_of(col) >= year)


def key_length_ok(col: str = "yearweek", length: int = 6) -> Column:
    """Predicate: key has exactly ``length`` characters."""
    return F.length(F.col(col)) == length


def drop_long_keys(df: DataFrame, col: str = "yearweek", length: int = 6) -> DataFrame:
    """Drop keys longer than ``length`` (F7); shorter ones are kept as in the source."""
    return df.filter(F.length(F.col(col)) <= length)


def clamp_column(df: DataFrame, col: str, lo=None, hi=None) -> DataFrame:
    """Clamp a numeric column in place (X16-X18); either bound may be omitted."""
    col = resolve(df, col)
    c = F.col(col)
    if lo is not None and hi is not None:
        e = clamp(c, lo, hi)
    elif lo is not None:
        e = F.when(c < lo, F.lit(lo)).otherwise(c)
    elif hi is not None:
        e = F.when(c > hi, F.lit(hi)).otherwise(c)
    else:
        return df
    return df.withColumn(col, e.cast(df.schema[col].dataType))


def rows_with_nulls(df: DataFrame, cols=None) -> DataFrame:
    """Rows with a NULL in any of ``cols`` (default: all columns)."""
    return df.filter(any_null(list(cols or df.columns)))


def rows_without_nulls(df: DataFrame, cols=None) -> DataFrame:
    """Rows with no NULL in ``cols``."""
    return df.na.drop("any", subset=list(cols) if cols else None)


def null_at_position(df: DataFrame, pos: int) -> Column:
    """Predicate: the column at position ``pos`` (negative counts from the end) is NULL."""
    return F.col(df.columns[pos]).isNull()


def fill_nulls(df: DataFrame, value, cols=None) -> DataFrame:
    """``na.fill`` on ``cols``; a string value fills string columns only, a number numeric ones
    (F20, F21)."""
    return df.na.fill(value, subset=list(cols) if cols else None)


def params_filter(df: DataFrame, params: DataFrame, region_col: str, product_col: str,
                  region_param: str = "VALID_REGION", product_param: str = "VALID_PRODUCT",
                  combine: str = "or", category: str = "COMMON") -> DataFrame:
    """Keep rows whose region is in the region set or product in the product set.

    ``params`` has columns (CATEGORY, NAME, VALUE), one row per set member.
    A missing parameter, or a set holding ``ALL``, matches everything.  The
    sets are de-duplicated before the lookup joins, so a row is never
    repeated; the ALL / missing flags are scalar subqueries over the
    parameter table.
    """
    if combine not in ("or", "and"):
        raise ValueError("combine must be 'or' or 'and'")
    p = params.filter(F.col("CATEGORY") == category)

    def member_set(name, alias):
        return p.filter(F.col("NAME") == name).select(F.col("VALUE").alias(alias)).distinct()

    rs, ps = member_set(region_param, "_rv"), member_set(product_param, "_pv")

    def has(cond):
        return F.coalesce(F.max(F.when(cond, 1)), F.lit(0)) == 1

    region, product = F.col("NAME") == region_param, F.col("NAME") == product_param

    def flag(cond):
        return p.agg(has(cond)).scalar()

    r_wild = ~flag(region) | flag(region & (F.col("VALUE") == "ALL"))
    p_wild = ~flag(product) | flag(product & (F.col("VALUE") == "ALL"))
    j = (df.join(rs, df[region_col] == rs._rv, "left")
           .join(ps, df[product_col] == ps._pv, "left"))
    r_ok = F.col("_rv").isNotNull() | r_wild
    p_ok = F.col("_pv").isNotNull() | p_wild
    keep = (r_ok | p_ok) if combine == "or" else (r_ok & p_ok)
    return j.filter(keep).select(*df.columns)


def conjunction(*preds: Column) -> Column:
    """AND of predicates (F1); an empty list is TRUE (``where 1=1``, F23)."""
    return reduce(lambda a, b: a & b, preds, F.lit(True))
