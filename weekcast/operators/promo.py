"""Promotion cleansing, price imputation and sales x promotion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekcast.functions.scalar import promo_prices, round_half_up
from weekcast.operators.joins import join_back, lookup

PRICE_COLS = ("map_price", "ir", "pmap", "pmap10", "pro_percent")


def impute_promo_prices(promo: DataFrame, group_keys=("productgroup", "item"),
                        order=("targetweek", "regionseg", "salesid")) -> DataFrame:
    """Clean promotion plans and impute one list price per (productgroup, item).

    1. Keep rows whose target week is >= the smallest plan week of the table
       (a scalar subquery: one aggregate, no join).
    2. Per group: if some ``map_price`` is 0, the price is sum / count of the
       positive prices (0 when none is positive); otherwise the price of the
       group's first row by ``order``.  The price applies to every row.
    3. pmap / pmap10 / pro_percent / ir from ``promo_prices``; ``pmap10`` is
       output rounded half-up to an integer, ``pro_percent`` uses it unrounded.

    The group statistics are an aggregate (combined before its shuffle) that is joined back
    null-safe, so a group of any size is spread over many tasks.
    """
    group_keys = list(group_keys)
    min_plan = promo.agg(F.min(F.col("planweek").try_cast("int"))).scalar()
    p = promo.filter(F.col("targetweek").try_cast("int") >= min_plan)
    nz = F.count(F.when(F.col("map_price") > 0, 1))
    has_zero = F.max(F.when(F.col("map_price") == 0, 1).otherwise(0))
    first = F.min_by(F.col("map_price"), F.struct(*[F.col(c) for c in order]))
    price = F.when(has_zero == 1,
                   F.when(nz != 0, F.sum("map_price") / nz).otherwise(F.lit(0.0))).otherwise(first)
    j = join_back(p, p.groupBy(*group_keys).agg(price.alias("_price")), group_keys)
    pc = promo_prices("_price", "ir")
    return j.select("regionseg", "salesid", "productgroup", "item", "targetweek", "planweek",
                    F.col("_price").alias("map_price"), pc["ir"].alias("ir"),
                    pc["pmap"].alias("pmap"), round_half_up(pc["pmap10"]).alias("pmap10"),
                    pc["pro_percent"].alias("pro_percent"))


def attach_promotion(sales: DataFrame, promo: DataFrame) -> DataFrame:
    """Sales left-joined to cleaned promotions on 5 keys, NULL prices -> 0, promotion flag
    (C2, J6, F22).

    ``promotion_check`` is 'N' when the price is 0, else 'Y' (numeric test,
    Q5).  ``productseg1`` is not carried (15 output columns).
    """
    p = promo.select(F.col("regionseg"), F.col("productgroup"), F.col("salesid"),
                     F.col("item"), F.col("targetweek"), *PRICE_COLS)
    pairs = (("regionseg1", "regionseg"), ("productseg2", "productgroup"),
             ("regionseg2", "salesid"), ("productseg3", "item"), ("yearweek", "targetweek"))
    cond = None
    for a, b in pairs:  # bracket access resolves names case-insensitively (CSV headers)
        c = sales[a] == p[b]
        cond = c if cond is None else cond & c
    j = sales.join(p, cond, "left")
    price = F.coalesce(p["map_price"], F.lit(0.0))
    return j.select(
        "regionseg1", "productseg2", "regionseg2", "regionseg3", "productseg3", "yearweek",
        "year", "week", "qty", price.alias("map_price"),
        F.coalesce(p["ir"], F.lit(0.0)).alias("ir"),
        F.coalesce(p["pmap"], F.lit(0.0)).alias("pmap"),
        F.coalesce(p["pmap10"], F.lit(0)).cast("bigint").alias("pmap10"),
        F.coalesce(p["pro_percent"], F.lit(0.0)).alias("pro_percent"),
        F.when(price == 0, "N").otherwise("Y").alias("promotion_check"))


def promo_percent_lookup(sellout: DataFrame, account_promo: DataFrame,
                         order=("o_orderkey",)) -> DataFrame:
    """Sell-out rows with the first promotion percentage of (account, week), default 0.0 (C14)."""
    return lookup(sellout, account_promo, ["accountid", "yearweek"], ["accountid", "yearweek"],
                  "pro_percent", order=list(order), default=0.0, pick="first")


def promo_percent_fanout(sellout: DataFrame, account_promo: DataFrame) -> DataFrame:
    """The SQL twin of C14: every matching promotion row, NULL when none."""
    p = account_promo.select(F.col("accountid").alias("_a"), F.col("yearweek").alias("_w"),
                             "pro_percent")
    j = sellout.join(p, (sellout["accountid"] == p["_a"]) & (sellout["yearweek"] == p["_w"]),
                     "left")
    return j.select(*[sellout[c] for c in sellout.columns], "pro_percent")
