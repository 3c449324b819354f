"""Canonical datasets derived from the provided star schema.

The workload reads weekly sell-out tables keyed by region / product / week,
promotion plans, key-correction tables and masters.  Each is defined here as
a DataFrame over the provided Parquet tables, so every query's work grows with
the input tables.

Plan shape: every join is left to Catalyst + AQE, which broadcasts a side only when its measured runtime size is
under ``spark.sql.autoBroadcastJoinThreshold`` and otherwise shuffles both
sides on the join key (skewed partitions are split by AQE skew-join).
Aggregations run partial (map-side) before their shuffle.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekcast.functions.calendar import monday, week_start, yearweek, yearweek_int, yearweek_str
from weekcast.sources.sinks import materialize
from weekcast.sources.tables import load

# Fixed values of the derived promotion table: brands whose list price is
# recorded as zero (no promotion price known), and the years from the first
# order to the first plan week, so that some target weeks lie before it.
ZERO_PRICE_BRAND = "Brand#3"
RETURN_ZERO_PRICE_BRANDS = ("Brand#1", "Brand#2")
YEARS_BEFORE_PLANS = 4


def customer_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer -> nation -> region (customer key, segment, nation, region)."""
    n = load(spark, sf_dir, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    r = load(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    nr = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name",
                                                                        "r_name")
    c = load(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_mktsegment"])
    return c.join(nr, c.c_nationkey == nr.n_nationkey) \
            .select("c_custkey", "c_mktsegment", "n_name", "r_name")


def line_facts(spark: SparkSession, sf_dir: str, since=None) -> DataFrame:
    """One row per lineitem with its customer geography and part attributes.

    Columns not used downstream are pruned by Catalyst down to the scans.
    ``since`` (a date) keeps ship dates on or after it as a plain column
    bound, which the Parquet scan uses to skip row groups.
    """
    li = load(spark, sf_dir, "lineitem", ["l_orderkey", "l_partkey", "l_quantity",
                                          "l_extendedprice", "l_discount", "l_returnflag",
                                          "l_linestatus", "l_shipdate"])
    if since is not None:
        li = li.filter(F.col("l_shipdate") >= F.lit(since))
    o = load(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])
    og = o.join(customer_geo(spark, sf_dir), o.o_custkey == F.col("c_custkey"))
    p = load(spark, sf_dir, "part", ["p_partkey", "p_brand", "p_type", "p_size",
                                     "p_retailprice"])
    return li.join(og, li.l_orderkey == og.o_orderkey).join(p, li.l_partkey == p.p_partkey)


def weekly_sales(spark: SparkSession, sf_dir: str, since=None) -> DataFrame:
    """(regionid, product, yearweek, qty): weekly shipped quantity per region and brand
    (ship dates from ``since`` on, when given)."""
    f = line_facts(spark, sf_dir, since)
    g = (f.groupBy(F.col("r_name").alias("regionid"), F.col("p_brand").alias("product"),
                   yearweek_int("l_shipdate").alias("_yw"))
          .agg(F.sum("l_quantity").alias("qty")))
    return g.select("regionid", "product", yearweek_str("_yw").alias("yearweek"), "qty")


def sales_base(spark: SparkSession, sf_dir: str, since=None) -> DataFrame:
    """The star join aggregated once at the finest grain the sales and promotion
    tables need: (region, size class, type, nation, segment, brand, ship week).

    ``sales_detail`` and ``promotion`` both roll up from it (sum / max / min
    compose), so a pipeline that needs both reads the line items once.
    """
    f = line_facts(spark, sf_dir, since)
    zero = (F.col("p_brand") == ZERO_PRICE_BRAND) | (
        F.col("p_brand").isin(*RETURN_ZERO_PRICE_BRANDS) & (F.col("l_returnflag") == "R"))
    price = F.when(zero, F.lit(0.0)).otherwise(F.floor("p_retailprice").cast("double"))
    keys = ["regionseg1", "productseg1", "productseg2", "regionseg2", "regionseg3",
            "productseg3"]
    g = (f.groupBy(F.col("r_name").alias("regionseg1"),
                   F.when(F.col("p_size") <= 25, "SMALL").otherwise("LARGE")
                   .alias("productseg1"),
                   F.col("p_type").alias("productseg2"),
                   F.col("n_name").alias("regionseg2"),
                   F.col("c_mktsegment").alias("regionseg3"),
                   F.col("p_brand").alias("productseg3"),
                   yearweek_int("l_shipdate").alias("_yw"))
          .agg(F.sum("l_quantity").alias("qty"),
               F.max(price).alias("_max_price"),
               F.max(F.col("p_retailprice") * F.col("l_discount")).alias("_max_ir"),
               F.min(yearweek_int("o_orderdate")).alias("_min_order_week")))
    return g.select(*keys, yearweek_str("_yw").alias("yearweek"), "qty", "_max_price",
                    "_max_ir", "_min_order_week")


def ship_mondays(spark: SparkSession, sf_dir: str):
    """Mondays (dates) of the first and the last week with a shipped line: one row of one column."""
    row = load(spark, sf_dir, "lineitem", ["l_shipdate"]).agg(
        week_start(F.min("l_shipdate")).alias("first"), week_start(F.max("l_shipdate")).alias("last")).first()
    return row["first"], row["last"]


def recent_sales(spark: SparkSession, sf_dir: str, weeks: int, columns) -> DataFrame:
    """``columns`` of the six-segment sales of the last sales week and the ``weeks`` before it,
    written once as a stage; it may hold earlier weeks too.

    Lines before a bound on the ship date are not joined.  The newest lines may have no order,
    customer or part, so the last *sales* week can lie before the last shipped one: the bound
    moves back until the stage has a week, and once more if it does not reach far enough.
    """
    first, last = ship_mondays(spark, sf_dir)
    columns, back = list(columns), weeks
    while True:
        since = None if last is None else last - timedelta(weeks=back)
        sales = materialize(sales_detail(spark, sf_dir, since=since).select(*columns), "sales-recent")
        newest = sales.agg(monday(yearweek_str(F.max(F.col("yearweek").cast("int")))).alias("m")).first()["m"]
        if newest is not None and newest - timedelta(weeks=weeks) >= since:
            return sales
        if since is None or since <= first:  # all lines were read
            return sales
        if newest is not None:
            back = (last - newest).days // 7 + weeks
        else:
            back = 4 * back + 1


def sales_detail(spark: SparkSession, sf_dir: str, base: DataFrame | None = None,
                 since=None) -> DataFrame:
    """Six-segment weekly sales (the ``pro_actual_sales`` layout, lower-case names)."""
    b = base if base is not None else sales_base(spark, sf_dir, since)
    return b.select("regionseg1", "productseg1", "productseg2", "regionseg2", "regionseg3",
                    "productseg3", "yearweek",
                    F.substring("yearweek", 1, 4).cast("int").alias("year"),
                    F.substring("yearweek", 5, 2).cast("int").alias("week"), "qty")


def promotion(spark: SparkSession, sf_dir: str, base: DataFrame | None = None) -> DataFrame:
    """Promotion plan rows (regionseg, salesid, productgroup, item, targetweek, planweek,
    map_price, ir) per region, nation, type, brand and ship week.

    map_price: the largest list price of the week's lines (0 for brands without a
    known price); ir: the largest rebate; planweek: the first order week, not
    before the first week of the year ``YEARS_BEFORE_PLANS`` after the table's
    first order.  ``base`` is read twice: write it once and pass it.
    """
    b = base if base is not None else sales_base(spark, sf_dir)
    first_year = F.floor(F.min("_min_order_week") / 100) + YEARS_BEFORE_PLANS
    first_plan = b.agg(yearweek_str(first_year * 100 + 1)).scalar()
    return (b.groupBy(F.col("regionseg1").alias("regionseg"),
                      F.col("regionseg2").alias("salesid"),
                      F.col("productseg2").alias("productgroup"),
                      F.col("productseg3").alias("item"), F.col("yearweek").alias("targetweek"))
             .agg(F.min("_min_order_week").alias("_first"),
                  F.max("_max_price").alias("map_price"),
                  F.max("_max_ir").alias("ir"))
             .select("regionseg", "salesid", "productgroup", "item", "targetweek",
                     F.greatest(yearweek_str("_first"), first_plan).alias("planweek"),
                     "map_price", "ir"))


def account_promo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(accountid, yearweek, pro_percent, o_orderkey): promotion percentage per order.

    Several orders of one account can fall in one week, so (accountid,
    yearweek) is not unique: lookups must pick a row by an explicit order.
    """
    o = load(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"])
    return o.select(F.col("o_custkey").cast("string").alias("accountid"),
                    yearweek("o_orderdate").alias("yearweek"),
                    ((F.floor("o_totalprice").cast("bigint") % 30) / 100.0).alias("pro_percent"),
                    "o_orderkey")


def sellout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(regionid, accountid, yearweek, qty): weekly quantity per region and account."""
    f = line_facts(spark, sf_dir)
    g = (f.groupBy(F.col("r_name").alias("regionid"), F.col("o_custkey").alias("_acc"),
                   yearweek_int("l_shipdate").alias("_yw"))
          .agg(F.sum("l_quantity").alias("qty")))
    return g.select("regionid", F.col("_acc").cast("string").alias("accountid"),
                    yearweek_str("_yw").alias("yearweek"), "qty")


#: Accounts of this segment are billed to one payer; any other account pays for itself.
PAYER_SEGMENT = "BUILDING"


def _payer(account: str, segment: str):
    return F.when(F.col(segment) == PAYER_SEGMENT, F.col(segment)).otherwise(
        F.col(account).cast("string"))


def _quarter(yw: str):
    """Year and quarter (weeks 1-13, ...; week 53 to the last) of an integer week key, YYYYQ."""
    week = F.col(yw) % 100
    return F.floor(F.col(yw) / 100) * 10 + F.least(F.floor((week - 1) / 13), F.lit(3)) + 1


def payer_sellout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(payer, quarter, regionid, accountid, yearweek, qty): sell-out by paying account.

    One payer holds the accounts of a whole segment, so (payer, quarter) is a hot key.
    """
    g = (line_facts(spark, sf_dir)
         .groupBy(F.col("r_name").alias("regionid"), F.col("o_custkey").alias("_acc"),
                  F.col("c_mktsegment").alias("_seg"), yearweek_int("l_shipdate").alias("_yw"))
         .agg(F.sum("l_quantity").alias("qty")))
    return g.select(_payer("_acc", "_seg").alias("payer"), _quarter("_yw").alias("quarter"), "regionid",
                    F.col("_acc").cast("string").alias("accountid"),
                    yearweek_str("_yw").alias("yearweek"), "qty")


def payer_promo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(payer, quarter, percent): the whole promotion percentage of each order, by payer."""
    o = load(spark, sf_dir, "orders", ["o_custkey", "o_orderdate", "o_totalprice"])
    c = load(spark, sf_dir, "customer", ["c_custkey", "c_mktsegment"])
    return o.join(c, o.o_custkey == c.c_custkey).withColumn("_yw", yearweek_int("o_orderdate")).select(
        _payer("o_custkey", "c_mktsegment").alias("payer"), _quarter("_yw").alias("quarter"),
        (F.floor("o_totalprice").cast("bigint") % 30).alias("percent"))


def key_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key-correction table (suta_tin -> mata_tin) with blank-padded source keys.

    One row per order, of any status: an account key may map to several new keys, so
    "first" / "last" need the explicit order (o_orderdate, o_orderkey).
    """
    o = load(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate",
                                       "o_orderstatus"])
    return o.select(F.concat(F.lit(" "), F.col("o_custkey").cast("string"), F.lit(" "))
                    .alias("suta_tin"),
                    F.concat(F.lit("K"), F.col("o_orderkey").cast("string")).alias("mata_tin"),
                    "o_orderdate", "o_orderkey", "o_orderstatus")


def tax_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts whose key is to be corrected (the ``joindata1`` role): padded key + attributes."""
    c = load(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_mktsegment"])
    return c.select(F.concat(F.col("c_custkey").cast("string"), F.lit("  ")).alias("suta_tin"),
                    "c_name", "c_mktsegment")


def region_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(regionid, regionname): all regions but the first, plus the nations of region 0.

    So the sales side has a region missing from the master (left join gives
    NULL names) and the master has ids absent from sales (right join rows).
    """
    r = load(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    n = load(spark, sf_dir, "nation", ["n_name", "n_regionkey"])
    a = r.filter(F.col("r_regionkey") > 0).select(
        F.col("r_name").alias("regionid"),
        F.concat(F.col("r_name"), F.lit(" REGION")).alias("regionname"))
    b = n.filter(F.col("n_regionkey") == 0).select(
        F.col("n_name").alias("regionid"),
        F.concat(F.col("n_name"), F.lit(" NATION")).alias("regionname"))
    return a.unionByName(b)


def sellout_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw weekly volumes as an upstream system would export them: all columns are strings.

    ``yearweek`` is written without zero padding (``20163`` for week 3), so
    some keys are malformed; ``volume`` (open lines) and ``target`` (returned
    lines) are NULL for weeks without such lines, and a volume that leaves 3
    when divided by 7 carries its unit, so it is no number.
    """
    f = line_facts(spark, sf_dir)
    d = F.col("l_shipdate").cast("date")
    raw_yw = F.concat(F.extract(F.lit("YEAROFWEEK"), d).cast("string"),
                      F.weekofyear(d).cast("string"))
    return (f.groupBy(F.col("r_name").alias("regionid"), F.col("p_brand").alias("productgroup"),
                      raw_yw.alias("yearweek"))
             .agg(F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_quantity")))
                  .cast("bigint").alias("_v"),
                  F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")))
                  .cast("bigint").cast("string").alias("target"))
             .select("regionid", "productgroup", "yearweek",
                     F.when(F.col("_v") % 7 == 3, F.concat(F.col("_v").cast("string"),
                                                            F.lit(" EA")))
                     .otherwise(F.col("_v").cast("string")).alias("volume"), "target"))


#: Types of the typed view of ``sellout_raw``.
SELLOUT_TYPES = {"regionid": "string", "productgroup": "string", "yearweek": "string",
                 "volume": "double", "target": "double"}


def promo_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(regionid, productgroup, yearweek, price, discount) for weeks with returned lines."""
    f = line_facts(spark, sf_dir).filter(F.col("l_returnflag") == "R")
    g = (f.groupBy(F.col("r_name").alias("regionid"), F.col("p_brand").alias("productgroup"),
                   yearweek_int("l_shipdate").alias("_yw"))
          .agg(F.max("p_retailprice").alias("price"),
               F.max(F.col("l_extendedprice") * F.col("l_discount")).alias("discount")))
    return g.select("regionid", "productgroup", yearweek_str("_yw").alias("yearweek"), "price",
                    "discount")


def sales_and_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly volume and, where lines were returned, price and discount: one pass over the
    lines for what ``weekly_sales`` and ``promo_data`` hold."""
    back = F.col("l_returnflag") == "R"
    g = (line_facts(spark, sf_dir)
         .groupBy(F.col("r_name").alias("regionid"), F.col("p_brand").alias("productgroup"),
                  yearweek_int("l_shipdate").alias("_yw"))
         .agg(F.sum("l_quantity").alias("volume"),
              F.max(F.when(back, F.col("p_retailprice"))).alias("price"),
              F.max(F.when(back, F.col("l_extendedprice") * F.col("l_discount")))
              .alias("discount"),
              F.count(F.when(back, 1)).alias("n_returned")))
    return g.select("regionid", "productgroup", yearweek_str("_yw").alias("yearweek"), "volume",
                    "price", "discount", "n_returned")


def dt_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision-tree input: weekly sales with holiday / promotion categories."""
    j = sales_and_returns(spark, sf_dir).withColumnRenamed("productgroup", "product") \
                                        .withColumnRenamed("volume", "qty")
    week = F.substring("yearweek", 5, 2).cast("int")
    return j.select("regionid", "product",
                    F.col("yearweek").cast("int").alias("yearweek"),
                    F.when(week.isin(1, 52, 53), "Y").otherwise("N").alias("holiday"),
                    F.when(F.col("price").isNotNull(), "Y").otherwise("N").alias("promotion"),
                    F.coalesce(F.least(F.col("discount") / F.col("price"), F.lit(1.0)),
                               F.lit(0.0)).alias("pro_percent"),
                    "qty")


def student_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three numeric scores per customer (the ``sw``, ``db``, ``and`` layout)."""
    o = load(spark, sf_dir, "orders", ["o_custkey", "o_totalprice"])
    c = load(spark, sf_dir, "customer", ["c_custkey", "c_acctbal"])
    agg = o.groupBy("o_custkey").agg(F.count(F.lit(1)).cast("double").alias("sw"),
                                     (F.sum("o_totalprice") / 1000.0).alias("db"))
    return c.join(agg, c.c_custkey == agg.o_custkey) \
            .select("c_custkey", "sw", "db", (F.col("c_acctbal") / 1000.0).alias("and"))
