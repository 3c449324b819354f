"""Independent DuckDB SQL for every registered query (the correctness oracle).

Written directly in SQL against the provided tables, not generated from the
Spark plans.  Derived datasets are CTEs; ``sql(views, body)`` prepends the
ones a query needs, in dependency order.
"""

from __future__ import annotations


def yw(d: str) -> str:
    """ISO ``YYYYWW`` of a date / timestamp expression."""
    return (f"(lpad(CAST(isoyear(CAST({d} AS DATE)) AS VARCHAR), 4, '0') || "
            f"lpad(CAST(week(CAST({d} AS DATE)) AS VARCHAR), 2, '0'))")


def monday(k: str) -> str:
    """Monday (DATE) of week key ``k``."""
    return (f"(CAST(date_trunc('week', make_date(CAST(substr({k}, 1, 4) AS INTEGER), 1, 4)) "
            f"AS DATE) + 7 * (CAST(substr({k}, 5, 2) AS INTEGER) - 1))")


def week_add(k: str, g) -> str:
    return yw(f"({monday(k)} + 7 * ({g}))")


def r6(e: str, alias: str) -> str:
    return f"round({e}, 6) AS {alias}"


VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def _view(name: str, deps: tuple[str, ...], body: str) -> None:
    VIEWS[name] = (deps, f"{name} AS ({body})")


_view("line_facts", (), """
  SELECT l.l_orderkey, l.l_partkey, l.l_quantity, l.l_extendedprice, l.l_discount,
         l.l_returnflag, l.l_linestatus, l.l_shipdate, o.o_custkey, o.o_orderdate,
         c.c_mktsegment, n.n_name, r.r_name, p.p_brand, p.p_type, p.p_size, p.p_retailprice
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  JOIN part p ON l.l_partkey = p.p_partkey""")

_view("weekly_sales", ("line_facts",), f"""
  SELECT r_name AS regionid, p_brand AS product, {yw('l_shipdate')} AS yearweek,
         SUM(l_quantity) AS qty
  FROM line_facts GROUP BY 1, 2, 3""")

_view("sales_detail", ("line_facts",), f"""
  SELECT regionseg1, productseg1, productseg2, regionseg2, regionseg3, productseg3, yearweek,
         CAST(substr(yearweek, 1, 4) AS INTEGER) AS year,
         CAST(substr(yearweek, 5, 2) AS INTEGER) AS week, qty
  FROM (SELECT r_name AS regionseg1,
               CASE WHEN p_size <= 25 THEN 'SMALL' ELSE 'LARGE' END AS productseg1,
               p_type AS productseg2, n_name AS regionseg2, c_mktsegment AS regionseg3,
               p_brand AS productseg3, {yw('l_shipdate')} AS yearweek,
               SUM(l_quantity) AS qty
        FROM line_facts GROUP BY 1, 2, 3, 4, 5, 6, 7) t""")

_view("promotion", ("line_facts",), f"""
  SELECT r_name AS regionseg, n_name AS salesid, p_type AS productgroup, p_brand AS item,
         {yw('l_shipdate')} AS targetweek,
         greatest(min({yw('o_orderdate')}), (
           SELECT lpad(CAST(CAST(substr(min({yw('o_orderdate')}), 1, 4) AS INTEGER) + 4 AS VARCHAR),
                       4, '0') || '01' FROM line_facts)) AS planweek,
         max(CASE WHEN p_brand = 'Brand#3'
                    OR (p_brand IN ('Brand#1', 'Brand#2') AND l_returnflag = 'R')
                  THEN 0.0 ELSE CAST(floor(p_retailprice) AS DOUBLE) END) AS map_price,
         max(p_retailprice * l_discount) AS ir
  FROM line_facts GROUP BY 1, 2, 3, 4, 5""")

_view("account_promo", (), f"""
  SELECT CAST(o_custkey AS VARCHAR) AS accountid, {yw('o_orderdate')} AS yearweek,
         (CAST(floor(o_totalprice) AS BIGINT) % 30) / 100.0 AS pro_percent, o_orderkey
  FROM orders""")

_view("sellout", ("line_facts",), f"""
  SELECT r_name AS regionid, CAST(o_custkey AS VARCHAR) AS accountid,
         {yw('l_shipdate')} AS yearweek, SUM(l_quantity) AS qty
  FROM line_facts GROUP BY 1, 2, 3""")

_view("key_fix", (), """
  SELECT ' ' || CAST(o_custkey AS VARCHAR) || ' ' AS suta_tin,
         'K' || CAST(o_orderkey AS VARCHAR) AS mata_tin, o_orderdate, o_orderkey
  FROM orders""")

_view("tax_accounts", (), """
  SELECT CAST(c_custkey AS VARCHAR) || '  ' AS suta_tin, c_name, c_mktsegment FROM customer""")

_view("region_master", (), """
  SELECT r_name AS regionid, r_name || ' REGION' AS regionname FROM region WHERE r_regionkey > 0
  UNION ALL
  SELECT n_name AS regionid, n_name || ' NATION' AS regionname FROM nation
  WHERE n_regionkey = 0""")

_view("sellout_raw", ("line_facts",), """
  SELECT regionid, productgroup, yearweek,
         CASE WHEN v % 7 = 3 THEN v || ' EA' ELSE CAST(v AS VARCHAR) END AS volume,
         CAST(t AS VARCHAR) AS target
  FROM (SELECT r_name AS regionid, p_brand AS productgroup,
               CAST(isoyear(CAST(l_shipdate AS DATE)) AS VARCHAR)
                 || CAST(week(CAST(l_shipdate AS DATE)) AS VARCHAR) AS yearweek,
               CAST(SUM(CASE WHEN l_linestatus = 'O' THEN l_quantity END) AS BIGINT) AS v,
               CAST(SUM(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS BIGINT) AS t
        FROM line_facts GROUP BY 1, 2, 3) x""")

_view("promo_data", ("line_facts",), f"""
  SELECT r_name AS regionid, p_brand AS productgroup, {yw('l_shipdate')} AS yearweek,
         max(p_retailprice) AS price, max(l_extendedprice * l_discount) AS discount
  FROM line_facts WHERE l_returnflag = 'R' GROUP BY 1, 2, 3""")


def sql(views, body: str, extra: str = "") -> str:
    """``WITH <views and their dependencies>[, <extra CTEs>] <body>``."""
    order: list[str] = []

    def visit(v):
        if v in order:
            return
        for d in VIEWS[v][0]:
            visit(d)
        order.append(v)

    for v in views:
        visit(v)
    ctes = [VIEWS[v][1] for v in order] + ([extra.strip()] if extra.strip() else [])
    if not ctes:
        return body
    return "WITH " + ",\n".join(ctes) + "\n" + body


ORACLE: dict[str, str] = {}

# --------------------------------------------------------------------------- seasonality

_C8 = f"""
c8_clean AS (
  SELECT regionid, product, yearweek, CASE WHEN qty < 0 THEN 0.0 ELSE qty END AS qty
  FROM weekly_sales WHERE CAST(substr(yearweek, 5, 2) AS INTEGER) <= 52),
c8_ma AS (
  SELECT *, avg(qty) OVER (PARTITION BY regionid, product ORDER BY yearweek
                           ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING) AS ma FROM c8_clean),
c8_sd AS (
  SELECT *, stddev_samp(ma) OVER (PARTITION BY regionid, product ORDER BY yearweek
                                  ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS stddev
  FROM c8_ma),
c8_ref AS (
  SELECT *, ma + stddev AS upper_bound, ma - stddev AS lower_bound,
         CASE WHEN qty > ma + stddev THEN ma + stddev
              WHEN qty < ma - stddev THEN ma - stddev ELSE qty END AS refined
  FROM c8_sd),
c8_sm AS (
  SELECT *, avg(refined) OVER (PARTITION BY regionid, product ORDER BY yearweek
                               ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS smoothed
  FROM c8_ref),
c8 AS (
  SELECT *, CASE WHEN smoothed = 0 THEN 1.0 ELSE qty / smoothed END AS seasonality_stable,
            CASE WHEN smoothed = 0 THEN 1.0 ELSE refined / smoothed END AS seasonality_unstable
  FROM c8_sm)"""


def _c8(body: str) -> str:
    return sql(["weekly_sales"], body, _C8)


ORACLE["seasonality_robust"] = _c8(f"""
SELECT regionid, product, yearweek, qty, {r6('ma', 'ma')}, {r6('stddev', 'stddev')},
       {r6('upper_bound', 'upper_bound')}, {r6('lower_bound', 'lower_bound')},
       {r6('refined', 'refined')}, {r6('smoothed', 'smoothed')},
       {r6('seasonality_stable', 'seasonality_stable')},
       {r6('seasonality_unstable', 'seasonality_unstable')}
FROM c8""")

ORACLE["seasonality_robust_region"] = ORACLE["seasonality_robust"].replace(
    "PARTITION BY regionid, product ORDER BY yearweek", "PARTITION BY regionid ORDER BY yearweek, product")

ORACLE["seasonality_profile"] = _c8(f"""
SELECT regionid, product, qty, substr(yearweek, 5, 2) AS week,
       {r6('avg(seasonality_stable)', 'seasonality_stable')},
       {r6('avg(seasonality_unstable)', 'seasonality_unstable')}
FROM c8 GROUP BY regionid, product, qty, substr(yearweek, 5, 2)""")

ORACLE["seasonality_profile_by_week"] = _c8(f"""
SELECT regionid, product, substr(yearweek, 5, 2) AS week,
       {r6('avg(seasonality_stable)', 'seasonality_stable')},
       {r6('avg(seasonality_unstable)', 'seasonality_unstable')}
FROM c8 GROUP BY regionid, product, substr(yearweek, 5, 2)""")

ORACLE["seasonality_forecast"] = _c8(f"""
SELECT regionid, product, qty, week, {r6('s', 'seasonality_stable')},
       {r6('qty * s', 'forecast_qty')}
FROM (SELECT regionid, product, qty, substr(yearweek, 5, 2) AS week,
             avg(seasonality_stable) AS s
      FROM c8 GROUP BY regionid, product, qty, substr(yearweek, 5, 2)) t""")

# --------------------------------------------------------------------------- calendar

ORACLE["week_arith"] = sql(["weekly_sales"], f"""
SELECT yearweek, {week_add('yearweek', 1)} AS next_week, {week_add('yearweek', -20)} AS minus_20,
       {week_add('yearweek', 53)} AS plus_53, {week_add('yearweek', 110)} AS plus_110,
       CAST(week(make_date(CAST(substr(yearweek, 1, 4) AS INTEGER), 12, 28)) AS INTEGER)
         AS weeks_in_year,
       {monday('yearweek')} AS monday,
       CAST((({monday("'200101'")}) - ({monday('yearweek')})) / 7 AS INTEGER) AS weeks_to_200101
FROM (SELECT DISTINCT yearweek FROM weekly_sales) t""")

# --------------------------------------------------------------------------- cleaning

ORACLE["clean_volume"] = sql(["weekly_sales"], """
SELECT regionid || product AS key, regionid, product, yearweek,
       CASE WHEN qty < 20.0 THEN 20.0 WHEN qty > 100.0 THEN 100.0 ELSE qty END AS qty
FROM weekly_sales
WHERE 1 = 1 AND product IN ('Brand#1', 'Brand#2', 'Brand#3') AND qty > 10
  AND CAST(substr(yearweek, 5, 2) AS INTEGER) <= 52
  AND CAST(substr(yearweek, 1, 4) AS INTEGER) >= 1996""")

ORACLE["raw_week_check"] = sql(["sellout_raw"], """
SELECT regionid, productgroup, yearweek, length(yearweek) = 6 AS len_ok,
       length(yearweek) <= 6 AS not_too_long,
       length(yearweek) = 6 AND TRY_CAST(substr(yearweek, 5, 2) AS INTEGER) <= 52 AS week_ok
FROM sellout_raw""")

ORACLE["null_report"] = sql(["sellout_raw"], """
SELECT regionid, productgroup, yearweek, volume, target, volume IS NULL AS volume_is_null
FROM sellout_raw WHERE volume IS NULL OR target IS NULL""")

ORACLE["null_fill"] = sql(["sellout_raw"], """
SELECT regionid, productgroup, yearweek, coalesce(volume, '0') AS volume,
       coalesce(target, '0') AS target
FROM sellout_raw""")

ORACLE["any_null_rows"] = sql(["sellout_raw"], """
SELECT * FROM sellout_raw
WHERE regionid IS NULL OR productgroup IS NULL OR yearweek IS NULL OR volume IS NULL
   OR target IS NULL""")

ORACLE["typed_view"] = sql(["sellout_raw"], """
SELECT regionid, productgroup, yearweek, TRY_CAST(volume AS DOUBLE) AS volume,
       coalesce(TRY_CAST(target AS DOUBLE), 0.0) AS target
FROM sellout_raw""")

_VALID = """(length({k}) = 6 AND TRY_CAST(substr({k}, 5, 2) AS INTEGER) BETWEEN 1 AND
  week(make_date(CAST(substr({k}, 1, 4) AS INTEGER), 12, 28)))"""

ORACLE["reject_report"] = sql(["sellout_raw"], f"""
SELECT regionid, productgroup, yearweek, volume, target, concat_ws('; ',
         CASE WHEN bad_number THEN 'bad double in volume' END,
         CASE WHEN bad_week THEN 'bad week key in yearweek' END) AS reason
FROM (SELECT *, volume IS NOT NULL AND TRY_CAST(volume AS DOUBLE) IS NULL AS bad_number,
             NOT {_VALID.format(k='yearweek')} AS bad_week FROM sellout_raw) x
WHERE bad_number OR bad_week""")

ORACLE["week_validity"] = sql(["sellout_raw"], f"""
SELECT yearweek, valid, CASE WHEN valid THEN {monday('yearweek')} END AS monday,
       CASE WHEN valid THEN {week_add('yearweek', 1)} END AS next_week,
       CASE WHEN {_VALID.format(k="(substr(yearweek, 1, 4) || '53')")}
            THEN {monday("(substr(yearweek, 1, 4) || '53')")} END AS monday_of_week_53
FROM (SELECT DISTINCT yearweek, {_VALID.format(k='yearweek')} AS valid FROM sellout_raw) x""")

ORACLE["csv_roundtrip"] = sql(["weekly_sales"], "SELECT * FROM weekly_sales")

ORACLE["complete_rows"] = sql(["sellout_raw"], """
SELECT * FROM sellout_raw
WHERE regionid IS NOT NULL AND productgroup IS NOT NULL AND yearweek IS NOT NULL
  AND volume IS NOT NULL AND target IS NOT NULL""")

ORACLE["clamp_variants"] = sql(["weekly_sales"], """
SELECT regionid, product, yearweek, qty,
       CASE WHEN qty > 100.0 THEN 100.0 ELSE qty END AS qty_cap,
       CASE WHEN qty < 20.0 THEN 20.0 ELSE qty END AS qty_floor,
       least(greatest(qty, 20.0), 100.0) AS qty_clamped,
       qty * 1.2 AS qty_x12
FROM weekly_sales""")

# --------------------------------------------------------------------------- joins

for _how, _kw in (("inner", "INNER JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN")):
    ORACLE[f"region_join_{_how}"] = sql(["weekly_sales", "region_master"], f"""
SELECT b.regionname, a.regionid, a.product, a.yearweek, a.qty
FROM weekly_sales a {_kw} region_master b ON a.regionid = b.regionid""")

# --------------------------------------------------------------------------- joins

for _how, _kw in (("inner", "INNER JOIN"), ("left", "LEFT JOIN")):
    ORACLE[f"promo_join_using_{_how}"] = sql(["weekly_sales", "promo_data"], f"""
SELECT a.regionid, a.product AS productgroup, a.yearweek, a.qty AS volume, b.price, b.discount,
       CASE WHEN b.discount > b.price THEN 0.0 ELSE b.discount END AS new_discount
FROM weekly_sales a {_kw} promo_data b
  ON a.regionid = b.regionid AND a.product = b.productgroup AND a.yearweek = b.yearweek""")

ORACLE["discounted_price"] = sql(["promo_data"], f"""
SELECT regionid || productgroup AS key, regionid, productgroup, yearweek, price, nd AS new_discount,
       {r6('price - price * (nd / price)', 'sale_price')}
FROM (SELECT *, CASE WHEN discount > price THEN 0.0 ELSE discount END AS nd FROM promo_data) t""")

_C1 = """
c1_p AS (
  SELECT * FROM promotion
  WHERE CAST(targetweek AS INTEGER) >= (SELECT min(CAST(planweek AS INTEGER)) FROM promotion)),
c1_g AS (
  SELECT productgroup, item,
         max(CASE WHEN map_price = 0 THEN 1 ELSE 0 END) AS has_zero,
         sum(map_price) AS s, count(CASE WHEN map_price > 0 THEN 1 END) AS nz,
         first(map_price ORDER BY targetweek, regionseg, salesid) AS fp
  FROM c1_p GROUP BY productgroup, item),
c1_x AS (
  SELECT c1_p.*, CASE WHEN has_zero = 1 THEN (CASE WHEN nz <> 0 THEN s / nz ELSE 0.0 END)
                      ELSE fp END AS price
  FROM c1_p JOIN c1_g USING (productgroup, item)),
c1_y AS (SELECT *, CASE WHEN price = 0 THEN 0.0 ELSE price - ir END AS pmap_u FROM c1_x),
c1_z AS (SELECT *, CASE WHEN pmap_u = 0 THEN 0.0 ELSE pmap_u * 0.9 END AS pmap10_u FROM c1_y),
c1 AS (
  SELECT regionseg, salesid, productgroup, item, targetweek, planweek, price AS map_price,
         CASE WHEN price = 0 THEN 0.0 ELSE ir END AS ir, pmap_u AS pmap,
         CAST(floor(pmap10_u + 0.5) AS BIGINT) AS pmap10,
         CASE WHEN pmap10_u = 0 THEN 0.0 ELSE 1 - pmap10_u / price END AS pro_percent
  FROM c1_z)"""

ORACLE["promo_price_impute"] = sql(["promotion"], f"""
SELECT regionseg, salesid, productgroup, item, targetweek, planweek, {r6('map_price', 'map_price')},
       {r6('ir', 'ir')}, {r6('pmap', 'pmap')}, pmap10, {r6('pro_percent', 'pro_percent')}
FROM c1""", _C1)

_C2 = _C1 + """,
c2 AS (
  SELECT s.regionseg1, s.productseg2, s.regionseg2, s.regionseg3, s.productseg3, s.yearweek,
         s.year, s.week, s.qty, coalesce(p.map_price, 0.0) AS map_price,
         coalesce(p.ir, 0.0) AS ir, coalesce(p.pmap, 0.0) AS pmap,
         coalesce(p.pmap10, 0) AS pmap10, coalesce(p.pro_percent, 0.0) AS pro_percent,
         CASE WHEN coalesce(p.map_price, 0.0) = 0 THEN 'N' ELSE 'Y' END AS promotion_check
  FROM sales_detail s LEFT JOIN c1 p
    ON s.regionseg1 = p.regionseg AND s.productseg2 = p.productgroup
   AND s.regionseg2 = p.salesid AND s.productseg3 = p.item AND s.yearweek = p.targetweek)"""

ORACLE["promo_flag"] = sql(["promotion", "sales_detail"], f"""
SELECT regionseg1, productseg2, regionseg2, regionseg3, productseg3, yearweek, year, week, qty,
       {r6('map_price', 'map_price')}, {r6('ir', 'ir')}, {r6('pmap', 'pmap')}, pmap10,
       {r6('pro_percent', 'pro_percent')}, promotion_check
FROM c2""", _C2)

ORACLE["promo_flag_bucketed"] = ORACLE["promo_flag"]


def _quarter(d: str) -> str:
    return (f"(CAST(isoyear(CAST({d} AS DATE)) AS BIGINT) * 10 + "
            f"least(CAST(floor((week(CAST({d} AS DATE)) - 1) / 13) AS BIGINT), 3) + 1)")


def _payer(account: str) -> str:
    return (f"CASE WHEN c_mktsegment = 'BUILDING' THEN c_mktsegment "
            f"ELSE CAST({account} AS VARCHAR) END")


ORACLE["payer_fanout"] = sql(["line_facts"], f"""
SELECT a.regionid, a.quarter, count(*) AS n_rows, count(b.percent) AS n_pairs,
       sum(CASE WHEN b.percent IS NULL THEN a.qty END) AS qty_unmatched,
       sum(a.qty * b.percent) AS qty_percent
FROM (SELECT payer, quarter, regionid, o_custkey, yearweek, sum(q) AS qty FROM (
        SELECT {_payer('o_custkey')} AS payer, {_quarter('l_shipdate')} AS quarter,
               r_name AS regionid, o_custkey, {yw('l_shipdate')} AS yearweek, l_quantity AS q
        FROM line_facts) x GROUP BY 1, 2, 3, 4, 5) a
LEFT JOIN (SELECT {_payer('o_custkey')} AS payer, {_quarter('o_orderdate')} AS quarter,
                  CAST(floor(o_totalprice) AS BIGINT) % 30 AS percent
           FROM orders JOIN customer ON o_custkey = c_custkey) b
  ON a.payer = b.payer AND a.quarter = b.quarter
GROUP BY 1, 2""")

ORACLE["weekly_sink"] = sql(["weekly_sales"], """
SELECT regionid, product, yearweek,
       CASE WHEN substr(yearweek, 1, 4) = '1998' THEN qty * 2 ELSE qty END AS qty
FROM weekly_sales WHERE yearweek <> '199830'""")

ORACLE["recent_weeks"] = sql(["weekly_sales"], f"""
SELECT regionid, product, yearweek, qty FROM weekly_sales
WHERE yearweek >= (SELECT {week_add('max(yearweek)', -20)} FROM weekly_sales)""")

ORACLE["stats_grouping_sets"] = sql(["weekly_sales"], f"""
SELECT regionid, product, CAST(grouping(regionid, product) AS BIGINT) AS level, count(*) AS cnt,
       sum(qty) AS sum, {r6('avg(qty)', 'mean')}, {r6('stddev_pop(qty)', 'stddev')}
FROM weekly_sales
GROUP BY GROUPING SETS ((regionid, product), (regionid), (product), ())""")

ORACLE["promo_lookup"] = sql(["sellout", "account_promo"], """
SELECT s.regionid, s.accountid, s.yearweek, s.qty, coalesce(a.pro_percent, 0.0) AS pro_percent
FROM sellout s LEFT JOIN (
  SELECT accountid, yearweek, pro_percent,
         row_number() OVER (PARTITION BY accountid, yearweek ORDER BY o_orderkey) AS rn
  FROM account_promo) a
  ON s.accountid = a.accountid AND s.yearweek = a.yearweek AND a.rn = 1""")

ORACLE["promo_fanout"] = sql(["sellout", "account_promo"], """
SELECT s.*, b.pro_percent
FROM sellout s LEFT JOIN account_promo b ON s.accountid = b.accountid AND s.yearweek = b.yearweek
ORDER BY s.regionid, s.accountid, s.yearweek""")

for _pick, _dir in (("first", "ASC"), ("last", "DESC")):
    ORACLE[f"key_overlay_{_pick}"] = sql(["tax_accounts", "key_fix"], f"""
SELECT a.suta_tin, a.c_name, a.c_mktsegment,
       coalesce(b.mata_tin, trim(a.suta_tin)) AS updated_suta_tin
FROM tax_accounts a LEFT JOIN (
  SELECT trim(suta_tin) AS k, mata_tin,
         row_number() OVER (PARTITION BY trim(suta_tin)
                            ORDER BY o_orderdate {_dir}, o_orderkey {_dir}) AS rn
  FROM key_fix) b
  ON trim(a.suta_tin) = b.k AND b.rn = 1""")

ORACLE["key_overlay_fanout"] = sql(["tax_accounts", "key_fix"], """
SELECT CASE WHEN b.k IS NULL THEN trim(a.suta_tin) ELSE b.mata_tin END AS updated_suta_tin,
       CASE WHEN b.k IS NOT NULL THEN b.mata_tin ELSE trim(a.suta_tin) END
         AS updated_suta_tin_nvl2,
       a.suta_tin, a.c_name, a.c_mktsegment
FROM tax_accounts a
LEFT JOIN (SELECT trim(suta_tin) AS k, mata_tin FROM key_fix) b ON trim(a.suta_tin) = b.k""")

ORACLE["param_filter"] = sql(["weekly_sales"], """
SELECT * FROM weekly_sales WHERE regionid IN ('ASIA', 'EUROPE') OR product IN ('Brand#7')""")

ORACLE["param_filter_all"] = sql(["weekly_sales"], "SELECT * FROM weekly_sales")

ORACLE["account_by_key"] = sql(["account_promo"], """
SELECT accountid, yearweek, pro_percent, o_orderkey FROM account_promo WHERE accountid = '7'""")

ORACLE["sql_view"] = sql(["weekly_sales"], """
SELECT regionid, yearweek, sum(qty) AS qty, count(*) AS products FROM weekly_sales
GROUP BY regionid, yearweek""")

# ------------------------------------------------------------------- NULL keys are groups

_NAMED = """
named AS (SELECT b.regionname, a.product, a.yearweek, a.qty
          FROM weekly_sales a LEFT JOIN region_master b ON a.regionid = b.regionid)"""

ORACLE["null_key_stats"] = sql(["weekly_sales", "region_master"], f"""
SELECT regionname, product, yearweek, qty, count(*) OVER w AS cnt, sum(qty) OVER w AS sum,
       {r6('avg(qty) OVER w', 'mean')}, {r6('stddev_pop(qty) OVER w', 'stddev')}
FROM named WINDOW w AS (PARTITION BY regionname)""", _NAMED)

ORACLE["null_key_ratio"] = sql(["weekly_sales", "region_master"], f"""
SELECT regionname, product, yearweek, qty, {r6('m', 'avg_qty')},
       {r6('CASE WHEN m = 0 THEN 1.0 ELSE qty / m END', 'ratio')}
FROM (SELECT *, avg(qty) OVER (PARTITION BY regionname) AS m FROM named) x""", _NAMED)

ORACLE["null_key_seasonality"] = sql(["weekly_sales", "region_master"], """
SELECT regionname, product, yearweek, q AS qty, avg_qty, CAST(CASE WHEN avg_qty = 0 THEN 100
         ELSE CAST(floor(q / avg_qty * 100 + 0.5) AS BIGINT) END AS DOUBLE) / 100 AS ratio
FROM (SELECT *, CAST(floor(avg(q) OVER (PARTITION BY regionname) + 0.5) AS BIGINT) AS avg_qty
      FROM (SELECT *, least(greatest(qty, 0.0), 700000.0) AS q FROM named
            WHERE CAST(substr(yearweek, 5, 2) AS INTEGER) <> 53) y) x""", _NAMED)

ORACLE["null_key_week_index"] = sql(["weekly_sales", "region_master"], f"""
SELECT yearweek, regionname, week_qty, {r6('m', 'mean_week_qty')},
       {r6('CASE WHEN m = 0 THEN 0.0 ELSE week_qty / m END', 'ratio')}
FROM (SELECT *, avg(week_qty) OVER (PARTITION BY regionname) AS m
      FROM (SELECT regionname, yearweek, sum(qty) AS week_qty FROM named GROUP BY 1, 2) y) x""",
                                     _NAMED)

ORACLE["null_key_clusters"] = sql(["weekly_sales", "region_master"], f"""
SELECT regionname, product, sum_qty, rank, {r6('rank / cnt', 'ratio')},
       CASE WHEN rank / cnt <= 0.3 THEN 0 WHEN rank / cnt <= 0.6 THEN 1 ELSE 2 END AS cluster
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY regionname ORDER BY sum_qty DESC, product)
                     AS INTEGER) AS rank, count(*) OVER (PARTITION BY regionname) AS cnt
      FROM (SELECT regionname, product, sum(qty) AS sum_qty FROM named
            WHERE yearweek >= (SELECT {week_add('max(yearweek)', -20)} FROM named)
            GROUP BY regionname, product) y) x""", _NAMED)

# --------------------------------------------------------------------------- aggregates

ORACLE["avg_by_key"] = sql(["weekly_sales"], f"""
SELECT regionid, product, {r6('avg(qty)', 'avg_qty')} FROM weekly_sales GROUP BY 1, 2""")

ORACLE["sum_by_key"] = sql(["sales_detail"], """
SELECT regionseg1, productseg2, productseg3, sum(qty) AS sum_qty FROM sales_detail
GROUP BY 1, 2, 3""")

ORACLE["count_avg"] = sql(["weekly_sales"], f"""
SELECT regionid, product, count(*) AS cnt, {r6('avg(qty)', 'mean')} FROM weekly_sales
GROUP BY 1, 2""")

ORACLE["global_minmax"] = sql(["weekly_sales"], """
SELECT min(yearweek) AS min_yearweek, max(yearweek) AS max_yearweek, min(qty) AS min_qty,
       max(qty) AS max_qty FROM weekly_sales""")

ORACLE["group_minmax"] = sql(["weekly_sales"], """
SELECT regionid, product, min(yearweek) AS min_yearweek, max(yearweek) AS max_yearweek
FROM weekly_sales GROUP BY 1, 2""")

ORACLE["group_stats"] = sql(["weekly_sales"], f"""
SELECT regionid, product, yearweek, qty,
       count(*) OVER (PARTITION BY regionid, product) AS cnt,
       sum(qty) OVER (PARTITION BY regionid, product) AS sum,
       {r6('avg(qty) OVER (PARTITION BY regionid, product)', 'mean')},
       {r6('stddev_pop(qty) OVER (PARTITION BY regionid, product)', 'stddev')}
FROM weekly_sales""")

ORACLE["nonzero_mean"] = sql(["promotion"], f"""
SELECT productgroup, item,
       {r6('CASE WHEN count(CASE WHEN map_price > 0 THEN 1 END) = 0 THEN 0.0 '
           'ELSE sum(map_price) / count(CASE WHEN map_price > 0 THEN 1 END) END', 'nz_mean')}
FROM promotion GROUP BY 1, 2""")

ORACLE["distinct_totals"] = sql(["sales_detail"], """
SELECT DISTINCT regionseg1, productseg2 FROM sales_detail""")

ORACLE["mean_of_sums"] = sql(["sales_detail"], f"""
SELECT regionseg1, productseg2, {r6('avg(s)', 'mean_of_sums')}, count(*) AS n_yearweek
FROM (SELECT regionseg1, productseg2, yearweek, sum(qty) AS s FROM sales_detail GROUP BY 1, 2, 3) t
GROUP BY 1, 2""")

ORACLE["week_index"] = sql(["sales_detail"], f"""
SELECT yearweek, regionseg1, productseg2, week_qty, {r6('m', 'mean_week_qty')},
       {r6('CASE WHEN m = 0 THEN 0.0 ELSE week_qty / m END', 'ratio')}
FROM (SELECT *, avg(week_qty) OVER (PARTITION BY regionseg1, productseg2) AS m
      FROM (SELECT regionseg1, productseg2, yearweek, sum(qty) AS week_qty FROM sales_detail
            GROUP BY 1, 2, 3) a) b""")

ORACLE["pivot_weeks"] = sql(["weekly_sales"], """
SELECT regionid, product, sum(CASE WHEN yearweek = '199801' THEN qty END) AS "199801",
       sum(CASE WHEN yearweek = '199802' THEN qty END) AS "199802"
FROM weekly_sales GROUP BY 1, 2""")

# --------------------------------------------------------------------------- windows

ORACLE["partition_ratio"] = sql(["weekly_sales"], """
SELECT regionid, product, yearweek, qty, CAST(avg_h AS DOUBLE) / 100 AS avg_qty,
       CAST(CASE WHEN avg_h = 0 THEN 100
                 ELSE (20000 * CAST(qty AS BIGINT) + avg_h) // (2 * avg_h) END AS DOUBLE) / 100
         AS ratio
FROM (SELECT *, (200 * CAST(sum(qty) OVER w AS BIGINT) + count(*) OVER w)
                  // (2 * count(*) OVER w) AS avg_h
      FROM weekly_sales
      WHERE CAST(substr(yearweek, 1, 4) AS INTEGER) >= 1996
        AND CAST(substr(yearweek, 5, 2) AS INTEGER) <> 53
        AND product IN ('Brand#1', 'Brand#2')
      WINDOW w AS (PARTITION BY regionid, product)) t""")

ORACLE["partition_ratio_net"] = sql(["line_facts"], """
SELECT regionid, product, CAST(avg_h AS DOUBLE) / 100 AS avg_net,
       CAST(CASE WHEN avg_h = 0 THEN 100 ELSE (2 * u + avg_h * 100) // (2 * avg_h * 100) END
            AS DOUBLE) / 100 AS ratio, count(*) AS n
FROM (SELECT *, (2 * sum(u) OVER w + 10000 * count(*) OVER w) // (20000 * count(*) OVER w) AS avg_h
      FROM (SELECT r_name AS regionid, p_brand AS product,
                   CAST(CAST(l_quantity * (1 - l_discount) AS DECIMAL(18, 6)) * 1000000 AS BIGINT) AS u
            FROM line_facts) y
      WINDOW w AS (PARTITION BY regionid, product)) x
GROUP BY ALL""")

ORACLE["moving_avg_coarse"] = sql(["sales_detail"], f"""
SELECT regionseg1, productseg2, productseg3, yearweek, qty,
       {r6("avg(qty) OVER (PARTITION BY regionseg1 ORDER BY productseg2, productseg3, yearweek "
           "ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)", 'mv_region')},
       {r6("avg(qty) OVER (PARTITION BY regionseg1, productseg2 ORDER BY yearweek, productseg3 "
           "ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)", 'mv_type')}
FROM (SELECT regionseg1, productseg2, productseg3, yearweek, sum(qty) AS qty FROM sales_detail
      GROUP BY 1, 2, 3, 4) x""")

for _n, _wing in (("moving_avg_3", 1), ("moving_avg_5", 2)):
    ORACLE[_n] = sql(["weekly_sales"], f"""
SELECT regionid, product, yearweek, qty,
       {r6(f'avg(qty) OVER (PARTITION BY regionid, product ORDER BY yearweek '
           f'ROWS BETWEEN {_wing} PRECEDING AND {_wing} FOLLOWING)', 'mv_avg')}
FROM weekly_sales""")

ORACLE["group_position"] = sql(["weekly_sales"], """
SELECT *,
       CAST(row_number() OVER (PARTITION BY regionid, product ORDER BY yearweek) - 1 AS INTEGER)
         AS pos
FROM weekly_sales""")

ORACLE["sort_mixed"] = sql(["weekly_sales"], """
SELECT regionid || product AS key, regionid, product, yearweek, qty FROM weekly_sales
WHERE 1 = 1 AND qty > 30 ORDER BY regionid, product DESC, yearweek""")

ORACLE["first_match"] = sql(["weekly_sales"], """
SELECT * FROM weekly_sales WHERE product = 'Brand#7' AND qty > 40
ORDER BY yearweek, regionid LIMIT 1""")

ORACLE["top_n"] = sql(["weekly_sales"], """
SELECT regionid, product, sum_qty FROM (
  SELECT *, row_number() OVER (PARTITION BY regionid ORDER BY sum_qty DESC, product) AS rn
  FROM (SELECT regionid, product, sum(qty) AS sum_qty FROM weekly_sales GROUP BY 1, 2) a) b
WHERE rn <= 3""")

# --------------------------------------------------------------------------- series

_SEG6 = "regionseg1, productseg1, productseg2, regionseg2, regionseg3, productseg3"
_SEG5 = "regionseg1, productseg2, regionseg2, regionseg3, productseg3"


def _missing_weeks(src: str, keys: str, name: str) -> str:
    """CTE ``name``: (keys, m) for Mondays absent between each key's first and last week."""
    return f"""
{name}_b AS (SELECT {keys}, min({monday('yearweek')}) AS mn, max({monday('yearweek')}) AS mx
             FROM {src} GROUP BY {keys}),
{name}_cal AS (SELECT {keys}, CAST(unnest(generate_series(mn, mx, INTERVAL 7 DAY)) AS DATE) AS m
               FROM {name}_b),
{name} AS (SELECT * FROM {name}_cal c WHERE NOT EXISTS (
             SELECT 1 FROM {src} s WHERE {' AND '.join(f's.{k} = c.{k}' for k in
                                                         keys.split(', '))}
               AND {monday('s.yearweek')} = c.m))"""


def _summary(src: str, keys: str, flag: bool = False) -> str:
    extra = ", count(CASE WHEN promotion_check = 'N' THEN 1 END) AS n_flag_n" if flag else ""
    return f"""
SELECT {keys}, count(*) AS n_rows, sum(qty) AS sum_qty,
       count(CASE WHEN qty = 0 THEN 1 END) AS n_zero, min(yearweek) AS min_week,
       max(yearweek) AS max_week{extra}
FROM {src} GROUP BY {keys}"""


ORACLE["fill_weeks_6key"] = sql(["sales_detail"], _summary("f6", _SEG6),
                                _missing_weeks("sales_detail", _SEG6, "miss6") + f""",
f6 AS (SELECT {_SEG6}, yearweek, qty FROM sales_detail
       UNION ALL SELECT {_SEG6}, {yw('m')} AS yearweek, 0.0 AS qty FROM miss6)""")

_C3 = _C2 + "," + _missing_weeks("c2", _SEG5, "miss5") + f""",
c3 AS (SELECT * FROM c2
       UNION ALL
       SELECT {_SEG5}, {yw('m')} AS yearweek, CAST(year(m + 3) AS INTEGER) AS year,
              CAST(week(m) AS INTEGER) AS week, 0.0 AS qty, 0.0 AS map_price, 0.0 AS ir,
              0.0 AS pmap, 0 AS pmap10, 0.0 AS pro_percent, 'N' AS promotion_check
       FROM miss5)"""

ORACLE["fill_weeks_5key"] = sql(["promotion", "sales_detail"], _summary("c3", _SEG5, True), _C3)

ORACLE["future_weeks"] = sql(["weekly_sales"], f"""
SELECT regionid, product, {yw('wk')} AS yearweek, CAST(0.0 AS DOUBLE) AS qty
FROM (SELECT regionid, product,
             CAST(unnest(generate_series(kmax + 7, gmax + 28, INTERVAL 7 DAY)) AS DATE) AS wk
      FROM (SELECT regionid, product, max({monday('yearweek')}) AS kmax FROM weekly_sales
            GROUP BY 1, 2) k,
           (SELECT max({monday('yearweek')}) AS gmax FROM weekly_sales) g) t""")

ORACLE["history_and_future_weeks"] = sql(["weekly_sales"], f"""
SELECT * FROM weekly_sales UNION ALL
SELECT regionid, product, {yw('wk')} AS yearweek, CAST(0.0 AS DOUBLE) AS qty
FROM (SELECT regionid, product,
             CAST(unnest(generate_series(kmax + 7, gmax + 28, INTERVAL 7 DAY)) AS DATE) AS wk
      FROM (SELECT regionid, product, max({monday('yearweek')}) AS kmax FROM weekly_sales
            GROUP BY 1, 2) k,
           (SELECT max({monday('yearweek')}) AS gmax FROM weekly_sales) g) t""")

_SEG3 = "regionseg1, productseg2, productseg3"
ORACLE["filled_weeks"] = sql(["sales_detail"], f"""
SELECT {_SEG3}, yearweek, year, week, qty, 'Y' AS promotion_check FROM seg3
UNION ALL
SELECT {_SEG3}, {yw('m')}, CAST(isoyear(m) AS INTEGER), CAST(week(m) AS INTEGER), 0.0, 'N'
FROM miss3""", f"""
seg3 AS (SELECT {_SEG3}, yearweek, year, week, sum(qty) AS qty FROM sales_detail GROUP BY ALL),
""" + _missing_weeks("seg3", _SEG3, "miss3"))

_C5 = _missing_weeks("weekly_sales", "regionid, product", "missw") + f""",
c5_f AS (SELECT regionid, product, yearweek, qty FROM weekly_sales
         UNION ALL SELECT regionid, product, {yw('m')}, 0.0 FROM missw),
c5 AS (SELECT *, CASE WHEN moving_avg = 0 THEN 1.0 ELSE qty / moving_avg END AS seasonality
       FROM (SELECT *, avg(qty) OVER (PARTITION BY regionid, product ORDER BY yearweek
                                      ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS moving_avg
             FROM c5_f) t)"""

ORACLE["seasonality_ratio"] = sql(["weekly_sales"], f"""
SELECT regionid, product, yearweek, qty, {r6('moving_avg', 'moving_avg')},
       {r6('seasonality', 'seasonality')} FROM c5""", _C5)

ORACLE["active_items"] = sql(["sales_detail"], f"""
SELECT s.* FROM sales_detail s JOIN (
  SELECT {_SEG5} FROM (SELECT {_SEG5}, max(yearweek) AS kmax FROM sales_detail
                       GROUP BY {_SEG5}) k
  WHERE kmax >= (SELECT {week_add('max(yearweek)', -7)} FROM sales_detail)) a
USING ({_SEG5})""")

# --------------------------------------------------------------------------- clusters

ORACLE["item_clusters"] = sql(["sales_detail"], f"""
SELECT regionseg1, productseg2, productseg3, sum_qty, rank, {r6('rank / cnt', 'ratio')},
       CASE WHEN rank / cnt <= 0.3 THEN 0 WHEN rank / cnt <= 0.6 THEN 1 ELSE 2 END AS cluster
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY regionseg1, productseg2
                                        ORDER BY sum_qty DESC, productseg3)
                     AS INTEGER) AS rank,
                count(*) OVER (PARTITION BY regionseg1, productseg2) AS cnt
      FROM (SELECT regionseg1, productseg2, productseg3, sum(qty) AS sum_qty
            FROM sales_detail
            WHERE yearweek >= (SELECT {week_add('max(yearweek)', -20)} FROM sales_detail)
            GROUP BY regionseg1, productseg2, productseg3) a) b""")

# --------------------------------------------------------------------------- forecasts

ORACLE["forecast_mean4"] = sql(["sales_detail"], f"""
SELECT regionseg1, regionseg2, productseg2, productseg3, {week_add('gmax', 1)} AS fcst_week,
       {r6('avg(qty)', 'fcst')}
FROM sales_detail, (SELECT max(yearweek) AS gmax FROM sales_detail) g
WHERE yearweek > {week_add('gmax', -4)}
GROUP BY regionseg1, regionseg2, productseg2, productseg3, gmax""")


def _c7(src: str, keys: str, name: str) -> str:
    """CTE ``name``: level x seasonality forecast rows for weeks after each key's last week."""
    on = " AND ".join(f"f.{k} = p.{k}" for k in keys.split(", "))
    return f"""
{name}_g AS (SELECT max({monday('yearweek')}) AS gmax FROM {src}),
{name}_k AS (
  SELECT {keys},
         coalesce(sum(CASE WHEN gmax - {monday('yearweek')} <= 21 THEN qty END), 0.0) / 4
           AS fcst,
         coalesce(sum(CASE WHEN gmax - {monday('yearweek')} <= 21 THEN seasonality END), 0.0) / 4
           AS avg_season,
         max({monday('yearweek')}) AS kmax, gmax
  FROM {src}, {name}_g GROUP BY {keys}, gmax),
{name}_p AS (SELECT {keys}, CAST(substr(yearweek, 5, 2) AS INTEGER) AS wn,
                    avg(seasonality) AS target
             FROM {src} GROUP BY {keys}, CAST(substr(yearweek, 5, 2) AS INTEGER)),
{name}_f AS (SELECT {keys}, fcst, avg_season,
                    CAST(unnest(generate_series(kmax + 7, gmax + 28, INTERVAL 7 DAY)) AS DATE)
                      AS wk
             FROM {name}_k),
{name} AS (
  SELECT f.*, {yw('f.wk')} AS yearweek, coalesce(p.target, 0.0) AS seasonality,
         CASE WHEN avg_season <> 0 THEN fcst * coalesce(p.target, 0.0) / avg_season
              ELSE 0.0 END AS fcst_timeseries
  FROM {name}_f f LEFT JOIN {name}_p p ON {on} AND CAST(week(f.wk) AS INTEGER) = p.wn)"""


ORACLE["forecast_level_seasonal"] = sql(["weekly_sales"], f"""
SELECT regionid, product, yearweek, CAST(0.0 AS DOUBLE) AS qty,
       CAST(0.0 AS DOUBLE) AS moving_avg,
       {r6('seasonality', 'seasonality')}, {r6('fcst', 'fcst')},
       {r6('fcst_timeseries', 'fcst_timeseries')}
FROM c7
UNION ALL
SELECT regionid, product, yearweek, qty, {r6('moving_avg', 'moving_avg')},
       {r6('seasonality', 'seasonality')}, 0.0, 0.0
FROM c5""", _C5 + "," + _c7("c5", "regionid, product", "c7"))

ORACLE["forecast_legacy"] = sql(["weekly_sales"], f"""
SELECT regionid, product, yearweek, {r6('s / 4', 'seasonality')}, {r6('fcst', 'fcst')},
       {r6('CASE WHEN avg_season <> 0 THEN fcst * s / avg_season ELSE 0.0 END',
           'fcst_timeseries')}
FROM (SELECT f.regionid, f.product, {yw('f.wk')} AS yearweek, f.fcst, f.avg_season,
             CASE WHEN h.has THEN h.total ELSE 0.0 END AS s
      FROM c7_f f JOIN (
        SELECT regionid, product, sum(seasonality) AS total,
               bool_or(substr(yearweek, 5, 2) = '28') AS has FROM c5 GROUP BY 1, 2) h
      ON f.regionid = h.regionid AND f.product = h.product) x""",
                                 _C5 + "," + _c7("c5", "regionid, product", "c7"))

_E1 = _C3 + f""",
e1_r AS (
  SELECT *, CASE WHEN moving_avg = 0 THEN 1.0 ELSE qty / moving_avg END AS seasonality
  FROM (SELECT *, avg(qty) OVER (PARTITION BY {_SEG5}
                                 ORDER BY yearweek, qty, map_price, ir, pmap, pmap10,
                                          pro_percent, promotion_check
                                 ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS moving_avg
        FROM c3) t),
e1_a AS (
  SELECT r.* FROM e1_r r JOIN (
    SELECT {_SEG5} FROM (SELECT {_SEG5}, max(yearweek) AS kmax FROM e1_r GROUP BY {_SEG5}) k
    WHERE kmax >= (SELECT {week_add('max(yearweek)', -7)} FROM e1_r)) a USING ({_SEG5})),""" + \
    _c7("e1_a", _SEG5, "e1")

ORACLE["demand_forecast"] = sql(["promotion", "sales_detail"], f"""
SELECT {_SEG5}, yearweek, CAST(substr(yearweek, 1, 4) AS INTEGER) AS year,
       CAST(substr(yearweek, 5, 2) AS INTEGER) AS week, 'N' AS promotion_check,
       {r6('seasonality', 'seasonality')}, {r6('fcst', 'fcst')},
       {r6('fcst_timeseries', 'fcst_timeseries')}
FROM e1""", _E1)

ORACLE["demand_forecast_history"] = sql(["promotion", "sales_detail"], f"""
SELECT {_SEG5}, yearweek, CAST(substr(yearweek, 1, 4) AS INTEGER) AS year,
       CAST(substr(yearweek, 5, 2) AS INTEGER) AS week, 0.0 AS qty, 0.0 AS map_price, 0.0 AS ir,
       0.0 AS pmap, 0 AS pmap10, 0.0 AS pro_percent, 'N' AS promotion_check, 0.0 AS moving_avg,
       {r6('seasonality', 'seasonality')}, {r6('fcst', 'fcst')},
       {r6('fcst_timeseries', 'fcst_timeseries')}
FROM e1
UNION ALL
SELECT {_SEG5}, yearweek, year, week, qty, {r6('map_price', 'map_price')}, {r6('ir', 'ir')},
       {r6('pmap', 'pmap')}, pmap10, {r6('pro_percent', 'pro_percent')}, promotion_check,
       {r6('moving_avg', 'moving_avg')}, {r6('seasonality', 'seasonality')}, 0.0, 0.0
FROM e1_a""", _E1)

# ------------------------------------------------------------------- simple seasonality

_C9 = """
c9_c AS (SELECT regionid, product, yearweek,
                CASE WHEN qty < 0 THEN 0.0 WHEN qty > 700000 THEN 700000.0 ELSE qty END AS qty
         FROM weekly_sales WHERE 1 = 1 AND CAST(substr(yearweek, 5, 2) AS INTEGER) <> 53),
c9_m AS (SELECT regionid, product, CAST(floor(avg(qty) + 0.5) AS BIGINT) AS avg_qty
         FROM c9_c GROUP BY regionid, product),
c9 AS (SELECT c.*, m.avg_qty,
              CASE WHEN m.avg_qty = 0 THEN 100
                   ELSE CAST(floor(c.qty / m.avg_qty * 100 + 0.5) AS BIGINT) END AS ratio_h
       FROM c9_c c JOIN c9_m m USING (regionid, product))"""

ORACLE["seasonality_simple"] = sql(["weekly_sales"], """
SELECT regionid, product, yearweek, qty, avg_qty, CAST(ratio_h AS DOUBLE) / 100 AS ratio
FROM c9""", _C9)

ORACLE["seasonality_simple_profile"] = sql(["weekly_sales"], """
SELECT regionid, product, substr(yearweek, 5, 2) AS week,
       CAST((2 * sum(ratio_h) + count(*)) // (2 * count(*)) AS DOUBLE) / 100 AS ratio
FROM c9 GROUP BY regionid, product, substr(yearweek, 5, 2)""", _C9)

# --------------------------------------------------------------------------- page lines

ORACLE["page_lines"] = r"""
SELECT page_id, url, CAST(len(string_split_regex(html, '\r?\n')) AS INTEGER) AS n_lines,
       CAST(length(array_to_string(string_split_regex(html, '\r?\n'), chr(10))) AS INTEGER)
         AS n_chars
FROM pages"""

# ------------------------------------------------------------------- set ops, renames, sorts

ORACLE["missing_weeks"] = sql(["weekly_sales"], f"""
SELECT regionid, product, {yw('m')} AS yearweek FROM missw""",
                              _missing_weeks("weekly_sales", "regionid, product", "missw"))

ORACLE["sales_sorted"] = sql(["sales_detail"], """
SELECT regionseg1 AS REGIONSEG1, productseg1 AS PRODUCTSEG1, productseg2 AS PRODUCTSEG2,
       regionseg2 AS REGIONSEG2, regionseg3 AS REGIONSEG3, productseg3 AS PRODUCTSEG3,
       yearweek AS YEARWEEK, year AS YEAR, week AS WEEK, qty AS QTY
FROM sales_detail
ORDER BY productseg2, regionseg3, productseg3, yearweek, regionseg1, productseg1, regionseg2""")

ORACLE["pivot_measures"] = sql(["weekly_sales"], f"""
SELECT regionid, product, yearweek,
       sum(CASE WHEN measure = 'REAL_QTY' THEN sales END) AS REAL_QTY,
       {r6("sum(CASE WHEN measure = 'PREDICTION_QTY' THEN sales END)", 'PREDICTION_QTY')}
FROM (SELECT regionid, product, yearweek, 'REAL_QTY' AS measure, qty AS sales FROM c5
      UNION ALL
      SELECT regionid, product, yearweek, 'PREDICTION_QTY', moving_avg FROM c5) t
GROUP BY regionid, product, yearweek""", _C5)

# --------------------------------------------------------------------------- ML (M1-M7)

_view("dt_input", ("weekly_sales", "promo_data"), """
  SELECT w.regionid, w.product, CAST(w.yearweek AS INTEGER) AS yearweek,
         CASE WHEN substr(w.yearweek, 5, 2) IN ('01', '52', '53') THEN 'Y' ELSE 'N' END AS holiday,
         CASE WHEN p.price IS NOT NULL THEN 'Y' ELSE 'N' END AS promotion,
         coalesce(least(p.discount / p.price, 1.0), 0.0) AS pro_percent, w.qty
  FROM weekly_sales w LEFT JOIN promo_data p
    ON w.regionid = p.regionid AND w.product = p.productgroup AND w.yearweek = p.yearweek""")

ORACLE["ml_split"] = sql(["dt_input"], """
SELECT CASE WHEN yearweek <= 199952 THEN 'train' ELSE 'test' END AS side, regionid, product,
       yearweek, qty FROM dt_input""")

_INDEX = """
counts AS (
  SELECT 'holiday' AS name, holiday AS label, count(*) AS n FROM dt_input
  WHERE yearweek <= 199952 GROUP BY 2
  UNION ALL
  SELECT 'promotion', promotion, count(*) FROM dt_input WHERE yearweek <= 199952 GROUP BY 2),
indexed AS (
  SELECT name, label, CAST(row_number() OVER (PARTITION BY name ORDER BY n DESC, label) - 1
                           AS DOUBLE) AS category_index, n FROM counts)"""

ORACLE["ml_category_index"] = sql(["dt_input"], "SELECT * FROM indexed", _INDEX)

_PARTS = f"""
shipped AS (SELECT l_partkey, CAST({yw('l_shipdate')} AS INTEGER) AS yearweek FROM line_facts),
part_index AS (
  SELECT 'l_partkey' AS name, label, n,
         CAST(row_number() OVER (ORDER BY n DESC, label) - 1 AS DOUBLE) AS category_index
  FROM (SELECT CAST(l_partkey AS VARCHAR) AS label, count(*) AS n FROM shipped
        WHERE yearweek < 199601 GROUP BY 1) c)"""

ORACLE["ml_part_index"] = sql(["line_facts"],
                              "SELECT name, label, category_index, n FROM part_index", _PARTS)

ORACLE["ml_part_codes"] = sql(["line_facts"], """
SELECT l_partkey_in, count(*) AS n, count(DISTINCT l_partkey) AS n_parts
FROM (SELECT l_partkey, coalesce(category_index, (SELECT CAST(count(*) AS DOUBLE) FROM part_index))
             AS l_partkey_in
      FROM shipped LEFT JOIN part_index ON label = CAST(l_partkey AS VARCHAR)
      WHERE yearweek >= 199601) x
GROUP BY 1""", _PARTS)

ORACLE["ml_features"] = sql(["dt_input"], """
SELECT d.regionid, d.product, d.yearweek, h.category_index AS holiday_in,
       p.category_index AS promotion_in, d.pro_percent
FROM dt_input d JOIN indexed h ON h.name = 'holiday' AND h.label = d.holiday
JOIN indexed p ON p.name = 'promotion' AND p.label = d.promotion
WHERE d.yearweek > 199952""", _INDEX)

ORACLE["ml_mean_predictor"] = sql(["dt_input"], f"""
SELECT {r6('sqrt(avg(e * e))', 'rmse')}, {r6('avg(abs(e))', 'mae')}, count(*) AS n
FROM (SELECT coalesce(m.mean, 0.0) - d.qty AS e FROM dt_input d LEFT JOIN (
        SELECT holiday, promotion, avg(qty) AS mean FROM dt_input WHERE yearweek <= 199952
        GROUP BY 1, 2) m ON m.holiday = d.holiday AND m.promotion = d.promotion
      WHERE d.yearweek > 199952) x""")

ORACLE["dt_leaf_means"] = sql(["dt_input"], """
SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_violations FROM dt_input
WHERE yearweek <= 199952""")

ORACLE["kmeans_nearest"] = """
SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_violations FROM customer c
WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)"""


ORACLE["account_lookup"] = sql(["sellout"], "SELECT * FROM sellout WHERE accountid = '7'")


def _cart(depth: int) -> str:
    """CTEs ``tree{depth}``: every row with its node and the node's training mean (``pred``), by
    greedy variance splits over two flags (lower mean to the left) and one number."""
    out = """
dt AS (SELECT regionid, product, yearweek, qty, holiday, promotion,
              floor(pro_percent * 100) / 100.0 AS x, yearweek <= 199952 AS train FROM dt_input),
vals AS (SELECT x, lead(x) OVER (ORDER BY x) AS nx FROM (SELECT DISTINCT x FROM dt WHERE train) v),
cuts AS (SELECT (x + nx) / 2.0 AS t FROM vals WHERE nx IS NOT NULL),
tree0 AS (SELECT *, '' AS node FROM dt)"""
    for d in range(depth):
        out += f""",
cand{d} AS (
  SELECT node, 0 AS f, CAST(NULL AS DOUBLE) AS t, sum(CASE WHEN holiday = 'N' THEN 1 ELSE 0 END) AS nl,
         sum(CASE WHEN holiday = 'N' THEN qty ELSE 0.0 END) AS sl, count(*) AS n, sum(qty) AS s
  FROM tree{d} WHERE train GROUP BY node
  UNION ALL
  SELECT node, 1, NULL, sum(CASE WHEN promotion = 'N' THEN 1 ELSE 0 END),
         sum(CASE WHEN promotion = 'N' THEN qty ELSE 0.0 END), count(*), sum(qty)
  FROM tree{d} WHERE train GROUP BY node
  UNION ALL
  SELECT node, 2, t, sum(CASE WHEN x <= t THEN k ELSE 0 END), sum(CASE WHEN x <= t THEN q ELSE 0.0 END),
         sum(k), sum(q)
  FROM (SELECT node, x, count(*) AS k, sum(qty) AS q FROM tree{d} WHERE train GROUP BY node, x) g, cuts
  GROUP BY node, t),
gain{d} AS (
  SELECT *, sl * sl / nl + (s - sl) * (s - sl) / (n - nl) - s * s / n AS gain FROM cand{d}
  WHERE nl > 0 AND nl < n),
best{d} AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY round(gain, 6) DESC, f, t) AS rn
                 FROM gain{d} WHERE gain > 1e-9) b WHERE rn = 1),
tree{d + 1} AS (
  SELECT r.* EXCLUDE (node), r.node || CASE
    WHEN b.f IS NULL THEN '.'
    WHEN b.f = 0 THEN r.holiday WHEN b.f = 1 THEN r.promotion
    WHEN r.x <= b.t THEN 'L' ELSE 'R' END AS node
  FROM tree{d} r LEFT JOIN best{d} b ON b.node = r.node)"""
    return out + f""",
leaf AS (SELECT node, avg(qty) AS pred FROM tree{depth} WHERE train GROUP BY node),
predicted AS (SELECT * FROM tree{depth} JOIN leaf USING (node) WHERE NOT train)"""


ORACLE["dt_exact"] = sql(["dt_input"], f"""
SELECT regionid, product, yearweek, qty, {r6('pred', 'prediction')} FROM predicted""", _cart(3))

ORACLE["dt_exact_metrics"] = sql(["dt_input"], f"""
SELECT {r6('sqrt(avg((pred - qty) * (pred - qty)))', 'rmse')}, {r6('avg(abs(pred - qty))', 'mae')},
       count(*) AS n FROM predicted""", _cart(3))


def _lloyd(k: int, rounds: int) -> str:
    dims = ("a", "b", "c")

    def near(centres: str) -> str:
        far = " + ".join(f"(p.{x} - m.{x}) * (p.{x} - m.{x})" for x in dims)
        return f"""SELECT id, {', '.join(f'p_{x} AS {x}' for x in dims)}, min_by(z, (d, z)) AS z FROM (
    SELECT p.id, {', '.join(f'p.{x} AS p_{x}' for x in dims)}, m.z, {far} AS d FROM pt p, {centres} m) q
  GROUP BY id, {', '.join(f'p_{x}' for x in dims)}"""

    out = f"""
pt AS (
  SELECT c_custkey AS id, CAST(n AS DOUBLE) AS a, s / 1000.0 AS b, c_acctbal / 1000.0 AS c FROM customer
  JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS s FROM orders GROUP BY 1) o
    ON o_custkey = c_custkey),
m0 AS (SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS INTEGER) AS z, a, b, c FROM pt
       ORDER BY id LIMIT {k})"""
    for r in range(rounds):
        out += f""",
near{r} AS ({near(f'm{r}')}),
m{r + 1} AS (
  SELECT m.z, {', '.join(f'coalesce(v.{x}, m.{x}) AS {x}' for x in dims)} FROM m{r} m LEFT JOIN (
    SELECT z, {', '.join(f'avg({x}) AS {x}' for x in dims)} FROM near{r} GROUP BY z) v ON v.z = m.z)"""
    return f"WITH {out}, last AS ({near(f'm{rounds}')}) SELECT id AS c_custkey, z AS prediction FROM last"


ORACLE["kmeans_lloyd"] = _lloyd(2, 10)
