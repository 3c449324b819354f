"""Scalar Column helpers: clamps, guarded division, rounding, price formulas.

Everything is a built-in expression (no Python UDF) so it fuses into
whole-stage codegen next to the scan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def clamp_upper(c: ColumnOrName, cap) -> Column:
    """``min(c, cap)``; NULL stays NULL."""
    c = _col(c)
    return F.when(c > _lit(cap), _lit(cap)).otherwise(c)


def clamp_lower(c: ColumnOrName, floor) -> Column:
    """``max(c, floor)``; NULL stays NULL."""
    c = _col(c)
    return F.when(c < _lit(floor), _lit(floor)).otherwise(c)


def clamp(c: ColumnOrName, lo, hi) -> Column:
    """Two-sided clamp ``lo <= c <= hi``."""
    return clamp_upper(clamp_lower(c, lo), hi)


def clip_band(c: ColumnOrName, centre: ColumnOrName, width: ColumnOrName) -> Column:
    """Clip ``c`` into ``centre +- width``.

    A NULL band (e.g. the sample stddev of a one-row frame) leaves ``c``
    unclipped, as a SQL ``CASE`` falling through to ``ELSE`` would.
    """
    c, m, s = _col(c), _col(centre), _col(width)
    return (F.when(c > m + s, m + s)
             .when(c < m - s, m - s)
             .otherwise(c))


def safe_div(num: ColumnOrName, den: ColumnOrName, default=1.0) -> Column:
    """``num/den``, or ``default`` when ``den`` is 0 (X20; ANSI would raise)."""
    n, d = _col(num), _col(den)
    return F.when(d == 0, _lit(default)).otherwise(n / d)


def round_half_up(c: ColumnOrName) -> Column:
    """Nearest integer, halves toward +inf (``floor(x+0.5)``), as BIGINT."""
    return F.floor(_col(c) + F.lit(0.5)).cast("bigint")


def discounted(price: ColumnOrName, rate: ColumnOrName) -> Column:
    """``price - price*rate``."""
    p = _col(price)
    return p - p * _col(rate)


def discount_guard(discount: ColumnOrName, price: ColumnOrName) -> Column:
    """A discount larger than the price is replaced by 0 (X10; numeric compare, Q9)."""
    d = _col(discount)
    return F.when(d > _col(price), F.lit(0.0)).otherwise(d)


def promo_prices(price: ColumnOrName, ir: ColumnOrName) -> dict[str, Column]:
    """Promotion price columns from an imputed list price and a rebate.

    pmap   = price - ir           (0 when price is 0)
    pmap10 = 0.9 * pmap           (0 when pmap is 0)
    pct    = 1 - pmap10 / price   (0 when pmap10 is 0)
    ir     = 0 when price is 0
    """
    p, r = _col(price), _col(ir)
    pmap = F.when(p == 0, F.lit(0.0)).otherwise(p - r)
    pmap10 = F.when(pmap == 0, F.lit(0.0)).otherwise(pmap * 0.9)
    pct = F.when(pmap10 == 0, F.lit(0.0)).otherwise(1 - pmap10 / p)
    return {"ir": F.when(p == 0, F.lit(0.0)).otherwise(r), "pmap": pmap, "pmap10": pmap10,
            "pro_percent": pct}


def any_null(cols: list[ColumnOrName]) -> Column:
    """TRUE when any of ``cols`` is NULL (F3); a plain predicate, so it pushes down."""
    out = F.lit(False)
    for c in cols:
        out = out | _col(c).isNull()
    return out


def int_div(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Integral division (SQL ``div``) of integers; exact over the whole BIGINT range."""
    return F.call_function("div", _col(a).cast("decimal(20,0)"), _col(b).cast("decimal(20,0)"))


def half_up_div(num: ColumnOrName, den: ColumnOrName) -> Column:
    """``num / den`` rounded to the nearest integer, halves toward +inf, on integers
    (``den`` positive)."""
    n, d = _col(num).cast("decimal(25,0)"), _col(den).cast("decimal(25,0)")
    twice = n * 2 + d
    quotient = F.call_function("div", twice, d * 2)
    # div cuts toward zero; a negative remainder means one less
    return quotient - F.when((twice < 0) & (twice % (d * 2) != 0), 1).otherwise(0)


def to_micros(c: ColumnOrName) -> Column:
    """A number to six places as a BIGINT of millionths (exact from there on)."""
    return (_col(c).cast("decimal(18,6)") * F.lit(1_000_000).cast("decimal(7,0)")).cast("bigint")


def hundredths_half_up(num: ColumnOrName, den: ColumnOrName) -> Column:
    """``num/den`` rounded half-up to 2 places, as integer hundredths (BIGINT).

    ``num`` may be fractional: it is taken to six places exactly.  Two-place rounding of a
    double mean depends on summation order; this does not.
    """
    return half_up_div(to_micros(num), _col(den).cast("decimal(14,0)") * 10_000)
