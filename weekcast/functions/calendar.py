"""ISO year-week arithmetic as Column expressions.

A week key is the string ``YYYYWW`` (ISO-8601 week-numbering year and week:
weeks start on Monday, week 1 holds the year's first Thursday).  Inside plans
the Monday ``DATE`` of the week is the working form: adding ``g`` weeks is
adding ``7*g`` days, so year rollover and 53-week years need no loop.

All functions are built from Spark SQL built-ins and stay inside whole-stage
codegen; none calls Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def year_of(yw: ColumnOrName) -> Column:
    """Integer year part of a ``YYYYWW`` key (NULL when not numeric)."""
    return F.substring(_col(yw), 1, 4).try_cast("int")


def week_of(yw: ColumnOrName) -> Column:
    """Integer week part of a ``YYYYWW`` key (NULL when not numeric)."""
    return F.substring(_col(yw), 5, 2).try_cast("int")


def iso_year(d: ColumnOrName) -> Column:
    """ISO week-numbering year of a date / timestamp."""
    return F.extract(F.lit("YEAROFWEEK"), _col(d).cast("date"))


def iso_week(d: ColumnOrName) -> Column:
    """ISO week number (1..53) of a date / timestamp."""
    return F.weekofyear(_col(d).cast("date"))


def week_start(d: ColumnOrName) -> Column:
    """Monday of the ISO week holding ``d`` (DATE)."""
    return F.date_trunc("week", _col(d).cast("date")).cast("date")


def yearweek(d: ColumnOrName) -> Column:
    """``YYYYWW`` key of the ISO week holding date / timestamp ``d``."""
    d = _col(d).cast("date")
    return F.concat(F.lpad(iso_year(d).cast("string"), 4, "0"),
                    F.lpad(iso_week(d).cast("string"), 2, "0"))


def yearweek_int(d: ColumnOrName) -> Column:
    """``YYYYWW`` of a date as INT.  Same order as the string key; min / max over it
    run in a hash aggregate (string min / max force a sort-based aggregate)."""
    d = _col(d).cast("date")
    return iso_year(d) * 100 + iso_week(d)


def yearweek_str(k: ColumnOrName) -> Column:
    """INT ``YYYYWW`` back to the 6-character key."""
    return F.lpad(_col(k).cast("string"), 6, "0")


def valid_yearweek(yw: ColumnOrName) -> Column:
    """Whether the key names an ISO week: six digits, year from 1 on, week 1 to the last week
    of that year.  NULL for a NULL key."""
    y, w = year_of(yw), week_of(yw)
    return _col(yw).rlike("^[0-9]{6}$") & (y >= 1) & (w >= 1) & (
        (w <= 52) | ((w == 53) & (weeks_in_year(y) == 53)))


def monday(yw: ColumnOrName) -> Column:
    """Monday (DATE) of week key ``yw``.

    Week 1 is the week holding January 4th, so its Monday is
    ``date_trunc('week', Jan 4)``; week ``w`` starts ``7*(w-1)`` days later.
    A key that names no week (not six digits, week 00, week 53 of a year of
    52, ...) gives NULL, never an exception and never another week's Monday.
    """
    y, w = year_of(yw), week_of(yw)
    jan4 = F.make_date(y, F.lit(1), F.lit(4))
    return F.when(valid_yearweek(yw),
                  F.date_add(F.date_trunc("week", jan4).cast("date"), (w - 1) * 7))


def week_add(yw: ColumnOrName, gap: int | Column) -> Column:
    """Week key ``gap`` weeks after ``yw`` (negative gap goes back)."""
    g = gap if isinstance(gap, Column) else F.lit(int(gap))
    return yearweek(F.date_add(monday(yw), g * 7))


def weeks_between(start_yw: ColumnOrName, end_yw: ColumnOrName) -> Column:
    """Whole weeks from ``start_yw`` to ``end_yw`` (may be negative)."""
    return (F.datediff(monday(end_yw), monday(start_yw)) / 7).cast("int")


def weeks_in_year(year: ColumnOrName | int) -> Column:
    """52 or 53: the ISO week number of December 28th of ``year``."""
    y = F.lit(year) if isinstance(year, int) else _col(year)
    return F.weekofyear(F.make_date(y, F.lit(12), F.lit(28)))


def week_sequence(start: ColumnOrName, stop: ColumnOrName) -> Column:
    """Array of Mondays from date ``start`` to date ``stop`` inclusive, step 1 week.

    Empty when ``stop < start`` (guarded so ``sequence`` never sees a
    negative step).
    """
    s, e = _col(start), _col(stop)
    return F.when(e >= s, F.sequence(s, e, F.expr("INTERVAL 7 DAYS"))) \
            .otherwise(F.array().cast("array<date>"))


def first_monday(year: int):
    """Python date of the Monday of ISO week 1 of ``year``.  ``iso_year(d) >= year`` holds
    exactly when ``d >= first_monday(year)``, a plain bound a file scan can use."""
    import datetime as dt
    return dt.date.fromisocalendar(year, 1, 1)


def wing_length(window: int) -> int:
    """Half-width of a centred window of odd width ``window``."""
    if window <= 0 or window % 2 == 0:
        raise ValueError(f"window must be a positive odd number, got {window}")
    return (window - 1) // 2
