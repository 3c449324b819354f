from weekcast.functions.calendar import (iso_week, iso_year, monday, week_add, week_of,
                                        week_sequence, week_start, weeks_between,
                                        weeks_in_year, wing_length, year_of, yearweek,
                                        yearweek_int, yearweek_str)
from weekcast.functions.scalar import (any_null, clamp, clamp_lower, clamp_upper, clip_band,
                                      discount_guard, discounted, promo_prices,
                                      round_half_up, safe_div)

__all__ = [
    "iso_week", "iso_year", "monday", "week_add", "week_of", "week_sequence", "week_start",
    "weeks_between", "weeks_in_year", "wing_length", "year_of", "yearweek", "yearweek_int",
    "yearweek_str",
    "any_null", "clamp", "clamp_lower", "clamp_upper", "clip_band", "discount_guard",
    "discounted", "promo_prices", "round_half_up", "safe_div",
]
