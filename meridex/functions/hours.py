"""Hours as integers, calendar parts and flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000
# Public holidays (month, day) and the new-year period.
HOLIDAYS = ((1, 1), (1, 2), (1, 7), (3, 8), (3, 21), (3, 22), (3, 23), (5, 1), (5, 7), (5, 9), (7, 6), (8, 30), (10, 25), (12, 16))


def hour_index(ts: Column | str) -> Column:
    """Whole hours since 1970 of a timestamp without or with zone (UTC session)."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_micros(c.cast("timestamp")) / F.lit(HOUR_US)).cast("long")


def hour_start(hour: Column | str) -> Column:
    """The start of an hour index as a timestamp without zone."""
    c = F.col(hour) if isinstance(hour, str) else hour
    return F.timestamp_seconds(c * 3600).cast("timestamp_ntz")


def season(month: Column) -> Column:
    return F.when(month.isin(12, 1, 2), "winter").when(month.isin(3, 4, 5), "spring").when(month.isin(6, 7, 8), "summer").when(month.isin(9, 10, 11), "autumn")


def calendar_parts(ts: str) -> dict[str, Column]:
    """hour, Monday-0 weekday, day, month, quarter, year, season and weekend of a timestamp column."""
    c = F.col(ts)
    return {
        "hour": F.hour(c), "weekday": F.weekday(c), "day": F.dayofmonth(c), "month": F.month(c), "quarter": F.quarter(c), "year": F.year(c),
        "season": season(F.month(c)), "is_weekend": F.weekday(c) >= 5,
    }


def is_holiday(date: Column) -> Column:
    return (F.month(date) * 100 + F.dayofmonth(date)).isin([m * 100 + d for m, d in HOLIDAYS])


def calendar_flags(ts: str) -> dict[str, Column]:
    """Holiday, the days around it, rush hours, school breaks, the new-year period and night."""
    c, date = F.col(ts), F.to_date(ts)
    md = F.month(c) * 100 + F.dayofmonth(c)
    work = F.weekday(c) < 5
    return {
        "is_holiday": is_holiday(date), "is_day_before_holiday": is_holiday(F.date_add(date, 1)), "is_day_after_holiday": is_holiday(F.date_sub(date, 1)),
        "is_morning_rush": work & F.hour(c).between(7, 9), "is_evening_rush": work & F.hour(c).between(17, 19),
        "is_school_break": md.between(601, 831) | md.between(1226, 1231) | md.between(101, 110) | md.between(321, 331),
        "is_new_year_period": (md >= 1225) | (md <= 110), "is_night": (F.hour(c) >= 22) | (F.hour(c) < 6),
    }


def daylight(day_of_year: Column, latitude: float) -> Column:
    """Length of the day in hours from the sun's declination, 0 to 24."""
    decl = F.radians(F.lit(-23.44)) * F.cos(F.lit(6.283185307179586 / 365) * (day_of_year + 10))
    x = -F.tan(F.radians(F.lit(latitude))) * F.tan(decl)
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))) * 24 / 3.141592653589793


def sun_times(at: Column, sunrise: Column, sunset: Column) -> dict[str, Column]:
    """Day length, dark hours and hours until sunrise and sunset (0 when past) of epoch seconds; nulls stay null."""
    length = (sunset - sunrise) / 3600
    until = lambda x: F.when(x.isNotNull(), F.greatest((x - at) / 3600, F.lit(0.0)))
    return {"day_length": length, "dark_hours": F.when(length.isNotNull(), F.greatest(24 - length, F.lit(0.0))), "until_sunrise": until(sunrise), "until_sunset": until(sunset)}


def dew_point(celsius: Column, humidity: Column) -> Column:
    """Dew point by the Magnus formula; humidity in percent, 0.1 at least."""
    a, b = 17.62, 243.12  # fixed values of the formula
    gamma = F.log(F.greatest(humidity, F.lit(0.1)) / 100) + a * celsius / (b + celsius)
    return b * gamma / (a - gamma)
