"""Dekads, pentads and steps of the year, as expressions over a date."""

from __future__ import annotations

import calendar
import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dekad_start(d: Column) -> Column:
    day = F.dayofmonth(d)
    return F.make_date(F.year(d), F.month(d), F.when(day <= 10, 1).when(day <= 20, 11).otherwise(21))


def dekad_end(start: Column) -> Column:
    """First day after the dekad that begins on start."""
    return F.when(F.dayofmonth(start) < 21, F.date_add(start, 10)).otherwise(F.add_months(F.trunc(start, "MM"), 1))


def dekad_of_year(d: Column) -> Column:
    day = F.dayofmonth(d)
    return (F.month(d) - 1) * 3 + F.when(day <= 10, 1).when(day <= 20, 2).otherwise(3)


def pentad_index(d: Column) -> Column:
    return F.least(F.floor((F.dayofmonth(d) - 1) / 5), F.lit(5)).cast("int")


def pentad_start(d: Column) -> Column:
    return F.make_date(F.year(d), F.month(d), pentad_index(d) * 5 + 1)


def pentad_end(start: Column) -> Column:
    return F.when(F.dayofmonth(start) >= 26, F.add_months(F.trunc(start, "MM"), 1)).otherwise(F.date_add(start, 5))


def step_of_year(d: Column, cadence: str) -> Column:
    """0-based step of the year, for monthly, dekad or pentad steps."""
    if cadence == "monthly":
        return F.month(d) - 1
    if cadence == "dekad":
        return dekad_of_year(d) - 1
    if cadence == "pentad":
        return (F.month(d) - 1) * 6 + pentad_index(d)
    raise ValueError(f"unknown cadence {cadence!r}")


MONTH_INITIALS = "JFMAMJJASOND"


def season_months(code: str) -> list[int]:
    """Months, in order, of a run of month initials such as OND or NDJ; the run must be the only one."""
    ring, code = MONTH_INITIALS * 2, code.upper()
    found = [i for i in range(12) if 2 <= len(code) <= 12 and ring[i : i + len(code)] == code]
    if len(found) != 1:
        raise ValueError(f"{code!r} names {len(found)} seasons")
    return [(found[0] + i) % 12 + 1 for i in range(len(code))]


def season_year(d: Column, months: list[int]) -> Column:
    """The year in which the season that d falls in began; null outside it."""
    first = months[0]
    inside = F.month(d).isin(months)
    return F.when(inside, F.year(d) - F.when(F.month(d) < first, 1).otherwise(0))


def season_step(d: Column, months: list[int]) -> Column:
    """Days since the season's first day; null outside it."""
    year = season_year(d, months)
    return F.when(year.isNotNull(), F.datediff(d, F.make_date(year, F.lit(months[0]), F.lit(1))))


#: Median spacing in days below which a time axis has a cadence, and steps of a year.
CADENCES = ((1.5, "daily"), (6.5, "pentad"), (12.0, "dekad"), (45.0, "monthly"))
STEPS = {"pentad": 72, "dekad": 36, "monthly": 12}


def issuance_dekads(issuance: Column, first_lead: int, last_lead: int) -> Column:
    """Starts of the dekads from the one that holds issuance + first_lead up to issuance + last_lead; the first may begin before the window."""
    last = F.date_add(issuance, last_lead)
    days = F.sequence(dekad_start(F.date_add(issuance, first_lead)), last)
    return F.array_distinct(F.transform(days, dekad_start))


def cadence(stamps: DataFrame, time: str, keys: list[str] | None = None) -> DataFrame:
    """keys, spacing (median days between neighbouring stamps) and cadence, null for a spacing that has none or fewer than two stamps.

    Without keys, of all stamps; neighbours are found on distinct dates, which are few beside the rows.
    """
    from pyspark.sql import Window

    keys = keys or []
    one = stamps.select(*keys, F.col(time).cast("timestamp").alias("_t")).distinct()
    before = F.lag("_t").over(Window.partitionBy(*keys).orderBy("_t"))
    # The whole hours between stamps, as days.
    gap = F.floor((F.unix_timestamp("_t") - F.unix_timestamp(before)) / 3600) / 24
    out = one.select(*keys, gap.alias("_g")).groupBy(*keys).agg(F.percentile("_g", F.lit(0.5)).alias("spacing"))
    name = F.lit(None).cast("string")
    for most, label in reversed(CADENCES):
        name = F.when(F.col("spacing") < most, label).otherwise(name)
    return out.withColumn("cadence", name)


def season_bounds(season: str | tuple, year: int) -> tuple[dt.date, dt.date]:
    """First and last day of a season: a month-initial code, a pair of months (the second may be of the next year) or a pair of dates."""
    if isinstance(season, str):
        months = season_months(season)
        season = months[0], months[-1]
    a, b = season
    if isinstance(a, int) and isinstance(b, int):
        end = year + (b < a)
        return dt.date(year, a, 1), dt.date(end, b, calendar.monthrange(end, b)[1])
    a, b = (dt.date.fromisoformat(x) if isinstance(x, str) else x for x in (a, b))
    return a, b


def step_in_season(d: Column, season: str | tuple, year: int, cadence: str, tail_days: int = 0) -> Column:
    """0-based step of a date in the season that begins in a year, steps counted through the year's end; -1 outside it and its tail."""
    first, last = season_bounds(season, year)
    start, end = F.lit(first), F.date_add(F.lit(last), tail_days)
    if cadence == "daily":
        step = F.datediff(d, start)
    else:
        step = step_of_year(d, cadence) - step_of_year(start, cadence) + (F.year(d) - first.year) * STEPS[cadence]
    return F.when(d.between(start, end), step).otherwise(-1).cast("int")


def season_times(season: str | tuple, year: int, cadence: str) -> Column:
    """The first day of each of the season's steps, as an array; a season that begins within a step begins with that step."""
    first, last = (F.lit(x) for x in season_bounds(season, year))
    if cadence == "daily":
        return F.sequence(first, last)
    if cadence == "monthly":
        return F.sequence(F.trunc(first, "MM"), last, F.expr("interval 1 month"))
    start = {"dekad": dekad_start, "pentad": pentad_start}.get(cadence)
    if start is None:
        raise ValueError(f"unknown cadence {cadence!r}")
    return F.array_distinct(F.transform(F.sequence(start(first), last), start))


def issuance_days(first: Column, last: Column) -> Column:
    """Mondays and Thursdays from first to last, as an array."""
    return F.filter(F.sequence(first, last), lambda d: F.dayofweek(d).isin(2, 5))


def new_issuances(first: Column, last: Column, existing: DataFrame) -> DataFrame:
    """issuance: the valid days that existing, a column issuance, lacks."""
    days = existing.sparkSession.range(1).select(F.explode(issuance_days(first, last)).alias("issuance"))
    return days.join(existing.select("issuance"), "issuance", "left_anti")


def next_targets(seasons: DataFrame, today: Column) -> DataFrame:
    """Of each season the next start that has not begun and the latest initialisation before it that is not in the future.

    seasons: season, start_month, init_months (array). Gives season, season_start, init; seasons without such an initialisation have a null.
    """
    this = F.make_date(F.year(today), F.col("start_month"), F.lit(1))
    start = F.when(this > today, this).otherwise(F.add_months(this, 12))
    inits = F.flatten(F.transform(F.array(F.lit(0), F.lit(-1)), lambda back: F.transform("init_months", lambda m: F.make_date(F.year(start) + back, m, F.lit(1)))))
    init = F.array_max(F.filter(inits, lambda i: (i <= today) & (i < start)))
    return seasons.select("season", start.alias("season_start"), init.alias("init"))
