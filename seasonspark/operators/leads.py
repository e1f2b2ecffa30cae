"""Real forecasts by lead: lengths of steps, windows, daily increments. fc: cell, lead, value and others (issuance: init)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOWS = {"week1": (1, 7), "week2": (8, 14), "week3": (15, 21), "week4": (22, 28), "weeks12": (1, 14), "weeks34": (15, 28), "month": (1, 30)}
PER_DAY = {"day": 1.0, "d": 1.0, "hour": 24.0, "hr": 24.0, "h": 24.0, "second": 86400.0, "sec": 86400.0, "s": 86400.0}
HOW = ("mean", "sum", "max", "min")
#: Steps of a lead axis, at most; they are held by the driver.
MOST_LEADS = 10_000


def in_days(lead: Column, units: str = "hours") -> Column:
    units = units.lower()
    if units.startswith("hour"):
        return lead / 24.0
    if units.startswith("day"):
        return lead * 1.0
    raise ValueError(f"unknown lead units {units!r}")


def day_of(days: Column) -> Column:
    """The day, from 1, that a step ends in; a lead of 0 is day 0."""
    return F.ceil(F.round(days, 9)).cast("int")


def rate_factor(units: str) -> tuple[float | None, str]:
    """(factor a day, units of the amount) of a rate such as mm/day or kg m-2 s-1; (None, units) of anything else."""
    text = units.strip()
    m = re.match(r"(.+?)\s*(?:/\s*|\s+)([A-Za-z]+)(?:\^?-1)?$", text)
    per = PER_DAY.get(m[2].lower()) if m else None
    return (per, m[1].strip()) if per else (None, text)


def lead_axis(fc: DataFrame, units: str = "hours") -> DataFrame:
    """lead, days, day and length (days since the step before; the first since the issuance, or if it has none, as the second), a row a lead."""
    axis = fc.select("lead", in_days(F.col("lead"), units).alias("days")).distinct()
    w = Window.orderBy("days")
    first = F.when(F.col("days") > 0, F.col("days")).otherwise(F.coalesce(F.lead("days").over(w) - F.col("days"), F.lit(1.0)))
    return axis.select("lead", "days", day_of(F.col("days")).alias("day"), F.coalesce(F.col("days") - F.lag("days").over(w), first).alias("length"))


def held_axis(fc: DataFrame, units: str) -> list:
    axis = lead_axis(fc, units).orderBy("days").limit(MOST_LEADS + 1).collect()
    if len(axis) > MOST_LEADS:
        raise ValueError(f"more than {MOST_LEADS} leads")
    return axis


def one_issuance(fc: DataFrame) -> DataFrame:
    """fc without its issuance, of which there must be one."""
    if "init" not in fc.columns:
        return fc
    if len(fc.select("init").distinct().limit(2).collect()) != 1:
        raise ValueError("one issuance at a time: select one first")
    return fc.drop("init")


def reduced(fc: DataFrame, windows: dict[str, tuple[int, int]], keys: list[str], how: str = "mean", units: str | None = None, lead_units: str = "hours", complete: bool = True) -> DataFrame:
    """keys, window and value: the leads of each window of days as one value, and units of the result as the column's metadata.

    Means count steps by their lengths where some are under a day; sums of rates are integrated over the steps, amounts are added.
    """
    if how not in HOW:
        raise ValueError(f"how must be one of {HOW}")
    axis = held_axis(fc, lead_units)
    chosen, factor, amount = [], *rate_factor(units or "")
    sub = {}
    for name, (a, z) in windows.items():
        own = [x for x in axis if a <= x.day <= z]
        days = {x.day for x in own}
        if a > z or not own:
            raise ValueError(f"window {name!r} ({a} to {z}) selects no leads")
        if complete and len(days) < z - a + 1:
            raise ValueError(f"window {name!r} has {len(days)} of its {z - a + 1} days")
        sub[name] = any(x.length < 1 - 1e-9 for x in own)
        if how == "sum" and units is None and sub[name]:
            raise ValueError("steps under a day: a sum needs units, to tell rates from amounts")
        chosen += [(name, sub[name], float(x.lead), float(x.length)) for x in own]
    table = fc.sparkSession.createDataFrame(chosen, "window string, _sub boolean, _lead double, _w double")
    rows = fc.join(F.broadcast(table), F.col("lead").cast("double") == F.col("_lead"))  # MOST_LEADS a window at most
    v, w = F.col("value"), F.col("_w")
    if how in ("max", "min"):
        value = getattr(F, how)(v)
    elif how == "mean":
        value = F.when(F.first("_sub"), F.sum(v * w) / F.sum(F.when(v.isNotNull(), w))).otherwise(F.avg(v))
    else:
        value = F.coalesce(F.sum(v if factor is None else v * w * factor), F.lit(0.0))
    out = rows.groupBy(*keys, "window").agg(value.alias("value"))
    return out.withMetadata("value", {"units": amount if how == "sum" and factor else units or ""})


def forecast_window(fc: DataFrame, window: str | tuple[int, int], keys: list[str], **how) -> DataFrame:
    """keys and value: one window of one issuance."""
    if isinstance(window, str):
        if window not in WINDOWS:
            raise ValueError(f"unknown window {window!r}; there are {sorted(WINDOWS)}")
        window = WINDOWS[window]
    return reduced(one_issuance(fc), {"window": window}, keys, **how).drop("window")


def increments(fc: DataFrame, init: str, keys: list[str], how: str = "sum", **more) -> DataFrame:
    """keys, d and value: one value for each calendar day from the issuance on; a last day with fewer steps than the day before is left out."""
    fc = one_issuance(fc)
    axis = held_axis(fc, more.get("lead_units", "hours"))
    steps: dict[int, int] = {}
    for x in axis:
        if x.day >= 1:
            steps[x.day] = steps.get(x.day, 0) + 1
    days = sorted(steps)
    if not days:
        raise ValueError("there are no steps after the issuance")
    if any(x.length < 1 - 1e-9 for x in axis) and len(days) > 1 and steps[days[-1]] < steps[days[-2]]:
        days.pop()
    out = reduced(fc, {str(n): (n, n) for n in days}, keys, how, complete=False, **more)
    return out.select(*keys, F.date_add(F.lit(init).cast("date"), F.col("window").cast("int") - 1).alias("d"), "value")
