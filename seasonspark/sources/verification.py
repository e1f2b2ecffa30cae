"""Observations that sub-seasonal forecasts are verified by, and reshaping of seasonal tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dekad_climatology(obs: DataFrame, target: Column, first: int, last: int) -> DataFrame:
    """cell, year and value of the dekads that begin on the target's day of the year, within the years. obs: cell, d (start), value."""
    same = (F.dayofyear("d") == F.dayofyear(target)) & F.year("d").between(first, last)
    return obs.where(same).select("cell", F.year("d").alias("year"), "value")


def live_dekad(daily: DataFrame, target: Column, days: int = 10) -> DataFrame:
    """cell and value: the mean over the days from the target on, for cells that have each of them."""
    own = daily.where(F.col("d").between(target, F.date_add(target, days - 1)) & F.col("value").isNotNull())
    return own.groupBy("cell").agg(F.avg("value").alias("value"), F.count_distinct("d").alias("_n")).where(F.col("_n") == days).drop("_n")


def obs_with_fallback(keys: DataFrame, final: DataFrame, live: DataFrame) -> DataFrame:
    """cell, d, value and origin: the finalised value where there is one, else the live one; keys without either are left out."""
    j = keys.select("cell", "d").distinct().join(final.select("cell", "d", F.col("value").alias("_f")), ["cell", "d"], "left").join(live.select("cell", "d", F.col("value").alias("_l")), ["cell", "d"], "left")
    out = j.select("cell", "d", F.coalesce("_f", "_l").alias("value"), F.when(F.col("_f").isNotNull(), "final").otherwise("live").alias("origin"))
    return out.where("value IS NOT NULL")


def model_seasons(rows: DataFrame, first: int, last: int) -> DataFrame:
    """cell, year, member and value: the mean over leads, of the years from first to last. rows: cell, d (valid date), member, lead, value."""
    return rows.where(F.year("d").between(first, last)).groupBy("cell", F.year("d").alias("year"), "member").agg(F.avg("value").alias("value"))


def obs_seasons(rows: DataFrame, months: list[int], first: int, last: int) -> DataFrame:
    """cell, year and value: the mean over some months of each calendar year. rows: cell, d, value."""
    return rows.where(F.month("d").isin(months) & F.year("d").between(first, last)).groupBy("cell", F.year("d").alias("year")).agg(F.avg("value").alias("value"))


def common_or_raw(reforecast: DataFrame | None, obs: DataFrame) -> DataFrame | None:
    """year: the years that reforecast and observations share, RuntimeError if there are none; null without a reforecast."""
    if reforecast is None:
        return None
    years = reforecast.select("year").distinct().join(obs.select("year").distinct(), "year")
    if not years.limit(1).count():
        raise RuntimeError("reforecast and observations share no year")
    return years


def event_dates(events: DataFrame, start: Column, step: str) -> DataFrame:
    """Adds date: the season's start plus the event's step; null without an event."""
    return events.withColumn("date", F.date_add(start, F.col(step).cast("int")))


def season_widths(rows: DataFrame, first: Column, last: Column) -> DataFrame:
    """year and width: days of each season year. rows: year."""
    return rows.select("year").distinct().select("year", (F.datediff(last, first) + 1).alias("width"))
