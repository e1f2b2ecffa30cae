"""Rolling totals, dry runs, onset, cessation and spells of the rainy season.

Rows: cell, year (season year), step (days since the season's start), value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("cell", "year")


def ordered(*keys: str) -> Window:
    return Window.partitionBy(*(keys or KEYS)).orderBy("step")


def rolling_total(rows: DataFrame, window: int) -> DataFrame:
    """Total of window steps that begin with this one; null where any is missing."""
    w = ordered().rowsBetween(0, window - 1)
    return rows.withColumn("total", F.when(F.count("value").over(w) == window, F.sum("value").over(w)))


def run_length(flag: Column) -> Column:
    """Length of the run of true steps that ends here; null breaks a run."""
    broken = F.max(F.when(~F.coalesce(flag, F.lit(False)), F.col("step"))).over(ordered().rowsBetween(Window.unboundedPreceding, 0))
    first = F.min("step").over(Window.partitionBy(*KEYS))
    return F.col("step") - F.coalesce(broken, first - 1)


def dry_runs(rows: DataFrame, threshold: float) -> DataFrame:
    return rows.withColumn("run", run_length(F.col("value") <= threshold))


def onset(rows: DataFrame, lo: int = 0, hi: int = 10_000, accum_mm: float = 20.0, accum_days: int = 3, dry_mm: float = 1.0, dry_days: int = 7, guard: int = 21) -> DataFrame:
    """First step from lo to hi with enough rain over the next days and no dry spell in the guard after them; the guard must be whole."""
    t = dry_runs(rolling_total(rows, accum_days), dry_mm)
    after = ordered().rowsBetween(accum_days, accum_days + guard - 1)
    spell = ordered().rowsBetween(accum_days + dry_days - 1, accum_days + guard - 1)
    good = (F.col("total") >= accum_mm) & (F.count("value").over(after) == guard) & (F.coalesce(F.max("run").over(spell), F.lit(0)) < dry_days)
    t = t.withColumn("_ok", good & F.col("step").between(lo, hi))
    return t.groupBy(*KEYS).agg(F.min(F.when(F.col("_ok"), F.col("step"))).alias("onset"))


def cessation(rows: DataFrame, onsets: DataFrame, dry_mm: float = 1.0, dry_days: int = 7) -> DataFrame:
    """First dry day, from the onset on, of a run that lasts dry_days."""
    t = dry_runs(rows, dry_mm)
    t = t.withColumn("_ends", F.lead("run", dry_days - 1).over(ordered())).join(onsets, list(KEYS))
    starts = (F.col("run") == 1) & (F.col("_ends") == dry_days) & (F.col("step") >= F.col("onset"))
    return t.groupBy(*KEYS).agg(F.first("onset").alias("onset"), F.min(F.when(starts, F.col("step"))).alias("cessation"))


def dry_spells(rows: DataFrame, dry_mm: float = 1.0, dry_days: int = 7) -> DataFrame:
    t = dry_runs(rows, dry_mm)
    return t.groupBy(*KEYS).agg(F.max("run").alias("longest"), F.count(F.when(F.col("run") == dry_days, 1)).alias("spells"))
