"""Completion of a season under way with the rest of analog years."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def scenarios(observed: DataFrame, analog: DataFrame, forecast: DataFrame | None = None, first: str = "observed") -> DataFrame:
    """cell, scenario, step, value, segment: a season for each analog year.

    observed, forecast: cell, step, value; analog: cell, year, step, value. Observed steps come before forecast ones (or after, by `first`) and both
    before the analog's; `first="error"` refuses steps that have both.
    """
    if first not in ("observed", "forecast", "error"):
        raise ValueError(f"unknown order {first!r}")
    a = analog.select("cell", F.col("year").alias("scenario"), "step", F.col("value").alias("_a"))
    rows = a.join(observed.select("cell", "step", F.col("value").alias("_o")), ["cell", "step"], "left")
    f = F.lit(None).cast("double")
    if forecast is not None:
        rows = rows.join(forecast.select("cell", "step", F.col("value").alias("_f")), ["cell", "step"], "left")
        f = F.col("_f")
        if first == "error" and not rows.where("_o IS NOT NULL AND _f IS NOT NULL").isEmpty():
            raise ValueError("observed and forecast steps overlap")
    o = F.col("_o")
    order = [(f, "forecast"), (o, "observed")] if first == "forecast" else [(o, "observed"), (f, "forecast")]
    named = F.when(order[0][0].isNotNull(), order[0][1]).when(order[1][0].isNotNull(), order[1][1]).otherwise("analog")
    return rows.select("cell", "scenario", "step", F.coalesce(order[0][0], order[1][0], F.col("_a")).alias("value"), named.alias("segment"))


def totals(rows: DataFrame, steps: int) -> DataFrame:
    """cell, scenario, total; null unless every step is there."""
    return rows.groupBy("cell", "scenario").agg(F.when(F.count("value") == steps, F.sum("value")).alias("total"))


def consensus(rows: DataFrame, how: str | float = "median", weights: DataFrame | None = None) -> DataFrame:
    """cell, consensus: mean or quantile of the totals, null where one is null.

    A weighted quantile stands at the middle of each total's weight, with linear interpolation between. weights: scenario, weight; a row an analog year.
    """
    whole = F.count("total") == F.count(F.lit(1))
    q = 0.5 if how == "median" else how
    if weights is None:
        value = F.avg("total") if how == "mean" else F.percentile("total", F.lit(float(q)))
        return rows.groupBy("cell").agg(F.when(whole, value).alias("consensus"))
    j = rows.join(weights, "scenario")
    if how == "mean":
        return j.groupBy("cell").agg(F.when(whole, F.sum(F.col("weight") * F.col("total")) / F.sum("weight")).alias("consensus"))
    cell, order = Window.partitionBy("cell"), Window.partitionBy("cell").orderBy("total", "scenario")
    upto = F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, 0))
    p = (upto - 0.5 * F.col("weight")) / F.sum("weight").over(cell)
    t = j.withColumn("_p", p).withColumns({"_q": F.lead("_p").over(order), "_t": F.lead("total").over(order), "_first": F.min("_p").over(cell)})
    at = F.when(F.col("_p") < q, F.when(F.col("_q").isNull(), F.col("total")).when(F.col("_q") >= q, F.col("total") + (q - F.col("_p")) / (F.col("_q") - F.col("_p")) * (F.col("_t") - F.col("total"))))
    at = F.when((F.col("_p") == F.col("_first")) & (F.col("_p") >= q), F.col("total")).otherwise(at)
    return t.groupBy("cell").agg(F.when(whole, F.max(at)).alias("consensus"))
