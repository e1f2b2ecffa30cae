"""Calibration of several models to tercile probabilities, and its cross-validated hindcast.

Models and folds become part of the cell's key, so that all are fitted in one job. Tables have a column model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonspark.operators import alignment, logit, methods, validation
from seasonspark.operators.climate import index_box

P = ["p_below", "p_normal", "p_above"]
METHODS = ("ereg", "logit")


def keyed(rows: DataFrame, *extra: str) -> DataFrame:
    """cell stands for the cell and the extra columns together."""
    return rows.withColumn("cell", F.struct("cell", *extra)).drop(*extra)


def opened(rows: DataFrame, *extra: str) -> DataFrame:
    return rows.select(F.col("cell.cell").alias("cell"), *[F.col(f"cell.{e}").alias(e) for e in extra], *[c for c in rows.columns if c != "cell"])


def for_each(obs: DataFrame, keys: DataFrame, most: int = 10_000) -> DataFrame:
    """obs once for each row of keys; more than `most` of these raise an error."""
    if keys.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} models and folds")
    return obs.crossJoin(F.broadcast(keys))


def combined(parts: DataFrame, keys: list[str], combine: str = "mean") -> DataFrame:
    if combine != "mean":
        raise ValueError(f"unknown combination {combine!r}")
    return alignment.model_mean(parts.where(F.col(P[0]).isNotNull()), keys)


def calibrate(predictor: DataFrame, obs: DataFrame, forecast: DataFrame, method: str = "ereg", combine: str = "mean", output: str = "tercile", components: bool = False, **how) -> DataFrame:
    """cell and shares of the models together, or with components of each model (column model); output "deterministic": cell and value.

    ereg: predictor has model, cell, year, member, value, and forecast model, cell, member, value. logit: predictor has model, year, value of an
    index, and forecast model, value.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; there are {METHODS}")
    if output not in ("tercile", "deterministic") or output == "deterministic" and method != "ereg":
        raise ValueError(f"method {method!r} does not give {output!r}")
    alignment.same_models(predictor, forecast)
    models = predictor.select("model").distinct()
    if method == "ereg":
        own = [keyed(t, "model") for t in (predictor, for_each(obs, models), forecast)]
        if output == "deterministic":
            fit = methods.ereg_fit(own[0], own[1]).join(own[2].groupBy("cell").agg(F.avg("value").alias("x")), "cell")
            each = opened(fit.select("cell", (F.col("intercept") + F.col("slope") * F.col("x")).alias("value")), "model")
            return each if components else each.groupBy("cell").agg(F.avg("value").alias("value"))
        each = opened(methods.ereg_forecast(*own, **how), "model")
    else:
        parts = []
        for m in forecast.collect():  # a row a model
            x = predictor.where(F.col("model") == m.model).select("year", "value")
            rows = alignment.same_years(x, obs)
            parts.append(logit.forecast(rows, m.value, **how).withColumn("model", F.lit(m.model)))
        each = parts[0]
        for p in parts[1:]:
            each = each.unionByName(p)
    return each.select("model", "cell", *P) if components else combined(each, ["cell"], combine)


def calibrate_cv(predictor: DataFrame, obs: DataFrame, window: int = 1, combine: str = "mean", components: bool = False, **how) -> DataFrame:
    """year, cell and shares of every year by ereg fits on the years outside the window around it; with components of each model.

    Folds are rows of a broadcast table with at most the square of a record's years; a model without a year has no part in its fold.
    """
    spark = obs.sparkSession
    years = sorted(r.year for r in alignment.years_of(obs).collect())
    folds = [(held[0], y) for held, train in validation.loyo(years, window) for y in train]
    table = F.broadcast(spark.createDataFrame(folds, "fold int, year int"))
    models = predictor.select("model").distinct()
    training = keyed(predictor.join(table, "year"), "model", "fold")
    targets = keyed(for_each(obs.join(table, "year"), models), "model", "fold")
    held = predictor.where(F.col("year").isin(years)).withColumn("fold", F.col("year").cast("int")).drop("year")
    each = opened(methods.ereg_forecast(training, targets, keyed(held, "model", "fold"), **how), "model", "fold").withColumnRenamed("fold", "year")
    return each.select("model", "year", "cell", *P) if components else combined(each, ["year", "cell"], combine)


def fitted_hindcast(hindcast: DataFrame, obs: DataFrame, paired: bool = False) -> DataFrame:
    """cell, year and value of the regression over the hindcast's own years; paired: also obs, of years that have both."""
    fit = methods.ereg_fit(hindcast, obs)
    x = methods.ensemble_mean(hindcast).withColumnRenamed("value", "x")
    out = x.join(fit, "cell").select("cell", "year", (F.col("intercept") + F.col("slope") * F.col("x")).alias("value"))
    return out.join(obs.select("cell", "year", F.col("value").alias("obs")), ["cell", "year"]) if paired else out


def by_index(hindcast: DataFrame, obs: DataFrame, forecast: DataFrame, box, year: int, detrend: bool = True, **how) -> DataFrame:
    """Logistic shares from a box mean of a field, without its trend on the years. hindcast, forecast: cell, year, value."""
    index = index_box(hindcast, box).withColumnRenamed("index", "value")
    at = index_box(forecast, box).first()["index"]
    if detrend:
        index, at = alignment.detrended(index, at, year)
    return logit.forecast(alignment.same_years(index, obs), at, **how)
