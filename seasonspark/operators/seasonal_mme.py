"""The seasonal forecast of several models: years, cross-validated hindcasts, their ensemble, terciles, skill and the issued forecast.

hindcast: track, model, cell, year, value (members averaged); forecast: the same for the year to come; obs: cell, year, value. The method is a
regression a cell, whose leave-one-out hindcasts have a closed form; canonical correlation takes rows on a grid (operators.cca) and its hindcasts
and leverages may be passed in.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonspark.operators import alignment, ensembles, methods, metrics, terciles
from seasonspark.operators.calibrate import keyed, opened

#: From so many members on, forecast shares are counted.
COUNTED = 10


@dataclass
class SeasonalForecast:
    years: DataFrame  # model, year
    hindcasts: DataFrame  # model, cell, year, y, prediction
    ensemble: DataFrame  # cell, year, y, prediction
    pev: DataFrame
    contributions: DataFrame
    terciles_cv: DataFrame
    skill: DataFrame
    forecasts: DataFrame  # model, cell, value
    forecast: DataFrame  # cell, value
    terciles: DataFrame


def tercile_method(method: str, wanted: str | None) -> str:
    """cpt goes with canonical correlation only, and is its default; else bootstrap is."""
    if wanted is None:
        return "cpt" if method == "cca" else "bootstrap"
    if wanted not in ("cpt", "bootstrap", "gaussian", "pooled"):
        raise ValueError(f"unknown tercile method {wanted!r}")
    if wanted == "cpt" and method != "cca":
        raise ValueError("cpt terciles need the leverages of canonical correlation")
    return wanted


def named(hindcast: DataFrame) -> DataFrame:
    """model stands for track and model together."""
    return hindcast.withColumn("model", F.concat_ws("__", "track", "model")).drop("track") if "track" in hindcast.columns else hindcast


def model_years(hindcast: DataFrame, obs: DataFrame, native: bool = False) -> DataFrame:
    """model and year: the years that all share, or each model's own with the observations."""
    own = alignment.native_years(hindcast, obs)
    return own if native else own.join(F.broadcast(alignment.common_years(hindcast, obs)), "year").select("model", "year")


def model_hindcasts(hindcast: DataFrame, obs: DataFrame, years: DataFrame) -> DataFrame:
    """model, cell, year, y and prediction, each year by a fit on the model's other ones."""
    rows = hindcast.groupBy("model", "cell", "year").agg(F.avg("value").alias("x")).join(F.broadcast(years), ["model", "year"], "left_semi")
    pairs = rows.join(obs.select("cell", "year", F.col("value").alias("y")), ["cell", "year"])
    return opened(methods.leave_one_out(keyed(pairs, "model")), "model")


def model_forecasts(hindcast: DataFrame, obs: DataFrame, years: DataFrame, forecast: DataFrame) -> DataFrame:
    """model, cell and value, by a fit on all of a model's years."""
    rows = hindcast.join(F.broadcast(years), ["model", "year"], "left_semi").groupBy("model", "cell", "year").agg(F.avg("value").alias("x"))
    pairs = rows.join(obs.select("cell", "year", F.col("value").alias("y")), ["cell", "year"])
    fit = pairs.groupBy("model", "cell").agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"))
    now = forecast.groupBy("model", "cell").agg(F.avg("value").alias("x"))
    return fit.join(now, ["model", "cell"]).select("model", "cell", (F.col("a") + F.col("b") * F.col("x")).alias("value"))


def pooled(hindcasts: DataFrame) -> DataFrame:
    """cell, year, y and prediction: the mean of the models, over the years that all of them have."""
    models = hindcasts.agg(F.count_distinct("model")).first()[0]
    years = hindcasts.groupBy("year").agg(F.count_distinct("model").alias("n")).where(F.col("n") == models).select("year")
    rows = hindcasts.join(F.broadcast(years), "year", "left_semi")
    return rows.groupBy("cell", "year").agg(F.first("y").alias("y"), F.avg("prediction").alias("prediction"))


def average_leverages(leverages: DataFrame) -> DataFrame:
    """year and leverage: the mean of the models' finite ones."""
    ok = F.col("leverage").isNotNull() & ~F.isnan("leverage") & (F.abs("leverage") < float("inf"))
    return leverages.where(ok).select("model", "year", "leverage").distinct().groupBy("year").agg(F.avg("leverage").alias("leverage"))


def cv_terciles(cv: DataFrame, how: str, modes: int = 3, leverages: DataFrame | None = None) -> DataFrame:
    if how == "cpt":
        if leverages is None:
            raise ValueError("cpt terciles need leverages")
        return terciles.cv_student(cv, cv.select("year").distinct().count(), modes, leverages)
    return {"bootstrap": terciles.cv_bootstrap, "gaussian": terciles.cv_gaussian, "pooled": terciles.cv_pooled}[how](cv)


def per_model_terciles(hindcasts: DataFrame, modes: dict[str, int], leverages: DataFrame) -> DataFrame:
    """cell, year and shares: each model's Student shares with its own degrees of freedom, averaged over the models that leave any, and made to add up to one.

    modes: of each model; leverages: model, year, leverage. A union of one plan a model: models are few.
    """
    parts = None
    years = {r.model: r.n for r in hindcasts.groupBy("model").agg(F.count_distinct("year").alias("n")).collect()}
    for model, k in modes.items():
        if years.get(model, 0) - k - 1 > 1:
            own = leverages.where(F.col("model") == model).select("year", "leverage").distinct()
            one = terciles.cv_student(hindcasts.where(F.col("model") == model), years[model], k, own)
            parts = one if parts is None else parts.unionByName(one)
    if parts is None:
        raise ValueError("no model leaves a degree of freedom")
    return alignment.model_mean(parts, ["cell", "year"])


def issued_terciles(forecasts: DataFrame, obs: DataFrame) -> DataFrame:
    """cell and shares of the models' forecasts against the observations' terciles: counted from COUNTED members on, else normal."""
    members = forecasts.select("model").distinct().count()
    bounds = terciles.type7_boundaries(obs, ["cell"])
    if members >= COUNTED:
        return terciles.counting_probabilities(forecasts, bounds.where("lo IS NOT NULL"), ["cell"], ["cell"])
    return terciles.gaussian_probabilities(forecasts, bounds, ["cell"], ["cell"])


def skill_masked(terciles_: DataFrame, forecast: DataFrame, cv: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Shares of a third each and the observed mean where the hindcast's correlation is below the threshold."""
    low = cv.groupBy("cell").agg((F.corr("prediction", "y") < threshold).alias("_low"), F.avg("y").alias("_mean"))
    t = terciles_.join(low, "cell", "left")
    p = ["p_below", "p_normal", "p_above"]
    masked = t.select("cell", *[F.when(F.col("_low"), F.lit(1 / 3)).otherwise(F.col(c)).alias(c) for c in p])
    f = forecast.join(low, "cell", "left").select("cell", F.when(F.col("_low"), F.col("_mean")).otherwise(F.col("value")).alias("value"))
    return masked, f


def seasonal_mme(hindcast: DataFrame, forecast: DataFrame, obs: DataFrame, native: bool = False, terciles_by: str | None = None, scores: list[str] | None = None, threshold: float | None = None, climatology: tuple[int, int] | None = None) -> SeasonalForecast:
    """The whole chain; climatology: first and last year of the observations that the issued terciles are measured by, where three years at least remain."""
    hindcast, forecast = named(hindcast), named(forecast)
    alignment.same_models(hindcast, forecast)
    how = tercile_method("regression", terciles_by)
    years = model_years(hindcast, obs, native).persist()
    each = model_hindcasts(hindcast, obs, years)
    cv = pooled(each)
    shares = cv_terciles(cv, how)
    base = obs.join(F.broadcast(cv.select("year").distinct()), "year", "left_semi")
    if climatology and base.where(F.col("year").between(*climatology)).select("year").distinct().count() >= 3:
        base = base.where(F.col("year").between(*climatology))
    issued = model_forecasts(hindcast, obs, years, forecast)
    mean = issued.groupBy("cell").agg(F.avg("value").alias("value"))
    terciles_ = issued_terciles(issued, base)
    if threshold is not None:
        terciles_, mean = skill_masked(terciles_, mean, cv, threshold)
    deterministic = metrics.skill(cv.withColumnsRenamed({"prediction": "fc", "y": "obs"}), [s for s in scores or [*metrics.BY_CELL, "msss"] if s not in metrics.POOLED])
    bounds = terciles.type7_boundaries(base, ["cell"]).where("lo IS NOT NULL")
    cats = cv.join(bounds, "cell").select("cell", "year", terciles.category(F.col("y"), F.col("lo"), F.col("hi")).alias("cat"))
    wanted = [s for s in scores or metrics.POOLED if s in metrics.POOLED]
    skill = deterministic.unionByName(metrics.skill(shares.join(cats, ["cell", "year"]), wanted)) if wanted else deterministic
    contributions = ensembles.contributions(each.withColumnRenamed("prediction", "value"), cv.withColumnRenamed("prediction", "value"))
    return SeasonalForecast(years, each, cv, methods.prediction_error_variance(cv), contributions, shares, skill, issued, mean, terciles_)


def best_method(hindcast: DataFrame, obs: DataFrame, fits: dict, score=None) -> tuple[str, DataFrame]:
    """(the method of the highest score, the first of equals; method and score of all).

    fits: of each method a function of hindcast and obs that gives cell, year, y, prediction of a cross-validation; score: a function of these, by
    default the mean correlation of cells.
    """
    table = None
    for i, (name, fit) in enumerate(fits.items()):
        cv = fit(hindcast, obs)
        value = score(cv) if score else cv.groupBy("cell").agg(F.corr("prediction", "y").alias("r")).agg(F.avg("r").alias("score"))
        one = value.select(F.lit(name).alias("method"), F.lit(i).alias("_i"), "score")
        table = one if table is None else table.unionByName(one)
    rows = sorted(table.collect(), key=lambda r: (-(r.score if r.score is not None and r.score == r.score else float("-inf")), r._i))
    return rows[0].method, table.drop("_i")
