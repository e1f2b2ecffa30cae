"""The verbs as services: tables by path in, a table by path out with its profile. Options are named as the verbs name them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seasonspark import registry
from seasonspark.operators import calibrate as cb
from seasonspark.operators import diagrams, ensembles, leads, metrics, seasonal_mme, terciles
from seasonspark.sources import products


def list_registry() -> dict[str, list[str]]:
    return {kind: sorted(names) for kind, names in registry.KINDS.items()}


def describe_dataset(spark: SparkSession, path: str) -> DataFrame:
    return products.describe(spark, path)


def downscale(spark: SparkSession, hindcast: str, obs: str, destination: str, method: str = "bcsd", forecast: str | None = None) -> dict:
    tables = [products.opened(spark, p) for p in (hindcast, obs)]
    now = products.opened(spark, forecast) if forecast else None
    out = registry.downscale(method, *tables, now)
    return products.write_result(out, f"downscale_{method}", destination, params={"hindcast": hindcast, "obs": obs, "forecast": forecast, "method": method})


def calibrate(spark: SparkSession, obs: str, hindcast: str, destination: str, forecast: str | None = None, method: str = "ereg", output: str = "tercile", cv: bool = False, window: int = 1, **options) -> dict:
    """With cv the hindcast of all years, else the forecast."""
    h, o = products.opened(spark, hindcast), products.opened(spark, obs)
    if cv:
        out = cb.calibrate_cv(h, o, window, **options)
    else:
        if forecast is None:
            raise ValueError("a forecast is needed without cv")
        out = cb.calibrate(h, o, products.opened(spark, forecast), method, output=output, **options)
    params = {"obs": obs, "hindcast": hindcast, "forecast": forecast, "method": method, "output": output, "cv": cv, "window": window, **options}
    return products.write_result(out, f"calibrate_{method}", destination, params=params)


def optimize(spark: SparkSession, hindcast: str, obs: str, destination: str, methods: dict | None = None) -> dict:
    """The best of some methods of cross-validation (names to functions), and the scores of all; by default regression alone."""
    def regression(h, o):
        return seasonal_mme.pooled(seasonal_mme.model_hindcasts(h, o, seasonal_mme.model_years(h, o)))

    h, o = products.opened(spark, hindcast), products.opened(spark, obs)
    best, table = seasonal_mme.best_method(h, o, methods or {"regression": regression})
    return {"best": best} | products.write_result(table, "optimize", destination, params={"hindcast": hindcast, "obs": obs, "methods": sorted(methods or ["regression"])})


def ensemble(spark: SparkSession, forecasts: str, destination: str, strategy: str = "uniform", obs: str | None = None, safeguards: dict | None = None) -> dict:
    """forecasts: model, cell, year, value. Strategies but uniform need observations for the models' scores."""
    guard = diagrams.safeguards(safeguards)
    f = products.opened(spark, forecasts)
    if strategy == "uniform":
        out = ensembles.uniform(f, ["cell", "year"])
    else:
        if obs is None:
            raise ValueError(f"{strategy} needs observations")
        pairs = f.join(products.opened(spark, obs).withColumnRenamed("value", "obs"), ["cell", "year"])
        scores = pairs.groupBy("model").agg(F.corr("value", "obs").alias("score"))
        if strategy == "drop_worst":
            out = ensembles.drop_worst(f, scores, ["cell", "year"])
        elif strategy == "skill_weighted":
            weights = ensembles.shrink(ensembles.skill_weights(scores), guard["shrink"])
            if ensembles.effective_models(weights).first()[0] < guard["min_effective"]:
                raise ValueError("the weights leave fewer effective models than the safeguard asks for")
            out = ensembles.weighted(f, weights, ["cell", "year"])
        else:
            raise KeyError(f"unknown strategy {strategy!r}")
    return products.write_result(out, f"ensemble_{strategy}", destination, params={"forecasts": forecasts, "strategy": strategy, "obs": obs})


def skill(spark: SparkSession, pairs: str, destination: str, names: list[str], curves: bool = False) -> dict:
    """Scores of pairs of forecast and observation; with curves also the points of the ROC curves and the reliability diagram, beside it."""
    rows = products.opened(spark, pairs)
    out = products.write_result(metrics.skill(rows, names), "skill", destination, params={"pairs": pairs, "names": names})
    if curves:
        out["roc"] = products.write_result(diagrams.roc_curve(rows), "roc", destination, params={"pairs": pairs})["path"]
        out["reliability"] = products.write_result(diagrams.reliability(rows), "reliability", destination, params={"pairs": pairs})["path"]
    return out


def to_tercile(spark: SparkSession, members: str, obs: str, destination: str, method: str = "counting") -> dict:
    m, o = products.opened(spark, members), products.opened(spark, obs)
    bounds = terciles.type7_boundaries(o, ["cell"])
    keys = [k for k in ("cell", "year") if k in m.columns]
    if method not in ("counting", "gaussian"):
        raise ValueError(f"unknown method {method!r}")
    made = terciles.counting_probabilities(m, bounds.where("lo IS NOT NULL"), keys, ["cell"]) if method == "counting" else terciles.gaussian_probabilities(m, bounds, keys, ["cell"])
    return products.write_result(made, f"tercile_{method}", destination, params={"members": members, "obs": obs, "method": method})


def forecast_window(spark: SparkSession, forecast: str, destination: str, window: str | tuple[int, int], how: str = "mean", mean: bool = False, **options) -> dict:
    """mean: over members."""
    fc = products.opened(spark, forecast)
    keys = [k for k in ("cell", "member") if k in fc.columns]
    out = leads.forecast_window(fc, window, keys, how=how, **options)
    if mean and "member" in keys:
        out = out.groupBy("cell").agg(F.avg("value").alias("value"))
    return products.write_result(out, "window", destination, params={"forecast": forecast, "window": window, "how": how, "mean": mean})
