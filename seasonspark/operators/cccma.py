"""Calibration by variance ratios of several models and the coefficient that gives the best ranked probability score.

Moments are aggregates; the search for coefficients runs over many cells at once in Arrow batches, a row a cell. hindcast: cell, season (from 0),
year, model, member, value; obs: cell, season, year, value; every cell has the hindcast's years.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seasonspark.functions.special import gamma_cdf, gamma_ppf, normal_cdf, normal_cdf_np, normal_ppf
from seasonspark.operators.metrics import crps_normal

TERCILE = 0.4307273
SMALL = 1e-6
KINDS = ("none", "constant", "independent", "smoothed")
GOLD = 0.61803399


def c4(n: int) -> float:
    """Bias of the standard deviation of n values, to seven places."""
    return round(math.sqrt(2 / (n - 1)) * math.exp(math.lgamma(n / 2) - math.lgamma((n - 1) / 2)), 7)


def adjusted_tercile(n: int) -> float:
    """The normal tercile, widened for the standard deviation of up to a hundred values."""
    return TERCILE / c4(n) if n <= 100 else TERCILE


def weights(width: float | list[float], seasons: int) -> list[float]:
    """Of each offset on the cycle: given, all equal (below 0), the season alone (0) or normal with this width."""
    if not isinstance(width, (int, float)):
        if len(width) != seasons:
            raise ValueError(f"a filter of {seasons} seasons needs as many weights")
        return [float(w) for w in width]
    if width < 0:
        return [1 / seasons] * seasons
    w = [math.exp(-min(k, seasons - k) ** 2 / (2 * width**2)) if width > 0 else float(k == 0) for k in range(seasons)]
    return [x / sum(w) for x in w]


def present(value: Column) -> Column:
    """Values near 1e38 are missing."""
    return F.when(F.abs(value - 1e38) < 1e32, None).otherwise(value)


def cyclic(rows: DataFrame, columns: list[str], w: list[float], condition: str) -> DataFrame:
    """Adds each column smoothed over the cell's seasons, as <column>_s; where the condition fails it stays. A missing season adds nothing."""
    n = len(w)
    offsets = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(x).alias("w")) for k, x in enumerate(w)])).alias("_o")
    dealt = rows.select("cell", *columns, "season", offsets).withColumn("season", F.pmod(F.col("season") - F.col("_o.k"), F.lit(n)))
    smooth = dealt.groupBy("cell", "season").agg(*[F.sum(F.col("_o.w") * F.col(c)).alias(f"{c}_s") for c in columns])
    j = rows.join(smooth, ["cell", "season"])
    return j.select(*rows.columns, *[F.when(F.col(condition), F.col(f"{c}_s")).otherwise(F.col(c)).alias(f"{c}_s") for c in columns])


def moments(hindcast: DataFrame, obs: DataFrame, seasons: int, variance_width: float | list[float] = 1, obs_width: float | list[float] = 1) -> tuple[DataFrame, DataFrame]:
    """(cell, season and variances; cell, season, year, x and y).

    total, signal and noise: variances of the models together, and smoothed over the seasons (_s); ysd and ysdf: the observations', plain and smoothed;
    x: mean of the models' anomalies, y: observed anomaly, xavg by model under means.
    """
    keys = ["cell", "season"]
    x, y = hindcast.withColumn("value", present(F.col("value"))).where("value IS NOT NULL"), obs.withColumn("value", present(F.col("value"))).where("value IS NOT NULL")
    size = x.agg(F.count_distinct("year").alias("t"), F.count_distinct("model").alias("m"), F.count_distinct("model", "member").alias("n")).first()
    t, models, members = size.t, size.m, size.n
    model = Window.partitionBy(*keys, "model")
    x = x.withColumn("d", F.col("value") - F.avg("value").over(model))
    a = x.groupBy(*keys, "model", "year").agg(F.avg("d").alias("a"), F.sum(F.col("d") * F.col("d")).alias("ss"), F.sum("d").alias("s"), F.count("d").alias("n"))
    u = a.groupBy(*keys, "year").agg(F.avg("a").alias("x"), F.sum("ss").alias("ss"), F.sum("s").alias("s"), F.sum("n").alias("n"))
    whole = F.sum("ss")
    rest = F.sum(F.col("ss") - 2 * F.col("x") * F.col("s") + F.col("n") * F.col("x") * F.col("x"))
    noise = rest / (t * (members - 1) - models + 1)
    signal = (whole - rest) / ((t - 1) * members) - noise / members
    var = u.groupBy(*keys).agg(noise.alias("noise"), signal.alias("signal")).withColumn("total", F.col("noise") + F.col("signal"))
    ya = y.select(*keys, "year", (F.col("value") - F.avg("value").over(Window.partitionBy(*keys))).alias("y"))
    tail = adjusted_tercile(t)
    lo, hi = (0.5 * (1 + math.erf(s * tail / math.sqrt(2))) for s in (-1, 1))
    yv = y.groupBy(*keys).agg((F.var_pop("value") * F.count("value") / (t - 1)).alias("yvar"), (F.percentile("value", F.lit(hi)) - F.percentile("value", F.lit(lo))).alias("yq"), F.avg("value").alias("yavg"))
    flat = a.groupBy(*keys, "model").agg((F.sqrt(F.sum(F.col("a") * F.col("a")) / (t - 1)) < SMALL).alias("f"))
    narrow = x.groupBy(*keys, "model").agg((F.percentile("value", F.lit(hi)) - F.percentile("value", F.lit(lo)) < SMALL).alias("q"), F.avg("value").alias("m"))
    odd = flat.join(narrow, [*keys, "model"]).groupBy(*keys).agg(F.bool_or(F.col("f") | F.col("q")).alias("odd"), F.map_from_entries(F.collect_list(F.struct("model", "m"))).alias("means"))
    v = var.join(yv, keys).join(odd, keys)
    bad = F.col("odd") | (F.sqrt("yvar") < SMALL) | (F.col("yq") < SMALL)
    v = v.withColumn("smooth", ~F.bool_or(bad).over(Window.partitionBy("cell")))
    v = cyclic(v, ["noise", "signal", "total"], weights(variance_width, seasons), "smooth")
    v = cyclic(v, ["yvar"], weights(obs_width, seasons), "smooth")
    v = v.withColumns({"ysd": F.sqrt("yvar"), "ysdf": F.sqrt("yvar_s")}).drop("yq", "odd")
    return v, u.select(*keys, "year", "x").join(ya, [*keys, "year"])


def crps(x: np.ndarray, mu: np.ndarray, sd: np.ndarray) -> np.ndarray:
    z = (x - mu) / sd
    return sd * (z * (2 * normal_cdf_np(z) - 1) + 2 * np.exp(-z * z / 2) / math.sqrt(2 * math.pi) - 1 / math.sqrt(math.pi))


def objective(f: np.ndarray, x, y, total, signal, ysd, years: int) -> np.ndarray:
    """Mean score of normal forecasts whose anomaly is scaled by f. x, y: problem, season, year; the others: problem, season; f: problem."""
    with np.errstate(all="ignore"):
        xsd = np.sqrt(total)
        good = (xsd > SMALL) & (ysd > SMALL)
        sd = np.where(good, np.sqrt(total - signal * f[:, None] ** 2) / xsd, np.nan)
        sd = np.where(sd > 0, sd, SMALL)
        score = crps(y / ysd[..., None], f[:, None, None] * x / xsd[..., None], sd[..., None])
        n = good.sum(1)
        total_score = np.where(np.isfinite(score) & good[..., None], score, 0).sum((1, 2))
        return np.where(n == 0, np.nan, total_score / (years * np.maximum(n, 1)))


def golden(f, low: np.ndarray, middle: np.ndarray, high: np.ndarray, tolerance: float = 1e-3, rounds: int = 1000) -> np.ndarray:
    """Minimisers of many functions at once by golden section. f takes and gives an array, a place a function."""
    c = 1 - GOLD
    far = np.abs(high - middle) > np.abs(middle - low)
    x0, x3 = low.copy(), high.copy()
    x1 = np.where(far, middle, middle - c * (middle - low))
    x2 = np.where(far, middle + c * (high - middle), middle)
    f1, f2 = f(x1), f(x2)
    for _ in range(rounds):
        on = np.abs(x3 - x0) > tolerance * (np.abs(x1) + np.abs(x2))
        if not on.any():
            break
        right = on & (f2 < f1)
        left = on & ~right
        x0, x3 = np.where(right, x1, x0), np.where(left, x2, x3)
        x1, x2, f1, f2 = np.where(right, x2, x1), np.where(left, x1, x2), np.where(right, f2, f1), np.where(left, f1, f2)
        x2, x1 = np.where(right, GOLD * x1 + c * x3, x2), np.where(left, GOLD * x2 + c * x0, x1)
        new = f(np.where(right, x2, x1))
        f2, f1 = np.where(right, new, f2), np.where(left, new, f1)
    return np.where(f1 < f2, x1, x2)


def searched(x, y, total, signal, total_s, signal_s, ysd, tolerance: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """(the constant coefficient of each cell, the one of each cell and season). x, y: cell, season, year; the others: cell, season."""
    years = x.shape[2]
    with np.errstate(all="ignore"):
        most = np.where(signal_s > 0, np.minimum(2.0, np.maximum(1.0, np.sqrt(total_s / signal_s) - SMALL)), 1 + SMALL)
        most = np.nanmin(np.where(most < 1e38, most, 1e38), axis=1)
        one = golden(lambda f: objective(f, x, y, total_s, signal_s, ysd, years), -most, np.full(len(most), 0.5), most, tolerance)
        constant = np.where((np.nan_to_num(ysd) == 0).all(1), np.nan, one)
        t, s, sd = (v.reshape(-1, 1) for v in (total, signal, ysd))
        flat = [v.reshape(-1, 1, years) for v in (x, y)]
        most = np.minimum(2.0, np.maximum(1.0, np.sqrt(np.clip(t / s, 0, None)) - SMALL))[:, 0]
        none = ((t == 0) | ~(s > 0))[:, 0]
        most = np.where(none, 1.0, most)
        own = golden(lambda f: objective(f, *flat, t, s, sd, years), -most, np.full(len(most), 0.5), most, tolerance)
        own = np.where(np.nan_to_num(sd[:, 0]) == 0, np.nan, np.where(none, 0.0, own)).reshape(total.shape)
    return constant, own


def fit(hindcast: DataFrame, obs: DataFrame, seasons: int = 12, coefficient_width: float | list[float] = 2, variance_width: float | list[float] = 1, obs_width: float | list[float] = 1, tolerance: float = 1e-3) -> DataFrame:
    """cell, season, variances, the coefficients constant, independent and smoothed, xsd, and sd_<kind> of each kind."""
    v, xy = moments(hindcast, obs, seasons, variance_width, obs_width)
    names = ["total", "signal", "total_s", "signal_s", "ysdf"]
    per = xy.groupBy("cell", "season").agg(F.array_sort(F.collect_list(F.struct("year", "x", "y"))).alias("_p"))
    rows = v.join(per, ["cell", "season"]).groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("season", "_p", *names))).alias("_r"))
    kind = dict(v.dtypes)["cell"]

    def run(batches):
        for pdf in batches:
            parts = []
            for n in sorted({len(r) for r in pdf["_r"]}):
                held = [(c, r) for c, r in zip(pdf["cell"], pdf["_r"], strict=True) if len(r) == n]
                years = max(len(q["_p"]) for _, r in held for q in r)
                a = np.full((2, len(held), n, years), np.nan)
                w = np.empty((len(names), len(held), n))
                for i, (_, r) in enumerate(held):
                    for j, q in enumerate(r):
                        for k, p in enumerate(q["_p"]):
                            a[:, i, j, k] = p["x"], p["y"]
                        w[:, i, j] = [q[c] if q[c] is not None else np.nan for c in names]
                constant, own = searched(*a, *w, tolerance)
                parts.append(pd.DataFrame([(c, q["season"], constant[i], own[i, j]) for i, (c, r) in enumerate(held) for j, q in enumerate(r)], columns=["cell", "season", "constant", "independent"]))
            if parts:
                yield pd.concat(parts, ignore_index=True)

    found = rows.mapInPandas(run, f"cell {kind}, season int, constant double, independent double")
    found = found.select("cell", "season", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("constant", "independent")])
    out = cyclic(v.join(found, ["cell", "season"]), ["independent"], weights(coefficient_width, seasons), "smooth").withColumnRenamed("independent_s", "smoothed")
    scaled = [F.col("total_s") - F.col("signal_s") * F.col(c) * F.col(c) for c in KINDS[1:]]
    sds = {f"sd_{c}": F.when(x > 0, F.sqrt(x)).otherwise(SMALL) for c, x in zip(KINDS[1:], scaled, strict=True)}
    return out.withColumns({"xsd": F.sqrt("total_s"), "sd_none": F.sqrt("noise_s"), **sds})


def coefficient(kind: str) -> Column:
    if kind not in KINDS:
        raise ValueError(f"unknown coefficient {kind!r}; there are {KINDS}")
    return F.lit(1.0) if kind == "none" else F.col(kind)


def shares(ano: Column, sd: Column, tercile: float) -> list[Column]:
    """Below, within and above of a normal distribution around ano against the tercile on both sides; a third each without spread."""
    def third(c):
        return F.when(sd > 0, c).otherwise(1 / 3)

    low, high = normal_cdf((-tercile - ano) / F.when(sd != 0, sd)), normal_cdf((tercile - ano) / F.when(sd != 0, sd))
    return [third(low).alias("p_below"), third(high - low).alias("p_normal"), third(1 - high).alias("p_above")]


def standardised(rows: DataFrame, kind: str, sd: Column) -> DataFrame:
    big = F.col("xsd") > SMALL
    return rows.withColumns({"ano": F.when(big, coefficient(kind) * F.col("x") / F.col("xsd")).otherwise(0.0), "sde": F.when(big, sd / F.col("xsd")).otherwise(0.0)})


def hindcast_terciles(model: DataFrame, anomalies: DataFrame, years: int, kind: str = "smoothed") -> DataFrame:
    """cell, season, year and shares over the hindcast's own years. anomalies: the second table of moments()."""
    sd = F.sqrt("noise") if kind == "none" else F.col(f"sd_{kind}")
    rows = standardised(anomalies.join(model, ["cell", "season"]), kind, sd)
    return rows.select("cell", "season", "year", *shares(F.col("ano"), F.col("sde"), adjusted_tercile(years)))


def skill(model: DataFrame, anomalies: DataFrame, kind: str = "smoothed") -> DataFrame:
    """cell, season and crpss against the observations' normal climatology."""
    sd = F.sqrt("noise") if kind == "none" else F.col(f"sd_{kind}")
    rows = standardised(anomalies.join(model, ["cell", "season"]), kind, sd)
    y = F.when(F.col("ysd") > 1e-6, F.col("y") / F.col("ysdf")).otherwise(0.0)
    own, base = crps_normal(F.col("ano"), F.col("sde"), y), crps_normal(F.lit(0.0), F.lit(1.0), y)
    return rows.groupBy("cell", "season").agg((1 - F.avg(own) / F.avg(base)).alias("crpss"))


def forecast_anomaly(model: DataFrame, forecast: DataFrame) -> DataFrame:
    """The model's rows with x, the mean of the models' anomalies from their climatologies. forecast: cell, season, model, member, value."""
    own = forecast.groupBy("cell", "season", "model").agg(F.avg("value").alias("v")).join(model.select("cell", "season", "means"), ["cell", "season"])
    x = own.groupBy("cell", "season").agg(F.avg(F.col("v") - F.try_element_at("means", F.col("model"))).alias("x"))
    return x.join(model, ["cell", "season"])


def predict_terciles(model: DataFrame, forecast: DataFrame, years: int, kind: str = "smoothed") -> DataFrame:
    rows = standardised(forecast_anomaly(model, forecast), kind, F.col(f"sd_{kind}"))
    return rows.select("cell", "season", *shares(F.col("ano"), F.col("sde"), adjusted_tercile(years)))


def predict(model: DataFrame, forecast: DataFrame, kind: str = "smoothed") -> DataFrame:
    """cell, season and value: the scaled anomaly on the observed mean."""
    return forecast_anomaly(model, forecast).select("cell", "season", (coefficient(kind) * F.col("x") + F.col("yavg")).alias("value"))


def hindcast_values(model: DataFrame, anomalies: DataFrame, kind: str = "smoothed") -> DataFrame:
    return anomalies.join(model, ["cell", "season"]).select("cell", "season", "year", (coefficient(kind) * F.col("x") + F.col("yavg")).alias("value"))


def gamma_lmoments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, shape and scale by L-moments; null with three values or fewer, one positive, all equal, or a second moment out of range."""
    w = Window.partitionBy(*keys)
    v = rows.where(F.col("value").isNotNull() & ~F.isnan("value")).select(*keys, "value", F.row_number().over(w.orderBy("value")).alias("_i"), F.count("value").over(w).alias("_n"))
    n = F.max("_n")
    l2 = F.sum((2 * F.col("_i") - F.col("_n") - 1) * F.col("value")) / (n * (n - 1))
    g = v.groupBy(*keys).agg(n.alias("n"), F.avg("value").alias("l1"), l2.alias("l2"), F.count(F.when(F.col("value") > 0, 1)).alias("wet"), F.count_distinct("value").alias("own"))
    cv = F.col("l2") / F.col("l1")
    t, s = 1 - cv, math.pi * cv * cv
    high = t * (0.7213 + t * -0.5947) / (1 + t * (-2.1817 + t * 1.2113))
    low = (1 - 0.3080 * s) / (s * (1 + s * (-0.05812 + s * 0.01765)))
    sound = (F.col("n") > 3) & (F.col("wet") >= 2) & (F.col("own") > 1) & (F.col("l1") > F.col("l2")) & (F.col("l2") > 0)
    g = g.withColumn("shape", F.when(sound, F.when(cv >= 0.5, high).otherwise(low)))
    return g.select(*keys, "shape", (F.col("l1") / F.col("shape")).alias("scale"))


def to_normal(rows: DataFrame, fitted: DataFrame, keys: list[str], times: int) -> DataFrame:
    """Values as normal scores of their gamma distribution, its shares kept half of one in `times` off both ends; null where none fits."""
    edge = 0.5 / times
    p = gamma_cdf("value", "shape", "scale")
    clipped = F.when(~F.isnan(p), F.least(F.greatest(p, F.lit(edge)), F.lit(1 - edge)))
    return rows.join(fitted, keys).withColumn("value", normal_ppf(clipped)).drop("shape", "scale")


def from_normal(rows: DataFrame, fitted: DataFrame, keys: list[str], mean: str) -> DataFrame:
    """Back from normal scores, times the mean that the values were divided by."""
    return rows.join(fitted, keys).withColumn("value", gamma_ppf(normal_cdf(F.col("value")), F.col("shape"), F.col("scale")) * F.col(mean)).drop("shape", "scale")


def log_sum_exp(columns: list[Column]) -> Column:
    top = F.greatest(*columns) if len(columns) > 1 else columns[0]
    return top + F.log(sum((F.exp(c - top) for c in columns[1:]), F.exp(columns[0] - top)))
