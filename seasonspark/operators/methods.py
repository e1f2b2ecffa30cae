"""Bias correction and calibration: delta, quantile mapping, ensemble regression, error bounds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seasonspark.functions.special import at_least, gamma_cdf, gamma_ppf, normal_cdf, normal_ppf
from seasonspark.operators.regrid import axis, regrid
from seasonspark.operators.terciles import gaussian_split, type7_boundaries


def delta(hindcast: DataFrame, obs: DataFrame, forecast: DataFrame) -> DataFrame:
    """Observed climatology plus the forecast's departure from the model's."""
    o = obs.groupBy("cell").agg(F.avg("value").alias("o"))
    m = hindcast.groupBy("cell").agg(F.avg("value").alias("m"))
    out = forecast.join(o, "cell").join(m, "cell")
    return out.select("cell", "member", (F.col("o") + F.col("value") - F.col("m")).alias("value"))


def ensemble_mean(members: DataFrame) -> DataFrame:
    return members.groupBy("cell", "year").agg(F.avg("value").alias("value"))


def quantile_map_parametric(hindcast: DataFrame, obs: DataFrame, forecast: DataFrame) -> DataFrame:
    """Mean and standard deviation (ddof 1) over years, of the ensemble mean, carried over; a spread below 1e-12 counts as 1."""

    def moments(t, p):
        return t.groupBy("cell").agg(F.avg("value").alias(f"{p}m"), F.stddev_samp("value").alias(f"{p}s"))

    s = F.when(F.col("gs") < 1e-12, 1.0).otherwise(F.col("gs"))
    out = forecast.join(moments(ensemble_mean(hindcast), "g"), "cell").join(moments(obs, "o"), "cell")
    return out.select("cell", "member", (F.col("om") + (F.col("value") - F.col("gm")) / s * F.col("os")).alias("value"))


def sorted_record(rows: DataFrame, name: str) -> DataFrame:
    """One sorted array a cell, over its years; null where a year is missing."""
    return rows.groupBy("cell").agg(F.when(F.count("value") == F.count(F.lit(1)), F.sort_array(F.collect_list("value"))).alias(name))


def empirical_map(x: Column, source: Column, target: Column, linear: bool = False) -> Column:
    """Quantile mapping between sorted arrays by positions (i + 1/2) / n, with linear interpolation; tails are clamped or go on with the end slope."""
    n, m = F.size(source), F.size(target)
    j = F.size(F.filter(source, lambda v: v <= x))  # values at or below x
    a, b = F.try_element_at(source, F.greatest(j, F.lit(1))), F.try_element_at(source, F.least(j + 1, n))
    within = F.when(j < 1, 0.5).when(j >= n, n - 0.5).otherwise(j - 0.5 + (x - a) / F.when(b > a, b - a).otherwise(1.0))
    place = F.greatest(F.lit(0.0), F.least(within / n * m - 0.5, m - 1.0))  # 0-based, with a fraction
    i = F.floor(place).cast("int")
    lo, hi = F.try_element_at(target, i + 1), F.try_element_at(target, F.least(i + 2, m))
    out = lo + (place - i) * (hi - lo)
    if linear:
        s1, s2, sn, sp = (F.try_element_at(source, k) for k in (F.lit(1), F.lit(2), n, n - 1))
        t1, t2, tn, tp = (F.try_element_at(target, k) for k in (F.lit(1), F.lit(2), m, m - 1))
        out = F.when((x < s1) & (s2 > s1), t1 + (x - s1) * (t2 - t1) / (s2 - s1)).when((x > sn) & (sn > sp), tn + (x - sn) * (tn - tp) / (sn - sp)).otherwise(out)
    return F.when(x.isNotNull() & source.isNotNull() & target.isNotNull() & (n > 0) & (m > 0), out)


def quantile_map_empirical(hindcast: DataFrame, obs: DataFrame, forecast: DataFrame, linear: bool = False) -> DataFrame:
    """Each member through the records of the ensemble mean and of the observations."""
    out = forecast.join(sorted_record(ensemble_mean(hindcast), "s"), "cell").join(sorted_record(obs, "t"), "cell")
    return out.select("cell", "member", empirical_map(F.col("value"), F.col("s"), F.col("t"), linear).alias("value"))


def detrended(rows: DataFrame) -> DataFrame:
    """cell, year, value less its linear trend around the mean year, slope."""
    w = Window.partitionBy("cell")
    slope = F.regr_slope("value", "year").over(w)
    centred = F.col("year") - F.avg("year").over(w)
    return rows.select("cell", "year", (F.col("value") - slope * centred).alias("value"), slope.alias("slope"), F.max(F.col("year")).over(w).alias("last"), F.avg("year").over(w).alias("middle"))


def quantile_map_detrended(hindcast: DataFrame, obs: DataFrame, forecast: DataFrame) -> DataFrame:
    """Empirical mapping between detrended records; the model's trend at its last year is taken off before and put back after."""
    g, o = detrended(ensemble_mean(hindcast)), detrended(obs)
    trend = g.groupBy("cell").agg(F.first(F.col("slope") * (F.col("last") - F.col("middle"))).alias("trend"))
    out = forecast.join(sorted_record(g, "s"), "cell").join(trend, "cell").join(sorted_record(o, "t"), "cell")
    x = F.col("value") - F.col("trend")
    return out.select("cell", "member", (empirical_map(x, F.col("s"), F.col("t")) + F.col("trend")).alias("value"))


def quantile_position(x: Column, source: Column, target: Column) -> Column:
    """The target's value at the share of the source strictly below x, kept within 0.01 and 0.99."""
    n = F.size(source)
    at = F.least(F.greatest(F.size(F.filter(source, lambda v: v < x)) / n, F.lit(0.01)), F.lit(0.99)) * (F.size(target) - 1)
    i = F.floor(at).cast("int")
    lo, hi = F.try_element_at(target, i + 1), F.try_element_at(target, F.least(i + 2, F.size(target)))
    return F.when(x.isNotNull() & (n > 0), lo + (at - i) * (hi - lo))


def bcsd_coarse(hindcast: DataFrame, obs: DataFrame, forecast: DataFrame) -> DataFrame:
    """Quantile correction on the model's grid. obs: on that grid."""
    out = forecast.join(sorted_record(ensemble_mean(hindcast), "s"), "cell").join(sorted_record(obs, "t"), "cell")
    return out.select("cell", "member", quantile_position(F.col("value"), F.col("s"), F.col("t")).alias("value"))


def bcsd_detail(climatology: DataFrame, coarse_lats: list[float], coarse_lons: list[float]) -> DataFrame:
    """What the fine climatology has beyond its own coarse version. climatology: lat, lon, value."""
    back = regrid(regrid(climatology, [], coarse_lats, coarse_lons), [], axis(climatology, "lat"), axis(climatology, "lon"))
    j = climatology.join(back.withColumnRenamed("value", "_b"), ["lat", "lon"])
    return j.select("lat", "lon", (F.col("value") - F.col("_b")).alias("detail"))


def climatology_forecast(obs: DataFrame, forecast: DataFrame) -> DataFrame:
    """The observed mean for every member of the forecast."""
    return forecast.select("cell", "member").join(obs.groupBy("cell").agg(F.avg("value").alias("value")), "cell")


def ereg_fit(hindcast: DataFrame, obs: DataFrame) -> DataFrame:
    """Regression of observations on the ensemble mean: slope, intercept, error variance; three years at least."""
    x = hindcast.groupBy("cell", "year").agg(F.avg("value").alias("x"))
    g = x.join(obs.select("cell", "year", F.col("value").alias("y")), ["cell", "year"]).groupBy("cell")
    f = g.agg(F.count("y").alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy"))
    f = f.where("n >= 3 AND sxx >= 1e-12")
    return f.select("cell", "n", "slope", "intercept", ((F.col("syy") - F.col("sxy") ** 2 / F.col("sxx")) / F.greatest(F.col("n") - 2, F.lit(1))).alias("pev"))


def leave_one_out(pairs: DataFrame) -> DataFrame:
    """Each year's prediction by a regression on the other years, without refitting. pairs: cell, year, x, y."""
    w = Window.partitionBy("cell")
    e = F.col("y") - F.regr_intercept("y", "x").over(w) - F.regr_slope("y", "x").over(w) * F.col("x")
    h = 1 / F.count("x").over(w) + (F.col("x") - F.avg("x").over(w)) ** 2 / F.regr_sxx("y", "x").over(w)
    return pairs.select("cell", "year", "y", (F.col("y") - e / (1 - h)).alias("prediction"))


def prediction_error_variance(cv: DataFrame) -> DataFrame:
    d = F.col("prediction") - F.col("y")
    return cv.groupBy("cell").agg(F.avg(d * d).alias("pev"))


def error_bounds(cv: DataFrame, level: float = 0.8) -> DataFrame:
    """Quantiles (type 7) of the errors to take from a forecast."""
    e, tail = F.col("prediction") - F.col("y"), (1 - level) / 2
    return cv.groupBy("cell").agg(F.percentile(e, F.lit(tail)).alias("low"), F.percentile(e, F.lit(1 - tail)).alias("high"))


def qm_detrended_slope(rows: DataFrame) -> DataFrame:
    return rows.groupBy("cell").agg(F.regr_slope("value", "year").alias("slope"))


def ereg_forecast(hindcast: DataFrame, obs: DataFrame, forecast: DataFrame, floor: float | None = None) -> DataFrame:
    """Tercile probabilities by regression on the ensemble mean.

    The error variance is widened by 1/n + (x - mean)^2 / Sxx; boundaries (type 7) are the observations'. Cells whose lower boundary is under the
    floor have none. forecast: cell, value of members.
    """
    x = ensemble_mean(hindcast).withColumnRenamed("value", "x")
    pairs = x.join(obs.select("cell", "year", F.col("value").alias("y")), ["cell", "year"]).where("x IS NOT NULL AND y IS NOT NULL")
    m = pairs.groupBy("cell").agg(F.avg("x").alias("xm"), F.regr_sxx("y", "x").alias("sxx"))
    f = forecast.groupBy("cell").agg(F.avg("value").alias("xf"))
    j = ereg_fit(hindcast, obs).join(m, "cell").join(f, "cell").join(type7_boundaries(obs, ["cell"]), "cell")
    d = F.col("xf") - F.col("xm")
    j = j.withColumn("mu", F.col("intercept") + F.col("slope") * F.col("xf"))
    j = j.withColumn("sd", F.sqrt(at_least(F.col("pev") * (1 + 1 / F.col("n") + d * d / F.col("sxx")), 1e-12)))
    if floor is not None:
        j = j.withColumn("lo", F.when(F.col("lo") >= floor, F.col("lo")))
    out = j.select("cell", "mu", *gaussian_split(F.col("mu"), F.col("sd"), F.col("lo"), F.col("hi")))
    return out.withColumn("p_above", F.when(F.col("p_below").isNotNull(), F.col("p_above")))


def normal_bounds(cv: DataFrame, z: float = 1.2815515655446004) -> DataFrame:
    """Bias of the errors plus and minus z standard deviations (ddof 1); z is of a level of 0.8."""
    e = F.col("prediction") - F.col("y")
    g = cv.groupBy("cell").agg(F.avg(e).alias("m"), F.stddev_samp(e).alias("s"))
    return g.select("cell", (F.col("m") - z * F.col("s")).alias("low"), (F.col("m") + z * F.col("s")).alias("high"))


def seasonal_coefficients(pairs: DataFrame, pooled: bool = False) -> DataFrame:
    """cell, season, a: slope of observations on the ensemble mean by season, or one over all seasons' anomalies. pairs: cell, season, year, x, y."""
    if not pooled:
        return pairs.groupBy("cell", "season").agg(F.regr_slope("y", "x").alias("a"))
    w = Window.partitionBy("cell", "season")
    anomalies = pairs.select("cell", "season", (F.col("x") - F.avg("x").over(w)).alias("x"), (F.col("y") - F.avg("y").over(w)).alias("y"))
    slope = anomalies.groupBy("cell").agg(F.regr_slope("y", "x").alias("a"))
    return pairs.select("cell", "season").distinct().join(slope, "cell")


def smooth_seasons(coefficients: DataFrame, seasons: int, sigma: float) -> DataFrame:
    """Cyclic Gaussian mean over the season axis (0-based), its kernel cut at four sigma."""
    radius = int(4 * sigma + 0.5)
    k = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-radius, radius + 1)] if sigma > 0 else [1.0]
    offsets = F.explode(F.array(*[F.struct(F.lit(i - len(k) // 2).alias("o"), F.lit(v / sum(k)).alias("w")) for i, v in enumerate(k)])).alias("_k")
    dealt = coefficients.select("cell", "season", "a", offsets)
    season = F.pmod(F.col("season") + F.col("_k.o"), F.lit(seasons))
    return dealt.groupBy("cell", season.alias("season")).agg(F.sum(F.col("_k.w") * F.col("a")).alias("a"))


def smoothed_forecast(pairs: DataFrame, coefficients: DataFrame, forecast: DataFrame) -> DataFrame:
    """Observed climatology of the season plus a times the forecast's anomaly. forecast: cell, season, x."""
    m = pairs.groupBy("cell", "season").agg(F.avg("x").alias("xm"), F.avg("y").alias("ym"))
    j = forecast.join(m, ["cell", "season"]).join(coefficients, ["cell", "season"])
    return j.select("cell", "season", (F.col("ym") + F.col("a") * (F.col("x") - F.col("xm"))).alias("value"))


def scale_fit(rows: DataFrame, keys: list[str]) -> DataFrame:
    """a = Cov / Var of the ensemble mean and b, which sizes the spread so that the total variance is the observed one (ddof 0); three years at least. rows: mu, sigma, y."""
    whole = rows.where("mu IS NOT NULL AND sigma IS NOT NULL AND y IS NOT NULL")
    g = whole.groupBy(*keys).agg(F.count("y").alias("n"), F.covar_pop("mu", "y").alias("c"), F.var_pop("mu").alias("v"), F.var_pop("y").alias("vo"), F.avg(F.col("sigma") * F.col("sigma")).alias("s2"))
    sound = (F.col("n") >= 3) & (F.col("v") >= 1e-12) & (F.col("s2") >= 1e-12)
    a = F.col("c") / F.col("v")
    b = F.sqrt(F.greatest(F.col("vo") - a * a * F.col("v"), F.lit(0.0)) / F.col("s2"))
    return g.select(*keys, F.when(sound, a).alias("a"), F.when(sound, b).alias("b"))


def smoothed_terciles(members: DataFrame, obs: DataFrame, forecast: DataFrame, seasons: int = 4, sigma: float | None = None) -> DataFrame:
    """Shares below, within and above the terciles of the observed anomalies of a season, of a normal distribution scaled by a and b.

    members: cell, season, year, member, value; obs: cell, season, year, value;
    forecast: cell, season, member, value. sigma smooths a and b over the seasons.
    """
    keys = ["cell", "season"]
    reduced = [F.avg("value").alias("mu"), F.stddev_pop("value").alias("sigma")]
    h = members.groupBy(*keys, "year").agg(*reduced)
    fit = scale_fit(h.join(obs.withColumnRenamed("value", "y"), [*keys, "year"]), keys)
    if sigma is not None:
        smooth = [smooth_seasons(fit.select(*keys, F.col(c).alias("a")), seasons, sigma).withColumnRenamed("a", c) for c in ("a", "b")]
        fit = smooth[0].join(smooth[1], keys)
    third = [F.percentile("value", F.lit(k / 3)) - F.avg("value") for k in (1, 2)]
    bounds = obs.groupBy(*keys).agg(third[0].alias("lo"), third[1].alias("hi")).withColumn("hi", F.when(F.col("lo") < F.col("hi"), F.col("hi")).otherwise(F.col("lo") + 1e-6))
    clim = h.groupBy(*keys).agg(F.avg("mu").alias("_c"))
    j = forecast.groupBy(*keys).agg(*reduced).join(clim, keys).join(fit, keys).join(bounds, keys)
    return j.select(*keys, *gaussian_split(F.col("a") * (F.col("mu") - F.col("_c")), F.abs("b") * F.col("sigma"), F.col("lo"), F.col("hi")))


def gamma_fit(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Shape and scale of positive values by moments (ddof 0); three values at least, null without variance."""
    g = rows.where("value > 0").groupBy(*keys).agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    sound = (F.col("n") >= 3) & (F.col("m") >= 1e-12) & (F.col("v") >= 1e-12)
    return g.select(*keys, F.when(sound, F.col("m") * F.col("m") / F.col("v")).alias("shape"), F.when(sound, F.col("v") / F.col("m")).alias("scale"))


def inner(p: Column) -> Column:
    """A probability kept 1e-6 off both ends."""
    return F.when(p > 1 - 1e-6, F.lit(1 - 1e-6)).otherwise(at_least(p, 1e-6))


def gamma_to_normal(x: Column, shape: Column, scale: Column) -> Column:
    return normal_ppf(inner(gamma_cdf(x, shape, scale)))


def normal_to_gamma(z: Column, shape: Column, scale: Column) -> Column:
    return gamma_ppf(inner(normal_cdf(z)), shape, scale)


def finite(rows: DataFrame, name: str) -> DataFrame:
    """Rows with a finite value; ValueError if there are none."""
    v = F.col("value")
    out = rows.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    if not out.limit(1).count():
        raise ValueError(f"{name} has no finite value")
    return out


#: Values of a series, at most, that an empirical map holds.
MOST_VALUES = 100_000


def map_series(rows: DataFrame, source: DataFrame, target: DataFrame, how: str = "parametric", linear: bool = False) -> DataFrame:
    """rows with each value carried from one series' distribution to another's: by mean and deviation (ddof 1), or by quantiles."""
    source, target = finite(source, "source"), finite(target, "target")
    if how == "parametric":
        m = [t.agg(F.avg("value").alias(f"_{n}m"), F.stddev_samp("value").alias(f"_{n}s")) for n, t in (("s", source), ("t", target))]  # a row each
        j = rows.crossJoin(F.broadcast(m[0])).crossJoin(F.broadcast(m[1]))
        s = F.when(F.col("_ss") < 1e-12, 1.0).otherwise(F.col("_ss"))
        return j.withColumn("value", F.col("_tm") + (F.col("value") - F.col("_sm")) / s * F.col("_ts")).drop("_sm", "_ss", "_tm", "_ts")
    if how != "empirical":
        raise ValueError(f"unknown variant {how!r}")
    held = []
    for t in (source, target):
        values = [r.value for r in t.select("value").limit(MOST_VALUES + 1).collect()]
        if len(values) > MOST_VALUES:
            raise ValueError(f"a series of more than {MOST_VALUES} values")
        held.append(F.lit(sorted(map(float, values))))
    return rows.withColumn("value", empirical_map(F.col("value"), *held, linear))
