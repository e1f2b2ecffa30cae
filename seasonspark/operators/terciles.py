"""Tercile boundaries, categories and probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seasonspark.functions.special import at_least, normal_cdf, normal_ppf, t_cdf

THIRDS = (1 / 3, 2 / 3)


def cpt_boundaries(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Boundaries at position n p + 1/2 of the sorted record; null below three values or where they coincide."""
    w = Window.partitionBy(*keys)
    ranked = rows.where("value IS NOT NULL").select(*keys, "value", F.row_number().over(w.orderBy("value")).alias("_r"), F.count("value").over(w).alias("_n"))

    def at(p: float) -> Column:
        x = F.col("_n") * F.lit(p) + 0.5
        i = F.floor(x)
        return F.sum(F.when(F.col("_r") == i, F.col("value") * (1 - (x - i))).when(F.col("_r") == i + 1, F.col("value") * (x - i)).otherwise(0.0))

    out = ranked.groupBy(*keys).agg(F.max("_n").alias("_n"), at(THIRDS[0]).alias("lo"), at(THIRDS[1]).alias("hi"))
    sound = (F.col("_n") >= 3) & (F.col("lo") != F.col("hi"))
    return out.select(*keys, *[F.when(sound, F.col(c)).alias(c) for c in ("lo", "hi")])


def type7_boundaries(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.percentile("value", F.lit(p)).alias(c) for p, c in zip(THIRDS, ("lo", "hi"), strict=True)])


def category(value: Column, lo: Column, hi: Column) -> Column:
    """0 below lo, 1 below hi, else 2; null where anything is missing."""
    return F.when(value.isNull() | lo.isNull() | hi.isNull(), None).when(lo > value, 0).when(hi > value, 1).otherwise(2)


def counting_probabilities(members: DataFrame, bounds: DataFrame, keys: list[str], cell: list[str]) -> DataFrame:
    """Shares of members strictly outside the boundaries; the rest, missing ones too, are normal."""
    n = F.count(F.lit(1))
    below = F.count(F.when(F.col("value") < F.col("lo"), 1)) / n
    above = F.count(F.when(F.col("value") > F.col("hi"), 1)) / n
    out = members.join(bounds, cell).groupBy(*keys).agg(below.alias("p_below"), above.alias("p_above"))
    return out.select(*keys, "p_below", (1 - F.col("p_below") - F.col("p_above")).alias("p_normal"), "p_above")


def combine(models: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted mean over models whose three probabilities are all there. models: keys, weight, p_*."""
    ps = ["p_below", "p_normal", "p_above"]
    whole = models.where(" AND ".join(f"{p} IS NOT NULL" for p in ps))
    return whole.groupBy(*keys).agg(*[(F.sum(F.col("weight") * F.col(p)) / F.sum("weight")).alias(p) for p in ps])


def shares(below: Column, above: Column) -> list[Column]:
    return [below.alias("p_below"), (1 - below - above).alias("p_normal"), above.alias("p_above")]


def gaussian_split(mu: Column, sigma: Column, lo: Column, hi: Column) -> list[Column]:
    """Shares of a normal distribution; its spread is 1e-12 at least."""
    sd = at_least(sigma, 1e-12)
    return shares(normal_cdf((lo - mu) / sd), 1 - normal_cdf((hi - mu) / sd))


def gaussian_probabilities(members: DataFrame, bounds: DataFrame, keys: list[str], cell: list[str]) -> DataFrame:
    """Of a normal distribution with the members' mean and standard deviation (ddof 0)."""
    m = members.groupBy(*keys).agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s")).join(bounds, cell)
    return m.select(*keys, *gaussian_split(F.col("_m"), F.col("_s"), F.col("lo"), F.col("hi")))


def student_forecast(rows: DataFrame, keys: list[str], dof: int) -> DataFrame:
    """Of Student's t around loc with error variance s2 (1 + leverage). rows: keys, loc, lo, hi, s2, leverage."""
    sd = F.sqrt(at_least(F.col("s2") * (1 + F.col("leverage")), 1e-24))
    below = t_cdf((F.col("lo") - F.col("loc")) / sd, dof)
    return rows.select(*keys, *shares(below, 1 - t_cdf((F.col("hi") - F.col("loc")) / sd, dof)))


def others(cv: DataFrame) -> DataFrame:
    """Each year beside every other year of its cell. cv: cell, year, prediction, y; as many rows as the square of a record's years."""
    o = cv.select("cell", F.col("year").alias("_year"), F.col("y").alias("oy"), (F.col("prediction") - F.col("y")).alias("e"))
    return cv.join(o, "cell").where("year <> _year")


def cv_bootstrap(cv: DataFrame) -> DataFrame:
    """Each year's prediction less the other years' errors, counted against the other years' boundaries (type 7)."""
    lo, hi = (F.percentile("oy", F.lit(p)) for p in THIRDS)
    g = others(cv).groupBy("cell", "year").agg(lo.alias("lo"), hi.alias("hi"), F.first("prediction").alias("f"), F.collect_list("e").alias("es"))
    n = F.size("es")
    below = F.size(F.filter("es", lambda e: F.col("f") - e < F.col("lo"))) / n
    above = F.size(F.filter("es", lambda e: F.col("f") - e > F.col("hi"))) / n
    return g.where("f IS NOT NULL").select("cell", "year", *shares(below, above))


def cv_gaussian(cv: DataFrame) -> DataFrame:
    """Normal with the other years' error variance and boundaries."""
    lo, hi = (F.percentile("oy", F.lit(p)) for p in THIRDS)
    g = others(cv).groupBy("cell", "year").agg(lo.alias("lo"), hi.alias("hi"), F.first("prediction").alias("f"), F.avg(F.col("e") * F.col("e")).alias("v"))
    return g.select("cell", "year", *gaussian_split(F.col("f"), F.sqrt(at_least(F.col("v"), 1e-24)), F.col("lo"), F.col("hi")))


def cv_pooled(cv: DataFrame) -> DataFrame:
    """Normal with the error variance, (n - 2) / n of the mean square, and boundaries of all years."""
    w, e = Window.partitionBy("cell"), F.col("prediction") - F.col("y")
    n = F.count("y").over(w)
    sd = F.sqrt((n - 2) / n * F.avg(e * e).over(w))
    lo, hi = (F.percentile("y", F.lit(p)).over(w) for p in THIRDS)
    g = cv.select("cell", "year", "prediction", sd.alias("sd"), lo.alias("lo"), hi.alias("hi"))
    return g.select("cell", "year", *gaussian_split(F.col("prediction"), F.col("sd"), F.col("lo"), F.col("hi")))


def cv_student(cv: DataFrame, years: int, modes: int, leverages: DataFrame | None = None) -> DataFrame:
    """Student's t with years - modes - 1 degrees of freedom around each prediction. leverages: year, leverage."""
    dof, e = years - modes - 1, F.col("prediction") - F.col("y")
    if dof < 1:
        raise ValueError(f"{years} years leave no degree of freedom for {modes} modes")
    bounds = cpt_boundaries(cv.select("cell", F.col("y").alias("value")), ["cell"])
    s2 = (F.sum(e * e).over(Window.partitionBy("cell")) / dof).alias("s2")
    rows = cv.select("cell", "year", F.col("prediction").alias("loc"), s2).join(bounds, "cell")
    rows = rows.withColumn("leverage", F.lit(0.0)) if leverages is None else rows.join(leverages, "year")
    return student_forecast(rows, ["cell", "year"], dof)


def normal_scores(rows: DataFrame, keys: list[str], itself: bool = True) -> DataFrame:
    """Normal quantile of each value's average rank: (r + 1/2) / (n + 1), or r / (n + 1). Null throughout a group with a missing value."""
    w = Window.partitionBy(*keys)
    n, tied = F.count("value").over(w), F.count("value").over(Window.partitionBy(*keys, "value"))
    rank = F.rank().over(w.orderBy("value")) + (tied - 1) / 2
    p = (rank + (0.5 if itself else 0.0)) / (n + 1)
    whole = n == F.count(F.lit(1)).over(w)
    return rows.withColumn("_p", F.when(whole, p)).withColumn("score", normal_ppf(F.col("_p"))).drop("_p")


def exceedance(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Probability above a threshold of a normal forecast. rows: keys, mu, pev, threshold."""
    sd = F.sqrt(at_least(F.col("pev"), 1e-24))
    return rows.select(*keys, (1 - normal_cdf((F.col("threshold") - F.col("mu")) / sd)).alias("p_exceed"))


def simplex(rows: DataFrame) -> DataFrame:
    """Probabilities over their sum; null in all three where one is missing or the sum is not positive."""
    ps = ["p_below", "p_normal", "p_above"]
    total = F.col(ps[0]) + F.col(ps[1]) + F.col(ps[2])
    return rows.withColumns({p: F.when(total > 0, F.col(p) / total) for p in ps})


def labels(value: Column, lo: Column, hi: Column, inclusive: bool = False) -> Column:
    """0 below lo, 2 above hi, else 1; values on a boundary are normal, or outer where inclusive."""
    below, above = (value <= lo, value >= hi) if inclusive else (value < lo, value > hi)
    return F.when(value.isNull() | lo.isNull() | hi.isNull(), None).when(below, 0).when(above, 2).otherwise(1)


def class_codes(rows: DataFrame, bins: list[float], secondary: float | None = None) -> DataFrame:
    """Map class of the leading category: above, normal and below have a class a bin each; -1 where none leads or one is missing.

    bins are lower ends in per cent; secondary is the share that the rival outer category must stay under.
    """
    n, pct = len(bins), {c: 100 * F.col(f"p_{c}") for c in ("below", "normal", "above")}
    b, m, a = pct["below"], pct["normal"], pct["above"]
    lead = F.greatest(b, m, a)
    first = F.when(b == lead, 2 * n).when(m == lead, n).otherwise(0)
    none = b.isNull() | m.isNull() | a.isNull() | (lead < bins[0])
    if secondary is not None:
        rival = F.when(b == lead, a).when(m == lead, F.greatest(a, b)).otherwise(b)
        none = none | (rival >= secondary)
    step = sum(F.when(lead >= x, 1).otherwise(0) for x in bins[1:]) if n > 1 else F.lit(0)
    return rows.withColumn("code", F.when(none, -1).otherwise(first + step))


def transformed_boundaries(obs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, lo and hi: the terciles of a normal distribution, for groups with data."""
    from statistics import NormalDist

    lo, hi = (NormalDist().inv_cdf(k / 3) for k in (1, 2))
    return obs.where("value IS NOT NULL").select(*keys).distinct().select(*keys, F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))


def as_probability(rows: DataFrame, columns=("p_below", "p_normal", "p_above")) -> DataFrame:
    """The columns marked as probabilities in their metadata."""
    for c in columns:
        rows = rows.withMetadata(c, {"units": "1", "long_name": "probability"})
    return rows
