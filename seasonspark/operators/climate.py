"""Positions in a record, climatologies and window reductions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seasonspark.functions.special import gamma_cdf, normal_cdf


def accumulate_rolling(rows: DataFrame, keys: list[str], order: str, window: int, how: str = "sum") -> DataFrame:
    """Trailing reduction over window steps; null until the window is full."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - window, 0)
    f = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min}[how]
    return rows.withColumn("acc", F.when(F.count("value").over(w) == window, f("value").over(w)))


def percentile_position(rows: DataFrame, keys: list[str], how: str = "empirical") -> DataFrame:
    """Each value's place in its group's record.

    empirical: (below + ties / 2) / n; weibull: Weibull's; gaussian: of a normal
    distribution (ddof 0), null without spread; gamma: dry values at half their
    share p0, wet ones at p0 + (1 - p0) times a gamma distribution fitted to the
    wet ones by moments (ddof 1), null with fewer than two of these.
    """
    g = Window.partitionBy(*keys)
    rows = rows.where("value IS NOT NULL")
    n = F.count("value").over(g)
    if how == "gaussian":
        sd = F.stddev_pop("value").over(g)
        return rows.withColumn("position", normal_cdf((F.col("value") - F.avg("value").over(g)) / F.when(sd >= 1e-12, sd)))
    if how == "gamma":
        wet = F.when(F.col("value") > 0, F.col("value"))
        m, v, wets = F.avg(wet).over(g), F.var_samp(wet).over(g), F.count(wet).over(g)
        v = F.when(v >= 1e-12, v)
        fitted = rows.withColumns({"_dry": 1 - wets / n, "_wets": wets, "_k": m * m / v, "_s": v / m})
        above = F.col("_dry") + (1 - F.col("_dry")) * gamma_cdf("value", "_k", "_s")
        p = F.when(F.col("_wets") >= 2, F.when(F.col("value") > 0, above).otherwise(0.5 * F.col("_dry")))
        return fitted.withColumn("position", F.when(~F.isnan(p), p)).drop("_dry", "_wets", "_k", "_s")
    if how not in ("empirical", "weibull"):
        raise ValueError(f"no position is called {how!r}")
    below, tied = F.rank().over(g.orderBy("value")) - 1, F.count("value").over(Window.partitionBy(*keys, "value"))
    p = (below + 0.5 * tied) / n if how == "empirical" else (below + 0.5 * tied + 0.5) / (n + 1)
    return rows.withColumn("position", p)


def percent_of_normal(rows: DataFrame, keys: list[str], threshold: float = 0.0) -> DataFrame:
    mean = F.avg("value").over(Window.partitionBy(*keys))
    return rows.withColumn("percent", F.when(mean > threshold, 100 * F.col("value") / mean))


def rank_of_record(rows: DataFrame, keys: list[str], highest: bool = True) -> DataFrame:
    order = F.col("value").desc() if highest else F.col("value").asc()
    return rows.where("value IS NOT NULL").withColumn("rank", F.rank().over(Window.partitionBy(*keys).orderBy(order)))


def quantile(rows: DataFrame, keys: list[str], q: float, name: str) -> DataFrame:
    """The q-quantile (type 7) of each record, null without values.

    a (1 - d) + b d with the first product unrounded, as SQL's quantile_cont has it: a value that
    meets the quantile exactly compares as there.
    """
    w = Window.partitionBy(*keys)
    place = F.row_number().over(w.orderBy(F.col("value").asc_nulls_last())) - 1
    ranked = rows.select(*keys, F.col("value").cast("double").alias("_v"), place.alias("_r"), ((F.count("value").over(w) - 1) * F.lit(q)).alias("_x"))
    a, b = (F.max(F.when(F.col("_r") == f("_x"), F.col("_v"))) for f in (F.floor, F.ceil))
    at = ranked.groupBy(*keys).agg(F.max("_x").alias("_x"), a.alias("_a"), b.alias("_b"))
    d = F.col("_x") - F.floor("_x")
    between = F.java_method(F.lit("java.lang.Math"), F.lit("fma"), F.col("_a"), 1 - d, F.col("_b") * d).cast("double")
    return at.select(*keys, F.when((d == 0) | F.col("_a").isNull(), F.col("_a")).otherwise(between).alias(name))


def frequency_below(sample: DataFrame, climatology: DataFrame, keys: list[str], q: float) -> DataFrame:
    """Share of a sample below the q-quantile (type 7) of the climatology."""
    level = quantile(climatology, keys, q, "_t")
    share = F.avg(F.when(F.col("value").isNotNull(), (F.col("value") < F.col("_t")).cast("double")))
    return sample.join(level, keys).groupBy(*keys).agg(share.alias("frequency"))


def doy_climatology(daily: DataFrame, smooth: int = 1) -> DataFrame:
    """Mean by day of the year; smoothed by a centred cyclic mean over the days that are there."""
    mean = daily.groupBy("cell", F.dayofyear("d").alias("doy")).agg(F.avg("value").alias("m"))
    if smooth == 1:
        return mean.select("cell", "doy", F.col("m").alias("clim"))
    half = smooth // 2
    shifted = mean.select("cell", F.explode(F.sequence(F.col("doy") - half, F.col("doy") + half)).alias("x"), "m")
    wrapped = shifted.select("cell", (F.pmod(F.col("x") - 1, F.lit(366)) + 1).cast("int").alias("doy"), "m")
    return wrapped.groupBy("cell", "doy").agg(F.avg("m").alias("clim"))


def doy_anomaly(daily: DataFrame, clim: DataFrame) -> DataFrame:
    d = daily.withColumn("doy", F.dayofyear("d"))
    return d.join(clim, ["cell", "doy"]).select("cell", "d", (F.col("value") - F.col("clim")).alias("anomaly"))


def seasonal_reduce(daily: DataFrame, months: list[int], how: str = "sum") -> DataFrame:
    """By calendar year, without wrapping."""
    f = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min}[how]
    return daily.where(F.month("d").isin(months)).groupBy("cell", F.year("d").alias("year")).agg(f("value").alias("value"))


def lead_window_reduce(leads: DataFrame, windows: dict[str, tuple[int, int]], how: str = "mean") -> DataFrame:
    """Windows of 1-based inclusive lead days; day = ceil(hours / 24)."""
    day = F.greatest(F.ceil(F.col("lead_h") / 24.0), F.lit(1))
    f = {"sum": F.sum, "mean": F.avg, "max": F.max}[how]
    names = F.array(*[F.when(day.between(a, b), F.lit(n)) for n, (a, b) in windows.items()])
    dealt = leads.select("cell", "value", F.explode(F.array_compact(names)).alias("window"))
    return dealt.groupBy("cell", "window").agg(f("value").alias("value"))


def index_box(rows: DataFrame, inside: Column, how: str = "raw") -> DataFrame:
    """Mean over the cells of a box by year; raw, anomaly or standardized (ddof 0) over years."""
    mean = rows.where(inside).groupBy("year").agg(F.avg("value").alias("v"))
    over = Window.partitionBy(F.lit(0))  # one row a year
    if how == "raw":
        return mean.select("year", F.col("v").alias("index"))
    centred = F.col("v") - F.avg("v").over(over)
    return mean.select("year", (centred if how == "anomaly" else centred / F.stddev_pop("v").over(over)).alias("index"))


# Weights of the boxes of composite indices.
COMPOSITES = {
    "wvg3": {"nino34": 1.0, "wnp": -1 / 3, "wep": -1 / 3, "wsp": -1 / 3},
    "wvg2": {"nino34": 1.0, "wnp": -0.5, "wep": -0.5},
    "dmi": {"wtio": 1.0, "setio": -1.0},
    "roni": {"nino34": 1.0, "tropics": -1.0},
}


def composite(boxes: DataFrame, keys: list[str], name: str) -> DataFrame:
    """A weighted sum of box indices, null where a box lacks a value. boxes: keys, box, index."""
    parts = COMPOSITES[name]
    w = F.create_map(*[F.lit(x) for part in parts.items() for x in part])
    whole = F.count("index") == len(parts)
    return boxes.where(F.col("box").isin(*parts)).groupBy(*keys).agg(F.when(whole, F.sum(w[F.col("box")] * F.col("index"))).alias("index"))


def pixel_standardize(members: DataFrame, climatology: DataFrame) -> DataFrame:
    """The members' mean as standard scores (ddof 1) of the cell's climatology; null without spread."""
    c = climatology.groupBy("cell").agg(F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"))
    z = (F.col("_v") - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s"))
    return members.groupBy("cell", "year").agg(F.avg("value").alias("_v")).join(c, "cell", "left").select("cell", "year", z.alias("z"))


def cosine_weight(lat: Column) -> Column:
    """Weight of a latitude, 0 at least."""
    return F.greatest(F.cos(F.radians(lat)), F.lit(0.0))


def custom_index(rows: DataFrame, boxes: dict[str, Column], combine, how: str = "raw") -> DataFrame:
    """year and value: boxes, each reduced by index_box(), combined by a function of a mapping from names to columns."""
    out = None
    for name, inside in boxes.items():
        one = index_box(rows, inside, how).withColumnRenamed("index", name)
        out = one if out is None else out.join(one, "year")
    return out.select("year", combine({n: F.col(n) for n in boxes}).alias("value"))
