"""Verification scores over joined forecast and observation rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seasonspark.functions.special import at_least, normal_cdf, normal_pdf


#: Strips of running sums.
STRIPS = 64


def rps_terms(pairs: DataFrame) -> DataFrame:
    """Adds rps and clim, the halved squared distances of cumulative probabilities. pairs: cat, p_below, p_normal."""
    o1, o2 = (F.col("cat") <= 0).cast("double"), (F.col("cat") <= 1).cast("double")
    f1, f2 = F.col("p_below"), F.col("p_below") + F.col("p_normal")

    def half(a, b):
        return ((a - o1) * (a - o1) + (b - o2) * (b - o2)) / 2

    return pairs.withColumns({"rps": half(f1, f2), "clim": half(F.lit(1 / 3), F.lit(2 / 3))})


def rpss(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    g = rps_terms(pairs).groupBy(*(keys or []))
    return g.agg((1 - F.avg("rps") / F.avg("clim")).alias("rpss"))


def pearson(pairs: DataFrame, keys: list[str]) -> DataFrame:
    return pairs.groupBy(*keys).agg(F.corr("fc", "obs").alias("r"))


def in_order(keys: list[str], order: str):
    """Each record as a whole, added up row by row in the order of a column: sums are the same to the last bit in reruns and for copies."""
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def mean_in_order(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys and value, the mean, added up in order."""
    return rows.select(*keys, F.avg("value").over(in_order(keys, order)).alias("value")).groupBy(*keys).agg(F.max("value").alias("value"))


def pearson_in_order(pairs: DataFrame, keys: list[str], order: str) -> DataFrame:
    """As pearson, added up in order; NaN without spread."""
    w, both = in_order(keys, order), F.col("fc").isNotNull() & F.col("obs").isNotNull()
    t = pairs.select(*keys, order, F.when(both, F.col("fc")).alias("_x"), F.when(both, F.col("obs")).alias("_y"))
    flat = (F.min("_x").over(w) == F.max("_x").over(w)) | (F.min("_y").over(w) == F.max("_y").over(w))
    t = t.select(*keys, order, flat.alias("_flat"), *[(F.col(c) - F.avg(c).over(w)).alias(c) for c in ("_x", "_y")])
    xy, xx, yy = (F.sum(F.col(a) * F.col(b)).over(w) for a, b in (("_x", "_y"), ("_x", "_x"), ("_y", "_y")))
    t = t.select(*keys, "_flat", xy.alias("_xy"), (F.sqrt(xx) * F.sqrt(yy)).alias("_d"))
    g = t.groupBy(*keys).agg(*[F.max(c).alias(c) for c in ("_flat", "_xy", "_d")])  # the same in all rows of a record
    r = F.when(F.col("_flat") | (F.col("_d") == 0), float("nan")).otherwise(F.col("_xy") / F.nullif("_d", F.lit(0.0)))
    return g.select(*keys, r.alias("r"))


def average_rank(v: str, keys: list[str]) -> Column:
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(v)) + (F.count(v).over(Window.partitionBy(*keys, v)) - 1) / 2


def spearman(pairs: DataFrame, keys: list[str]) -> DataFrame:
    ranked = pairs.select(*keys, average_rank("fc", keys).alias("fc"), average_rank("obs", keys).alias("obs"))
    return pearson(ranked, keys).withColumnRenamed("r", "rho")


def rmse(pairs: DataFrame, keys: list[str]) -> DataFrame:
    d = F.col("fc") - F.col("obs")
    return pairs.groupBy(*keys).agg(F.sqrt(F.avg(d * d)).alias("rmse"))


def msss(pairs: DataFrame, keys: list[str]) -> DataFrame:
    d = F.col("fc") - F.col("obs")
    per = pairs.groupBy(*keys).agg(F.avg(d * d).alias("mse"), F.var_pop("obs").alias("var")).where("var > 0")
    return per.agg((1 - F.avg("mse") / F.avg("var")).alias("msss"))


def two_afc(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Share of ordered pairs of a cell's years that the forecast ranks as observed, ties half; years of one cell only meet."""
    a = pairs.select(*keys, F.col("fc").alias("f1"), F.col("obs").alias("o1"))
    b = pairs.select(*keys, F.col("fc").alias("f2"), F.col("obs").alias("o2"))
    won = F.when(F.col("f1") > F.col("f2"), 1.0).when(F.col("f1") == F.col("f2"), 0.5).otherwise(0.0)
    return a.join(b, keys).where("o1 > o2").groupBy(*keys).agg(F.avg(won).alias("score"))


def in_strips(rows: DataFrame, by: str, keys: list[str] | None = None) -> DataFrame:
    """Adds _strip, from 0: strips of about equal numbers of rows in the order of a column, so that running sums need no task with all rows."""
    cuts = rows.agg(F.percentile_approx(by, [i / STRIPS for i in range(1, STRIPS)], 1_000)).first()[0] or []
    return rows.withColumn("_strip", sum((F.when(F.col(by) > c, 1).otherwise(0) for c in sorted(set(cuts))), F.lit(0)))


def running(rows: DataFrame, by: str, value: str, keys: list[str] | None = None) -> DataFrame:
    """Adds under, the sum of a value over the rows before (by is distinct within the keys)."""
    keys = keys or []
    held = in_strips(rows, by)
    # A row a strip and key.
    sums = held.groupBy(*keys, "_strip").agg(F.sum(value).alias("_sum"))
    upto = Window.partitionBy(*keys).orderBy("_strip").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "_strip", F.coalesce(F.sum("_sum").over(upto), F.lit(0)).alias("_far"))
    inside = Window.partitionBy(*keys, "_strip").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    near = held.withColumn("_near", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return near.join(sums, [*keys, "_strip"]).withColumn("under", F.col("_far") + F.col("_near")).drop("_far", "_near", "_strip")


def roc_area(pairs: DataFrame, event: Column, p: str) -> DataFrame:
    """Area under the curve from rank sums, ties half."""
    hist = pairs.groupBy(F.col(p).alias("p")).agg(F.sum(event.cast("long")).alias("hit"), F.sum((~event).cast("long")).alias("miss"))
    area = F.sum(F.col("hit") * (F.col("under") + F.col("miss") / 2)) / (F.sum("hit") * F.sum("miss"))
    return running(hist, "p", "miss").agg(area.alias("area"))


def reliability_bins(pairs: DataFrame, event: Column, p: str, bins: int = 5) -> DataFrame:
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))
    return pairs.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(event.cast("double")).alias("freq"))


def heidke(pairs: DataFrame) -> DataFrame:
    """Hits of the most likely category (first of ties) over chance, from the pooled table. pairs: cat, p_*."""
    b, n, a = F.col("p_below"), F.col("p_normal"), F.col("p_above")
    top = F.when((b >= n) & (b >= a), 0).when(n >= a, 1).otherwise(2)
    t = pairs.select(top.alias("f"), F.col("cat").alias("o"))
    counts = [F.sum((F.col(c) == i).cast("double")) for c in "fo" for i in range(3)]
    r = t.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("f") == F.col("o")).cast("double")).alias("c"), *[x.alias(f"x{i}") for i, x in enumerate(counts)])
    e = sum(F.col(f"x{i}") * F.col(f"x{i + 3}") for i in range(3)) / F.col("n")
    return r.select(((F.col("c") - e) / (F.col("n") - e)).alias("hss"))


def spread_error(members: DataFrame, obs: DataFrame) -> DataFrame:
    """cell, year, spread (ddof 0) and absolute error of the ensemble mean."""
    e = members.groupBy("cell", "year").agg(F.stddev_pop("value").alias("spread"), F.avg("value").alias("mean"))
    return e.join(obs, ["cell", "year"]).select("cell", "year", "spread", F.abs(F.col("mean") - F.col("value")).alias("error"))


def loo_correlation(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Correlation of leave-one-out regression predictions, by leverages. pairs: x, y."""
    w = Window.partitionBy(*keys)
    slope, start = F.regr_slope("y", "x").over(w), F.regr_intercept("y", "x").over(w)
    h = 1 / F.count("x").over(w) + (F.col("x") - F.avg("x").over(w)) ** 2 / F.regr_sxx("y", "x").over(w)
    fit = pairs.select(*keys, "y", (F.col("y") - (F.col("y") - start - slope * F.col("x")) / (1 - h)).alias("p"))
    return fit.groupBy(*keys).agg(F.when(F.count("p") >= 5, F.corr("p", "y")).alias("r"))


def fdr_bh(tests: DataFrame, p: str = "p") -> DataFrame:
    """Benjamini-Hochberg q values over one family of tests."""
    held = tests.where(F.col(p).isNotNull())
    each = running(held.groupBy(F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_n")), "_p", "_n")
    m = each.agg(F.sum("_n")).first()[0] or 0
    each = in_strips(each.select("_p", (F.col("_p") * F.lit(m) / (F.col("under") + 1)).alias("_q")), "_p")
    # The least from a value on: of its strip's rest, and of the strips after.
    after = Window.orderBy(F.col("_strip").desc()).rowsBetween(Window.unboundedPreceding, -1)  # a row a strip
    least = each.groupBy("_strip").agg(F.min("_q").alias("_m")).select("_strip", F.min("_m").over(after).alias("_beyond"))
    rest = Window.partitionBy("_strip").orderBy(F.col("_p").desc()).rowsBetween(Window.unboundedPreceding, 0)
    q = each.withColumn("_q", F.min("_q").over(rest)).join(F.broadcast(least), "_strip")
    q = q.select("_p", F.least(F.lit(1.0), "_q", F.coalesce("_beyond", F.lit(1.0))).alias("q"))
    return held.join(q, F.col(p) == F.col("_p")).drop("_p")


def crps_normal(mu: Column, sigma: Column, obs: Column) -> Column:
    """Closed form; the spread is 1e-12 at least."""
    sd = at_least(sigma, 1e-12)
    z = (obs - mu) / sd
    return sd * (z * (2 * normal_cdf(z) - 1) + 2 * normal_pdf(z) - 1 / math.sqrt(math.pi))


def crpss(rows: DataFrame) -> DataFrame:
    """Anomalies against a normal climatology around 0 with the spread (ddof 0) of all observations. rows: mu, sigma, obs."""
    over = rows.agg(F.stddev_pop("obs").alias("_sd"))  # one row
    t = rows.join(F.broadcast(over)).select(crps_normal(F.col("mu"), F.col("sigma"), F.col("obs")).alias("f"), crps_normal(F.lit(0.0), F.col("_sd"), F.col("obs")).alias("c"))
    return t.agg((1 - F.avg("f") / F.when(F.avg("c") != 0, F.avg("c"))).alias("crpss"))


def groc(pairs: DataFrame) -> DataFrame:
    """Mean of the six directed areas between two categories, ties half; null where a category is absent. pairs: cat, p_*."""
    ps = [F.col("p_below"), F.col("p_normal"), F.col("p_above")]
    sides = [F.struct(F.lit(3 * c + o).alias("k"), ps[c].alias("p"), (F.col("cat") == c).alias("hit")) for c in range(3) for o in range(3) if c != o]
    keep = [(F.col("cat") == c) | (F.col("cat") == o) for c in range(3) for o in range(3) if c != o]
    dealt = pairs.select(F.explode(F.array_compact(F.array(*[F.when(k, s) for k, s in zip(keep, sides, strict=True)]))).alias("s"))
    hist = dealt.groupBy("s.k", "s.p").agg(F.sum(F.col("s.hit").cast("long")).alias("hit"), F.sum((~F.col("s.hit")).cast("long")).alias("miss"))
    run = running(hist, "p", "miss", ["k"])
    area = F.sum(F.col("hit") * (F.col("under") + F.col("miss") / 2)) / (F.sum("hit") * F.sum("miss"))
    areas = run.groupBy("k").agg(F.when(F.sum("hit") * F.sum("miss") > 0, area).alias("a"))
    return areas.agg(F.when(F.count("a") == 6, F.avg("a")).alias("groc"))


def reliability(pairs: DataFrame, bins: int = 5) -> DataFrame:
    """Weighted mean square of mean probability less frequency, over the bins of all three categories."""
    cats = [F.struct(F.lit(i).alias("c"), F.col(p).alias("p"), (F.col("cat") == i).cast("double").alias("o")) for i, p in enumerate(("p_below", "p_normal", "p_above"))]
    dealt = pairs.select(F.explode(F.array(*cats)).alias("s")).select("s.*")
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1))
    g = dealt.groupBy("c", b.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("p"), F.avg("o").alias("o"))
    d = F.col("p") - F.col("o")
    return g.agg((F.sum(F.col("n") * d * d) / F.sum("n")).alias("reliability"))


def kendall_tau(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """2 A - 1 over pairs of years of a cell: 1/2 where both series tie, else 1 where the signs agree, a difference of 0 having sign +1 for the earlier year."""
    a = pairs.select(*keys, F.col("year").alias("y1"), F.col("fc").alias("f1"), F.col("obs").alias("o1"))
    b = pairs.select(*keys, F.col("year").alias("y2"), F.col("fc").alias("f2"), F.col("obs").alias("o2"))
    j = a.join(b, keys).where("y1 < y2")
    df, do = F.col("f1") - F.col("f2"), F.col("o1") - F.col("o2")
    score = F.when((df == 0) & (do == 0), 0.5).when((df >= 0) == (do >= 0), 1.0).otherwise(0.0)
    return j.groupBy(*keys).agg((2 * F.avg(score) - 1).alias("tau"))


def score_pair(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Anomaly correlation, error and bias of a field. rows: pred, obs, clim."""
    d = F.col("pred") - F.col("obs")
    g = rows.where("pred IS NOT NULL AND obs IS NOT NULL").groupBy(*keys)
    acc = F.corr(F.col("pred") - F.col("clim"), F.col("obs") - F.col("clim"))
    return g.agg(acc.alias("acc"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(d).alias("bias"))


def permutation_test(pairs: DataFrame, rounds: int = 5000, alternative: str = "greater", seed: int = 0) -> DataFrame:
    """Share of permutations of y with a leave-one-out correlation at least as extreme, the data's own counted. pairs: cell, x, y; a cell's record is a group."""

    def one(x: np.ndarray, y: np.ndarray) -> tuple[float | None, float | None]:
        n = len(x)
        if n < 5 or np.ptp(x) == 0:
            return None, None
        c = x - x.mean()
        h = 1 / n + c * c / (c @ c)
        hat = np.outer(c, c) / (c @ c) + 1 / n
        rng = np.random.default_rng(seed)
        ys = np.vstack([y, rng.permuted(np.tile(y, (rounds, 1)), axis=1)])
        ps = ys - (ys - ys @ hat) / (1 - h)
        a, b = ps - ps.mean(1, keepdims=True), ys - ys.mean(1, keepdims=True)
        with np.errstate(invalid="ignore", divide="ignore"):
            r = (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))
        own, rest = r[0], r[1:]
        more = {"greater": rest >= own - 1e-12, "less": rest <= own + 1e-12, "two-sided": np.abs(rest) >= abs(own) - 1e-12}[alternative]
        return float(own), float((1 + more.sum()) / (rounds + 1))

    def run(batches):
        for pdf in batches:
            done = [one(*(np.array([r[c] for r in rows], float) for c in "xy")) for rows in pdf["_r"]]
            yield pd.DataFrame({"cell": pdf["cell"], "statistic": [d[0] for d in done], "p": [d[1] for d in done]})

    kind = dict(pairs.dtypes)["cell"]
    # A row a cell, many to a batch.
    whole = F.when(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"), F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))
    records = pairs.groupBy("cell").agg(F.array_sort(F.collect_list(whole)).alias("_r"))
    return records.mapInPandas(run, f"cell {kind}, statistic double, p double")


def anomaly(value: str) -> Column:
    return F.col(value) - F.avg(value).over(Window.partitionBy("cell"))


#: Scores of deterministic pairs (cell, year, fc, obs) by cell; the pooled score is the mean over cells.
BY_CELL = {"pearson": (pearson, "r"), "spearman": (spearman, "rho"), "two_afc": (two_afc, "score"), "rmse": (rmse, "rmse")}
#: Scores of tercile pairs (cell, year, cat, p_*), pooled.
POOLED = {"rpss": (rpss, "rpss"), "groc": (groc, "groc"), "heidke": (heidke, "hss"), "reliability": (reliability, "reliability")}


def skill(pairs: DataFrame, names: list[str]) -> DataFrame:
    """metric, score of each name; MSSS is a ratio of means."""
    out = None
    for name in names:
        if name in BY_CELL:
            f, c = BY_CELL[name]
            one = f(pairs, ["cell"]).agg(F.avg(c).alias("score"))
        elif name == "msss":
            one = msss(pairs, ["cell"]).withColumnRenamed("msss", "score")
        elif name in POOLED:
            f, c = POOLED[name]
            one = f(pairs).withColumnRenamed(c, "score")
        else:
            raise KeyError(f"unknown metric {name!r}; there are {sorted([*BY_CELL, *POOLED, 'msss'])}")
        one = one.select(F.lit(name).alias("metric"), "score")
        out = one if out is None else out.unionAll(one)
    if out is None:
        raise ValueError("no metric")
    return out
