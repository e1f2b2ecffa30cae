"""Curves, diagrams and tables of scores, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seasonspark.operators import metrics
from seasonspark.operators.terciles import type7_boundaries

P = ("p_below", "p_normal", "p_above")


def by_category(pairs: DataFrame) -> DataFrame:
    """category, p and event of each category of each pair (cat, p_*)."""
    sides = [F.struct(F.lit(i).alias("category"), F.col(p).alias("p"), (F.col("cat") == i).alias("event")) for i, p in enumerate(P)]
    return pairs.select(F.explode(F.array(*sides)).alias("_s")).select("_s.*")


def histogram(pairs: DataFrame) -> DataFrame:
    hit = F.col("event").cast("long")
    return by_category(pairs).groupBy("category", "p").agg(F.sum(hit).alias("hit"), F.sum(1 - hit).alias("miss"))


def roc_curve(pairs: DataFrame) -> DataFrame:
    """category, p, tpr and fpr: a point for each probability that was issued, equal ones together."""
    hist = histogram(pairs)
    run = metrics.running(metrics.running(hist, "p", "miss", ["category"]).withColumnRenamed("under", "_m"), "p", "hit", ["category"]).withColumnRenamed("under", "_h")
    total = hist.groupBy("category").agg(F.sum("hit").alias("_hits"), F.sum("miss").alias("_misses"))
    j = run.join(F.broadcast(total), "category")  # three rows
    return j.select("category", "p", ((F.col("_hits") - F.col("_h")) / F.col("_hits")).alias("tpr"), ((F.col("_misses") - F.col("_m")) / F.col("_misses")).alias("fpr"))


def roc_areas(pairs: DataFrame) -> DataFrame:
    """category and area, ties half; a half where a category always or never occurs."""
    run = metrics.running(histogram(pairs), "p", "miss", ["category"])
    both = F.sum("hit") * F.sum("miss")
    area = F.sum(F.col("hit") * (F.col("under") + F.col("miss") / 2)) / F.when(both > 0, both)
    return run.groupBy("category").agg(F.coalesce(area, F.lit(0.5)).alias("area"))


def reliability(pairs: DataFrame, bins: int = 5) -> DataFrame:
    """category, bin, n, mean_p and freq."""
    rows = by_category(pairs)
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1))
    return rows.groupBy("category", b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg(F.col("event").cast("double")).alias("freq"))


def issuance_rpss(members: DataFrame, obs: DataFrame) -> DataFrame:
    """year and rpss of counted shares against a third each, boundaries of type 7; null where climatology is right throughout."""
    b = type7_boundaries(obs, ["cell"]).where("lo <> hi")
    p = members.join(b, "cell").groupBy("cell", "year").agg(F.avg((F.col("value") < F.col("lo")).cast("double")).alias("f1"), F.avg((F.col("value") <= F.col("hi")).cast("double")).alias("f2"))
    j = p.join(obs, ["cell", "year"]).join(b, "cell")
    o1, o2 = (F.col("value") < F.col("lo")).cast("double"), (F.col("value") <= F.col("hi")).cast("double")

    def distance(a, z):
        return F.avg((a - o1) * (a - o1) + (z - o2) * (z - o2))

    g = j.groupBy("year").agg(distance(F.col("f1"), F.col("f2")).alias("f"), distance(F.lit(1 / 3), F.lit(2 / 3)).alias("c"))
    return g.select("year", F.when(F.col("c") != 0, 1 - F.col("f") / F.col("c")).alias("rpss"))


def comparison(forecasts: DataFrame, obs: DataFrame, names: list[str]) -> DataFrame:
    """A row a model and a column a metric of metrics.BY_CELL, the mean over cells. forecasts: model, cell, year, value."""
    pairs = forecasts.withColumnRenamed("value", "fc").join(obs.withColumnRenamed("value", "obs"), ["cell", "year"])
    out = None
    for name in names:
        f, c = metrics.BY_CELL[name]
        one = f(pairs, ["model", "cell"]).groupBy("model").agg(F.avg(c).alias(name))
        out = one if out is None else out.join(one, "model", "full")
    return out


def member_skill(forecasts: DataFrame, obs: DataFrame, years: DataFrame, name: str = "pearson") -> DataFrame:
    """model and score on some years."""
    return comparison(forecasts.join(F.broadcast(years), "year", "left_semi"), obs, [name]).withColumnRenamed(name, "score")


def runs(rows: DataFrame, keys: list[str], order: str, condition: Column) -> DataFrame:
    """keys, first, last and n of each run of neighbouring rows for which the condition holds."""
    w = Window.partitionBy(*keys)
    held = F.coalesce(condition, F.lit(False))
    t = rows.select(*keys, F.col(order).alias("_o"), held.alias("_c"), F.row_number().over(w.orderBy(order)).alias("_i"))
    t = t.withColumn("_g", F.col("_i") - F.row_number().over(Window.partitionBy(*keys, "_c").orderBy("_o")))
    return t.where("_c").groupBy(*keys, "_g").agg(F.min("_o").alias("first"), F.max("_o").alias("last"), F.count(F.lit(1)).alias("n")).drop("_g")


#: What ensemble() may be told to guard, with its defaults.
SAFEGUARDS = {"min_effective": 0.0, "shrink": 0.0, "loyo": True}


def safeguards(given: dict | None) -> dict:
    out = SAFEGUARDS | (given or {})
    if unknown := set(out) - set(SAFEGUARDS):
        raise KeyError(f"unknown safeguards {sorted(unknown)}; there are {sorted(SAFEGUARDS)}")
    if out["min_effective"] < 0:
        raise ValueError("min_effective must not be negative")
    return out
