"""Analog years: by index, by field and by the evolution of a season."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def by_index(index: DataFrame, target: int, metric: str = "absolute") -> DataFrame:
    """year, score and rank of every other year by distance of its index to the target year's."""
    t = index.where(F.col("year") == target).agg(F.max("index").alias("t"))  # one row
    d = F.col("index") - F.col("t")
    score = {"absolute": F.abs(d), "squared": d * d, "signed": -d}[metric]
    return ranked(index.where(F.col("year") != target).join(F.broadcast(t)).select("year", score.alias("score")))


def ranked(scores: DataFrame) -> DataFrame:
    """Years by rising score; a row a year."""
    return scores.where("score IS NOT NULL").withColumn("rank", F.row_number().over(Window.orderBy("score", "year")))


def by_field(field: DataFrame, target: int, metric: str = "rmse", weight: Column | None = None) -> DataFrame:
    w = F.lit(1.0) if weight is None else weight
    t = field.where(F.col("year") == target).select("cell", F.col("value").alias("t"))
    pairs = field.where(F.col("year") != target).join(t, "cell").withColumn("w", w)
    d = F.col("value") - F.col("t")
    if metric == "rmse":
        score = F.sqrt(F.sum(F.col("w") * d * d) / F.sum("w"))
    elif metric == "mae":
        score = F.sum(F.col("w") * F.abs(d)) / F.sum("w")
    elif metric == "correlation":
        score = 1 - F.corr("value", "t")
    else:
        raise ValueError(f"unknown metric {metric!r}")
    return ranked(pairs.groupBy("year").agg(score.alias("score")))


def by_evolution(curves: DataFrame, target: int) -> DataFrame:
    """Sum of the ranks by correlation and by mean absolute difference with the target's curve."""
    t = curves.where((F.col("year") == target) & F.col("value").isNotNull()).select("step", F.col("value").alias("t"))
    s = curves.where(F.col("year") != target).join(t, "step").groupBy("year").agg(F.corr("value", "t").alias("r"), F.avg(F.abs(F.col("value") - F.col("t"))).alias("mad"), F.count("value").alias("n"), F.count("t").alias("m"))
    s = s.where("n = m AND n >= 2")
    score = F.row_number().over(Window.orderBy(F.col("r").desc(), "year")) + F.row_number().over(Window.orderBy("mad", "year"))
    return ranked(s.select("year", score.alias("score")))


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    """Years of both selections, ranked by their mean score."""
    j = a.select("year", F.col("score").alias("a")).join(b.select("year", F.col("score").alias("b")), "year")
    return ranked(j.select("year", ((F.col("a") + F.col("b")) / 2).alias("score")))


def weights(selection: DataFrame, scale: float) -> DataFrame:
    w = F.lit(scale) / (F.col("score") + scale)
    return selection.select("year", (w / F.sum(w).over(Window.partitionBy(F.lit(0)))).alias("weight"))


def ranked(scores: DataFrame) -> DataFrame:
    """year, score and rank from 1, by score and year; years without a score are left out."""
    return scores.where("score IS NOT NULL").select("year", "score", F.row_number().over(Window.orderBy("score", "year")).alias("rank"))


def top(selection: DataFrame, n: int) -> DataFrame:
    """The first n analogs; ValueError if there are fewer."""
    if n < 1 or n > selection.count():
        raise ValueError(f"{n} analogs of {selection.count()}")
    return selection.where(F.col("rank") <= n)


def from_years(spark: SparkSession, years: list[int], candidates: DataFrame | None = None) -> DataFrame:
    """The years in their order with a score of 0; other candidates without score and rank."""
    if not years or len(set(years)) < len(years):
        raise ValueError("years must be given once each")
    chosen = spark.createDataFrame([(y, 0.0, i + 1) for i, y in enumerate(years)], "year int, score double, rank int")
    if candidates is None:
        return chosen
    if chosen.join(candidates, "year", "left_anti").limit(1).count():
        raise ValueError("a year is not among the candidates")
    return candidates.select("year").distinct().join(chosen, "year", "left")


def where(rows: DataFrame, condition: Column, scores: DataFrame | None = None) -> DataFrame:
    """Years for which the condition holds (null: not), by score where there are scores, else by year; ValueError if there are none."""
    years = rows.where(F.coalesce(condition, F.lit(False))).select("year").distinct()
    if not years.limit(1).count():
        raise ValueError("no year fulfils the condition")
    held = years.join(scores.select("year", "score"), "year", "left") if scores is not None else years.withColumn("score", F.lit(0.0))
    return ranked(held.withColumn("score", F.coalesce("score", F.lit(float("inf")))))


def restricted(scores: DataFrame, candidates: DataFrame) -> DataFrame:
    """year and score: years that are no candidates lose their score; ValueError for a candidate without a row."""
    if candidates.join(scores, "year", "left_anti").limit(1).count():
        raise ValueError("unknown candidate years")
    return scores.join(candidates.select("year", F.lit(True).alias("_c")), "year", "left").select("year", F.when(F.col("_c"), F.col("score")).alias("score"))


def either(a: DataFrame, b: DataFrame) -> DataFrame:
    """The years of a in their order, then the new ones of b in theirs, with the mean score of those that have one."""
    rows = a.select("year", "score", F.lit(0).alias("_s"), "rank").unionByName(b.select("year", "score", F.lit(1).alias("_s"), "rank"))
    first = rows.groupBy("year").agg(F.min(F.struct("_s", "rank")).alias("_o"), F.avg("score").alias("score"))
    return first.select("year", "score", F.row_number().over(Window.orderBy("_o")).alias("rank"))


def kept(selection: DataFrame, mask: DataFrame) -> DataFrame:
    """The analogs whose year the mask (year, keep) keeps, in their order."""
    left = selection.join(mask.where("keep").select("year"), "year", "left_semi")
    return left.select("year", "score", F.row_number().over(Window.orderBy("rank")).alias("rank"))


def exactly_one(**given) -> str:
    """The name of the one argument that is given; ValueError for none or more."""
    found = [k for k, v in given.items() if v is not None]
    if len(found) != 1:
        raise ValueError(f"give exactly one of {sorted(given)}")
    return found[0]


def ordinal_rank(rows: DataFrame, keys: list[str], value: str, position: str) -> DataFrame:
    """Adds rank, from 0, by value and position within the keys."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(value, position)) - 1)
