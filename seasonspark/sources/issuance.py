"""Store of issued forecasts as Parquet, partitioned by country, issuance and method, with scores beside it.

Work that is left is the store less what is scored, an anti join over partition columns and dates, so that a rerun does nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["country", "issuance", "method", "target_dekad"]
SCORES = "country string, issuance date, method string, target_dekad date, acc double, rmse double, bias double"


def write(forecasts: DataFrame, root: str) -> None:
    """Replaces the partitions that the rows belong to, and no others. forecasts: the keys, cell, mean and any more columns."""
    rows = forecasts.repartition("country", "issuance", "method")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("country", "issuance", "method").parquet(root)


def read(spark: SparkSession, root: str) -> DataFrame:
    t = spark.read.parquet(root)
    return t.withColumns({"country": F.col("country").cast("string"), "issuance": F.col("issuance").cast("date"), "method": F.col("method").cast("string")})


def scored(spark: SparkSession, path: str) -> DataFrame:
    """Scores so far; empty where there are none yet."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(SCORES).json(path) if there else spark.createDataFrame([], SCORES)


def pending(store: DataFrame, done: DataFrame) -> DataFrame:
    """Keys in the store that are not scored, each once."""
    return store.select(*KEYS).distinct().join(done.select(*KEYS), KEYS, "left_anti")


def score_pending(store: DataFrame, obs: DataFrame, climatology: DataFrame, done: DataFrame) -> DataFrame:
    """Scores of pending fields that have observations. obs: country, target_dekad, cell, obs; climatology: country, target_dekad, cell, clim."""
    from seasonspark.operators.metrics import score_pair

    left = store.join(pending(store, done), KEYS, "left_semi")
    rows = left.join(obs, ["country", "target_dekad", "cell"]).join(climatology, ["country", "target_dekad", "cell"])
    return score_pair(rows.withColumnRenamed("mean", "pred"), KEYS)


def append(scores: DataFrame, path: str) -> None:
    scores.select(*[c.split()[0] for c in SCORES.split(", ")]).write.mode("append").json(path)
