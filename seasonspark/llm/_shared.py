"""Reading tables and cutting lineage, shared by the corpus operators."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and the five ASCII control characters 9 to 13.
WHITE = " \t\n\u000b\f\r"
#: Where tables go when the session names no shared folder (tests on one machine).
LOCAL_SHARED = "file:///tmp/checkpoints/seasonspark"
#: Folders of this process's cut tables.
CUT: set[str] = set()
#: A key with more than 1 / HOT of all rows is hot, where there are more than FEW.
HOT, FEW = 2_000, 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on one machine a local one where that is unset."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not given and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (given or LOCAL_SHARED).rstrip("/")


def cut(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, so that a lost executor costs no recomputation of what lies before.

    The table goes when the application ends, or before that by discard().
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}"
    if folder not in CUT:
        CUT.add(folder)
        atexit.register(lambda: spark.sparkContext._jsc and remove(spark, folder))
    path = f"{folder}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables that cut() wrote, when nothing needs them any more."""
    for df in tables:
        for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if any(folder.rpartition(":")[2].lstrip("/") in name for folder in CUT):
                remove(df.sparkSession, name)


def join_uneven(rows: DataFrame, sizes: DataFrame, keys: list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with sizes, a row for each key with the number of its rows: no key of many rows lands in one task.

    A key with more than 1 / HOT of all rows is joined by a broadcast, HOT such
    keys at most, and the others as Spark plans it; up to FEW rows in all no key is worth
    that. Both sides are read more than once.
    """
    if total <= FEW:
        return rows.join(sizes, keys, how)
    hot = sizes.where(F.col(count) * HOT > total)
    rest = sizes.where(F.col(count) * HOT <= total)
    others = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest, keys, how)
    return rows.join(F.broadcast(hot), keys).unionByName(others)


def rows_of(df: DataFrame, **more: Column) -> DataFrame:
    """Each row as one struct, _row, beside the named expressions: no column of df can then clash with them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *[c.alias(n) for n, c in more.items()])


def lean(run):
    """Gives freed memory back when a task of an Arrow function ends: workers outlive tasks, and their idle memory adds up."""

    def held(batches: Iterator) -> Iterator:
        import ctypes
        import gc

        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
                ctypes.CDLL(None).malloc_trim(0)

    return held
