"""Exact dedup by content sort, in DataFrame operations only.

Sampled splitters range-partition the rows on the leading characters of the
normalised text and a salt; texts are normalised as a whole once, after that,
and the external sort of the following window, by digest and normalised text,
places equal texts side by side and compares neighbours in full. The salt splits
a beginning or a text that a large share of the rows holds over many partitions;
each salted run is reduced to one row before the runs of a text meet by digest.

Defined cases: a null text is the empty text and all empty texts are one group;
of equal texts the row with most code points stays, then the smallest id, null
ids last; of rows that repeat id and text one is kept; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import WHITE, cut, join_uneven, rows_of, table

#: Pieces into which the rows of one text are dealt.
SALTS = 4_096
#: Leading characters that the splitters hold, and how much of a text is looked at for them first.
LEAD, AHEAD = 24, 256


def normalised(text: str | F.Column) -> F.Column:
    out = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    for c in WHITE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def exact_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    return marked_classes(docs, id_col, text_col).drop("_mark")


def marked_classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """exact_classes() with _mark, a hash of the row's original text."""
    begun = normalised(F.substring(text_col, 1, AHEAD))
    lead = F.when(F.length(begun) >= LEAD, F.substring(begun, 1, LEAD)).otherwise(F.substring(normalised(text_col), 1, LEAD))
    salt = F.pmod(F.xxhash64(id_col, F.length(text_col)), F.lit(SALTS)).cast("int")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), lead.alias("_lead"), salt.alias("_salt")).repartitionByRange("_lead", "_salt")
    rows = rows.select("doc_id", "_lead", "_salt", F.length(F.coalesce("_text", F.lit(""))).alias("_len"), F.xxhash64("_text").alias("_mark"), normalised("_text").alias("_norm"))
    rows = rows.withColumn("text_sha256", F.sha2("_norm", 256))
    best = [F.col("_len").desc(), F.col("doc_id").asc_nulls_last()]
    run = Window.partitionBy("_lead", "_salt", "text_sha256", "_norm")
    runs = rows.select(
        "doc_id", "_len", "_mark", "text_sha256", "_salt",
        F.row_number().over(run.orderBy(*best)).alias("_at"),
        F.count(F.lit(1)).over(run).alias("_n"),
    )
    runs = cut(runs, "content-sort")
    # Winners of runs meet in partial aggregates; a text of many rows gets its group's row by a broadcast.
    first = F.struct((-F.col("_len")).alias("_l"), F.col("doc_id").isNull().alias("_none"), "doc_id", "_salt")
    groups = cut(runs.where("_at = 1").groupBy("text_sha256").agg(F.min(first).alias("_w"), F.sum("_n").alias("group_size")), "content-groups")
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    won = (F.col("_at") == 1) & (F.col("_w._salt") == F.col("_salt")) & (F.col("_w._l") == -F.col("_len")) & F.col("_w.doc_id").eqNullSafe(F.col("doc_id"))
    return join_uneven(runs, groups, ["text_sha256"], "group_size", total).select(
        "doc_id", F.col("_w.doc_id").alias("keep_id"), "group_size", won.alias("kept"), "text_sha256", "_mark",
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    rows = rows_of(docs, _id=F.col(id_col), _own=F.xxhash64(text_col))
    kept = marked_classes(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias("_keep"), F.col("_mark"))
    joined = rows.join(kept, F.col("_id").eqNullSafe(F.col("_keep")) & (F.col("_own") == F.col("_mark")))
    once = Window.partitionBy("_keep", "_mark").orderBy("_own")
    return joined.withColumn("_at", F.row_number().over(once)).where("_at = 1").select("_row.*")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_classes(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), r AS (
  SELECT *, row_number() OVER w AS nth, first_value(doc_id) OVER w AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id ASC NULLS LAST)
)
SELECT doc_id, keep_id, group_size, nth = 1 AS kept, text_sha256 FROM r
"""
