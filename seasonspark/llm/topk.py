"""Exact top-k search by inner product with a three-phase uniform threshold.

A vector's components are cut into PARTS parts, whose partial products with a
query are the local scores that add up to its score. Phase one gathers local
lists: of all rows, each query's best local scores of every part, a bounded list
for each tile of rows; these few rows are resolved, and the k-th best score found
is the cutoff c. Phase two hands the cutoffs to all
rows and collects the entries that reach c / PARTS in some part, as every row
that reaches c must. Phase three adds up the parts so far seen with the most
that the missing ones can give, no more than c / PARTS and no more than the
product of their lengths, drops what stays below the cutoff, computes missing
parts for the entries that are left only, and ranks them exactly.

Queries are dealt to blocks and rows to tiles of a bounded number; each pair of
a block and a tile is one group of a single job, so that the work spreads over
any number of executors and nothing is collected or broadcast.

Defined cases: vectors that are null or empty, or hold null or non-finite
components, and null ids take no part; a finite component whose 1024-fold is no
64-bit integer, or a score that is none, raises an error; vectors of another
length than the query's are not among its candidates; rows that repeat an id are
all the query's own rows where it is theirs, else candidates each; ties go to the
smaller id; queries without candidates have no rows; other columns are not
read. Scores are 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import cut, table

PARTS = 4
#: Queries of a block and rows of a tile, about.
BLOCK, TILE = 4_096, 8_192
#: Scores that are held at once; it decides how many rows are scored together.
SCORES = 1 << 20
SCALE = 1024


def quantised(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and integer components of the vectors that take part."""
    x = F.col(vector_col)
    sound = x.isNotNull() & (F.size(x) > 0) & F.col(id_col).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    fits = F.forall(x, lambda c: F.abs(c.cast("double")) < float(2**62 // SCALE))
    ints = F.transform(x, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))
    return vectors.where(sound).select(F.col(id_col).cast("long").alias("vec_id"), F.when(fits, ints).otherwise(F.raise_error(F.lit("a component is beyond 64-bit integers"))).alias("v"))


def bounds(n: int) -> list[tuple[int, int]]:
    cuts = [n * i // PARTS for i in range(PARTS + 1)]
    return [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def exact(q, x):
    """Both in the cheapest numbers that hold their inner products: doubles, 64-bit integers or Python's."""
    import numpy as np

    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    kind = float if most < 2**52 else np.int64 if most < 2**62 else object
    return q.astype(kind), x.astype(kind)


def whole(scores):
    """Scores as 64-bit integers."""
    import numpy as np

    if scores.dtype == object and any(not -(2**63) <= s < 2**63 for s in scores.ravel()):
        raise OverflowError("a score is beyond 64-bit integers")
    return scores.astype(np.int64)


def by_length(table, vector: int) -> dict:
    """Of each length the rows of a table of id, vector and others: (ids, matrix, where)."""
    import numpy as np

    v = table.column(vector).combine_chunks()
    starts = v.offsets.to_numpy()
    width, flat, ids = np.diff(starts), v.values.to_numpy(), table.column(vector - 1).to_numpy()
    out = {}
    for n in np.unique(width).tolist():
        at = np.flatnonzero(width == n)
        out[n] = ids[at], flat[starts[at][:, None] + np.arange(n)], at
    return out


def chunks(queries, rows) -> Iterator:
    """Of two tables the parts that can be scored together: query ids, matrix and places, row ids and matrix."""
    held = by_length(queries, 3)
    for n, (ids, x, _) in by_length(rows, 3).items():
        if n in held:
            step = max(64, SCORES // len(held[n][0]))
            for lo in range(0, len(ids), step):
                yield *held[n], ids[lo : lo + step], x[lo : lo + step]


FOUND = "query_id bigint, vec_id bigint, score bigint"


def found_rows(q: list, x: list, s: list):
    import numpy as np
    import pyarrow as pa

    return pa.table({n: pa.array(np.concatenate([np.empty(0, np.int64), *c]), pa.int64()) for n, c in (("query_id", q), ("vec_id", x), ("score", s))})


def local_lists(k: int):
    """Phase one on a tile: the rows that are among the k best of some part for a query, resolved, and of these the k best of the tile."""

    def run(rows, queries):
        import numpy as np

        none, best = np.iinfo(np.int64).min, {}
        for qid, q, _, ids, x in chunks(queries, rows):
            q, x = exact(q, x)
            parts = [q[:, a:b] @ x[:, a:b].T for a, b in bounds(q.shape[1])]
            own = qid[:, None] == ids[None, :]
            score = whole(sum(parts))
            m = min(k, len(ids))
            seen = np.zeros(score.shape, bool)
            for p in parts:
                p = np.where(own, -np.inf, p.astype(float))
                np.put_along_axis(seen, np.argpartition(-p, m - 1, axis=1)[:, :m], True, axis=1)
            score = np.where(seen & ~own, score, none)
            top = np.argpartition(-score.astype(float), m - 1, axis=1)[:, :m]
            s, j = np.take_along_axis(score, top, 1), ids[top]
            if q.shape[1] in best:
                s, j = (np.concatenate([old, new], 1) for old, new in zip(best[q.shape[1]][1:], (s, j), strict=True))
                top = np.argpartition(-s.astype(float), min(k, s.shape[1]) - 1, axis=1)[:, :k]
                s, j = np.take_along_axis(s, top, 1), np.take_along_axis(j, top, 1)
            best[q.shape[1]] = qid, s, j
        held = [(np.repeat(qid, s.shape[1]), j.ravel(), s.ravel()) for qid, s, j in best.values()]
        return found_rows(*[[h[c][h[2] != none] for h in held] for c in range(3)])

    return run


def entries(rows, queries):
    """Phases two and three on a tile: resolved entries that reach their query's cutoff. queries end in the cutoff."""
    import numpy as np

    out: tuple[list, list, list] = ([], [], [])
    cutoff = queries.column(4).to_numpy()
    for qid, q, at, ids, x in chunks(queries, rows):
        q, x = exact(q, x)
        cuts, low = bounds(q.shape[1]), cutoff[at].astype(float)
        least = np.ceil(low / len(cuts) - 1e-3 - np.abs(low) * 1e-12)
        free = low <= np.iinfo(np.int64).min / 4  # too few rows so far: all are collected
        local, some = [], np.zeros((len(q), len(x)), bool)
        for a, b in cuts:
            p = q[:, a:b] @ x[:, a:b].T
            reach = (p >= least[:, None]) | free[:, None]
            local.append((p, reach))
            some |= reach
        some &= qid[:, None] != ids[None, :]
        i, j = np.nonzero(some)
        length = [(np.sqrt((q[:, a:b].astype(float) ** 2).sum(1)), np.sqrt((x[:, a:b].astype(float) ** 2).sum(1))) for a, b in cuts]
        got, seen, missing = np.zeros(len(i), q.dtype), [], np.zeros(len(i))
        for (p, reach), (lq, lx) in zip(local, length, strict=True):
            here = reach[i, j]
            got = got + np.where(here, p[i, j], 0)
            missing = missing + np.where(here, 0.0, np.minimum(least[i], lq[i] * lx[j] * (1 + 1e-9) + 1))
            seen.append(here)
        del local
        for part, (a, b) in enumerate(cuts):
            may = free[i] | (got.astype(float) + missing >= low[i] - 1e-3 - np.abs(low[i]) * 1e-9)
            i, j, got, missing, seen = i[may], j[may], got[may], missing[may], [s[may] for s in seen]
            lq, lx = length[part]
            todo = np.flatnonzero(~seen[part])
            for lo in range(0, len(todo), 65_536):
                t = todo[lo : lo + 65_536]
                got[t] += (q[i[t], a:b] * x[j[t], a:b]).sum(1)
            missing[todo] -= np.minimum(least[i[todo]], lq[i[todo]] * lx[j[todo]] * (1 + 1e-9) + 1)
        good = free[i] | (got.astype(float) >= low[i] - 1e-3 - np.abs(low[i]) * 1e-9)
        for to, c in zip(out, (qid[i[good]], ids[j[good]], whole(got[good])), strict=True):
            to.append(c)
    return found_rows(*out)


def tiled(rows: DataFrame, queries: DataFrame, blocks: int, tiles: int, of) -> DataFrame:
    """A function of each pair of a tile of rows and a block of queries."""
    every = [F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (blocks, tiles)]
    block = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(blocks)).cast("int")
    tile = F.pmod(F.xxhash64("vec_id", "v"), F.lit(tiles)).cast("int")
    left = rows.select(tile.alias("_t"), every[0].alias("_b"), "vec_id", "v").groupBy("_b", "_t")
    right = queries.select(block.alias("_b"), every[1].alias("_t"), "*").select("_b", "_t", "vec_id", "v", *queries.columns[2:])
    return left.cogroup(right.groupBy("_b", "_t")).applyInArrow(of, FOUND)


def rank() -> F.Column:
    return F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))


def cutoffs(rows: DataFrame, queries: DataFrame, k: int, blocks: int, tiles: int) -> DataFrame:
    """vec_id and cutoff of the queries, the k-th best score that the local lists of all rows hold; no row where they hold fewer."""
    lists = tiled(rows, queries, blocks, tiles, local_lists(k)).withColumn("_r", rank())
    return lists.where(F.col("_r") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("cutoff"))


def top_k(vectors: DataFrame, is_query: F.Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: of each row where is_query holds the k best others."""
    rows = quantised(vectors, id_col, vector_col)
    queries = cut(rows.where(is_query).distinct(), "queries")
    blocks, tiles = max(1, -(-queries.count() // BLOCK)), max(1, rows.count() // TILE)
    low = cutoffs(rows, queries, k, blocks, tiles)
    asked = queries.join(low, "vec_id", "left").select("vec_id", "v", F.coalesce("cutoff", F.lit(-(2**63))).alias("cutoff"))
    out = tiled(rows, cut(asked, "cutoffs"), blocks, tiles, entries).withColumn("rank", rank())
    return out.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP1_SQL = """
WITH e AS (
  SELECT vec_id, [CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT) FOR c IN embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
