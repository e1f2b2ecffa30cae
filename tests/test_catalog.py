"""Every registered core query against its SQL, by DuckDB, on the smallest tables."""

import glob
import os
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from seasonspark.operators import climate, metrics
from seasonspark.plans.catalog import FLAGSHIP, ORACLE_SQL, QUERIES, rounded

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(rows):
    def one(v):
        if isinstance(v, float):
            return "nan" if v != v else round(v, 5)
        return str(v) if not isinstance(v, (int, type(None))) else v

    return sorted((tuple(one(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    want = con.execute(ORACLE_SQL[name])
    cols = [c[0] for c in want.description]
    assert sorted(cols) == names
    order = [cols.index(n) for n in names]
    assert plain(df.select(*[f"`{n}`" for n in names]).collect()) == plain([[r[i] for i in order] for r in want.fetchall()])


def test_flagship_is_registered():
    assert FLAGSHIP in QUERIES


def test_rounding_is_that_of_sql(spark, con):
    """0.5203125 times a million is below a half in doubles; other ties of digits are above."""
    rng = np.random.default_rng(6)
    xs = [0.5203125, 0.5, 2.5e-6, -2.5e-6, -0.1234565, 1e305, -1e-9, *((rng.integers(-(10**8), 10**8, 2_000) * 10 + 5) / 1e7).tolist(), *rng.normal(size=500).tolist()]
    got = [x.v for x in spark.createDataFrame(list(enumerate(xs)), "i int, v double").select("i", rounded("v").alias("v")).orderBy("i").collect()]
    assert got == [con.execute("SELECT round(?::DOUBLE, 6) + 0.0", [x]).fetchone()[0] for x in xs]
    assert got[0] == 0.520312


def test_frequency_below_at_the_quantile_itself(spark):
    """Sample values that meet the quantile, in fractions, are below it or not as in SQL; records without values have no share."""
    rng = np.random.default_rng(7)
    clim, sample = [(-1, None), (-2, 1.0), (-2, None)], [(-1, 1.0), (-2, 1.0), (-2, 0.5)]
    for cell in range(400):
        fs = sorted(Fraction(int(rng.integers(60, 300)), int(rng.integers(5, 13))) for _ in range(7))
        clim += [(cell, float(f)) for f in fs]
        sample += [(cell, float((4 * fs[1] + fs[2]) / 5)), (cell, float(fs[3]))]
    own = duckdb.connect()
    for name, rows in (("c", clim), ("s", sample)):
        own.execute(f"CREATE TABLE {name} (cell BIGINT, value DOUBLE)")
        own.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
    want = own.execute("SELECT cell, avg((value < t)::INT) FROM s JOIN (SELECT cell, quantile_cont(value, 0.2) AS t FROM c GROUP BY 1) USING (cell) GROUP BY 1").fetchall()
    frames = [spark.createDataFrame(rows, "cell long, value double") for rows in (sample, clim)]
    got = climate.frequency_below(*frames, ["cell"], 0.2).collect()
    assert dict(want) == {x.cell: x.frequency for x in got}


def test_fdr_bh_of_copies(spark, tmp_path):
    """Copies of a cell have one p, so that they share a rank: as in the SQL with the order of its sums fixed, which it leaves to chance."""
    own = duckdb.connect()
    own.execute(f"CREATE TABLE lineitem AS SELECT * REPLACE (l_suppkey + 1000 * i AS l_suppkey) FROM '{SF}/lineitem.parquet', range(40) t(i) ORDER BY hash(l_orderkey, l_linenumber, i)")
    own.execute(f"COPY lineitem TO '{tmp_path}/lineitem.parquet'")
    sql = ORACLE_SQL["fdr_bh"].replace("avg(value) AS fc", "avg(value ORDER BY member) AS fc").replace("corr(fc, obs)", "corr(fc, obs ORDER BY year)")
    got = {x.cell: (x.p, x.q) for x in QUERIES["fdr_bh"](spark, str(tmp_path)).collect()}
    assert got == {c: (p, q) for c, p, q in own.execute(sql).fetchall()}
    assert all(got[c] == got[c % 1000] for c in got)


def test_pearson_in_order(spark):
    rows = [(1, 1, 1.0, 2.0), (2, 1, 0.1, 1.0), (2, 2, 0.1, 2.0), (2, 3, 0.1, 3.0), (3, 1, 1.0, 5.0), (3, 2, 2.0, 1.0), (3, 3, None, 9.0), (4, 1, None, 1.0)]
    got = {x.cell: x.r for x in metrics.pearson_in_order(spark.createDataFrame(rows, "cell int, year int, fc double, obs double"), ["cell"], "year").collect()}
    assert np.isnan(got[1]) and np.isnan(got[2]) and got[3] == pytest.approx(-1) and got[4] is None
