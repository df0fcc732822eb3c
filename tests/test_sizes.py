"""Results on tables with many copies, and against the SQL on rows that the small tables lack."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from skyloom.operators import geometry, lanes, model, routes, spatial
from skyloom.plans import registry


def _against_sql(spark, folder, name, **tables):
    con = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    df = registry.QUERIES[name](spark, str(folder))
    cols = ", ".join(f'"{c}"' for c in df.columns)
    want = con.execute(f"select {cols} from ({registry.ORACLES[name]})").fetchall()
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want))
    return want


def test_buffer_around_copies(spark):
    """Ten billion pairs of a point and a ring, few of different ones."""
    p = spark.range(200_000).selectExpr("id", "CAST(id % 4 AS double) * 10 AS x", "0D AS y")
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((-2.0, -2.0), (2.0, -2.0), (2.0, 2.0), (-2.0, 2.0))])
    s = spark.range(50_000).select(ring.alias("ring"))
    got = model.in_buffer(p, s, 8.0).groupBy(F.col("id") % 4).count().collect()
    assert {tuple(r) for r in got} == {(0, 50_000), (1, 50_000)}


def test_coverage_of_copies(spark):
    """Ten billion pairs of a cell and a station; the heaviest of equal stations counts, null weights do not."""
    c = spark.range(200_000).selectExpr("id", "CAST(id % 3 AS double) * 30 AS x", "0D AS y").union(spark.sql("SELECT -1L, NULL, 0D"))
    s = spark.range(50_000).selectExpr("0D AS x", "0D AS y", "IF(id % 2 = 0, (id % 5) / 10D, NULL) AS weight", "IF(id % 3 = 0, 40D, 20D) AS reach")
    got = {(r.x, round(r.s, 9), r.n) for r in geometry.coverage(c, s).join(c, "id").groupBy("x").agg(F.max("support").alias("s"), F.count_distinct("support").alias("n")).collect()}
    assert got == {(0.0, 0.4, 1), (30.0, round(0.4 * math.exp(-30 / 40), 9), 1), (60.0, 0.0, 1), (None, 0.0, 1)}


def test_pair_names_of_long_numbers(spark, tmp_path):
    s = spark.createDataFrame([(7, 1), (86, 1), (999, 1), (1000, 1), (12345, 1), (5, 2)], "s_suppkey long, s_nationkey int")
    want = _against_sql(spark, tmp_path, "od_pairs", supplier=s)
    assert "DB007_DB123" in {r[2] for r in want}


def test_shares_of_three_digits(spark):
    d = spark.createDataFrame([(k, n) for n in [*range(1, 90), 400, 2000] for k in range(n + 1)], "k long, n long")
    got = d.select("k", "n", routes.three_digits(F.col("k"), F.col("n")).alias("t")).collect()
    assert all(r.t == "%.3f" % (r.k / r.n) for r in got)


def test_cluster_shares_against_sql(spark, tmp_path):
    rows = [(1, i % 3, 1 + (i > 0)) for i in range(16)] + [(2, i, 1 + (i > 2)) for i in range(80)] + [(3, None, 1), (3, 4, 2), (4, 1, 4)]
    want = _against_sql(spark, tmp_path, "route_clusters", lineitem=spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_suppkey long"))
    assert {"1:0.062;2:0.938", "1:0.037;2:0.963", "2:0.500;1:0.500"} == {r[-1] for r in want if r[-1]}


def test_forecast_at_halves(spark, tmp_path):
    """Prices whose risk lies on half a millionth."""
    d = spark.range(5_000).selectExpr("id AS l_orderkey", "1 AS l_linenumber", "1L AS l_partkey", "1L AS l_suppkey", "1D AS l_quantity", "(5000001 + 4 * id) / 100D AS l_extendedprice", "0D AS l_discount").union(
        spark.range(2_000).selectExpr("id", "2", "11L", "1L", "1D", "(2000002 + 4 * id) / 100D", "id / 100D"))
    _against_sql(spark, tmp_path, "forecast_index", lineitem=d)


def test_clearance_from_copies(spark):
    """Two billion pairs of a sample and a blocked point; ties go to the least site of a place too."""
    g = spark.range(2_500).selectExpr("id AS seg", "CAST(id AS double) / 100 AS x1", "5D AS y1", "CAST(id AS double) / 100 AS x2", "6D AS y2")
    b = spark.range(400_000).selectExpr("id", "CAST(id % 2 AS double) * 50 AS x", "0D AS y")
    got = {r.seg: r.clearance for r in model.clearances(g, b, 100.0).collect()}
    assert len(got) == 2_500 and all(math.isclose(v, math.hypot(min(k / 100, 50 - k / 100), 5.0)) for k, v in got.items())
    at = spatial.nearest(spark.sql("SELECT 1L AS id, 25D AS x, 0D AS y"), b.selectExpr("id + 7 AS site", "x", "y"), 100.0).collect()
    assert [(r.site, r.dist) for r in at] == [(7, 25.0)]


def test_shift_in_a_crowd(spark):
    """Forty million alternatives, all but those of a few candidates too near others."""
    n = spark.range(20_000).selectExpr("id", "CAST(id % 200 AS double) AS x", "CAST(id DIV 200 AS double) AS y", "1L AS hits", "true AS eligible", "IF(id % 10 = 0, 0D, 100D) AS clearance")
    n = n.union(spark.sql("SELECT 20000L, 260D, 50D, 1L, true, 100D"))
    c = n.where("id % 10 = 0 AND id < 20000").selectExpr("id * 7919 % 20011 AS place", "id")
    got = lanes.shifted(c, n, clear=50.0, reach=400.0, apart=15.0).groupBy("reason").agg(F.count("*").alias("n"), F.min("to").alias("to"), F.min("id").alias("id")).collect()
    assert {(r.reason, r.n) for r in got} == {("shifted", 1), ("too near others", 1_999)}
    assert [(r.to, r.id) for r in got if r.reason == "shifted"] == [(20_000, 0)]
