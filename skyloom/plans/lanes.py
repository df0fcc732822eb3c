"""Registered queries on lane rules and candidates, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lanes
from .registry import query
from .tables import POINTS, points, table


@query("""WITH n AS (SELECT c_custkey AS id, c_acctbal / 1000 AS s, c_nationkey <> 3 AS a, c_mktsegment = 'BUILDING' AS sp FROM customer), e AS (SELECT o_custkey AS u, o_orderkey % 1000 + 1 AS v FROM orders),
b AS (SELECT u, v FROM e WHERE u <> v UNION SELECT v, u FROM e WHERE u <> v), m AS (SELECT b.u, median(n.s) AS md FROM b JOIN n ON n.id = b.v WHERE n.a AND n.s > 0 AND n.s < 5 GROUP BY 1)
SELECT id, round(CASE WHEN a AND sp AND (s >= 5 OR s <= 0) THEN coalesce(md, 0.085) WHEN a AND s <= 0 THEN 0.085 ELSE s END, 6) AS effective FROM n LEFT JOIN m ON m.u = n.id""")
def effective_slowness(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 1000).alias("slowness"), (F.col("c_nationkey") != 3).alias("active"), (F.col("c_mktsegment") == "BUILDING").alias("special"))
    e = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("u"), (F.col("o_orderkey") % 1000 + 1).alias("v"))
    return lanes.effective_slowness(c, e, limit=5.0).select("id", F.round("effective", 6).alias("effective"))


def _nodes(spark, sf):
    return points(spark, sf).withColumns({"penalty": F.lit(1.0), "blocked": F.col("id") % 10 == 0, "allowed": F.col("id") % 7 == 0})


_NEAR = "least(coalesce((SELECT min(sqrt(pow(n.x - p.x, 2) + pow(n.y - p.y, 2))) FROM points p WHERE {}), 1e9))"


@query(f"""WITH {POINTS}, d AS (SELECT id, {_NEAR.format('p.label = 3')} AS near, {_NEAR.format('p.id IN (1, 2)')} AS ends FROM points n), h AS (SELECT *, near <= 60 AND ends > 80 AS changed FROM d)
SELECT id, changed, CASE WHEN changed THEN 5.0::DOUBLE ELSE 1.0::DOUBLE END AS penalty, id % 10 = 0 AND id NOT IN (1, 2) AS blocked FROM h""")
def overlap_penalty(spark, sf_dir):
    n = _nodes(spark, sf_dir)
    return lanes.overlap_control(n, n.where("label = 3"), n.where("id IN (1, 2)"), buffer=60.0, protect=80.0).select("id", "changed", "penalty", "blocked")


@query(f"""WITH {POINTS}, d AS (SELECT id, {_NEAR.format('p.label = 3')} AS near, {_NEAR.format('p.id IN (1, 2)')} AS ends FROM points n), h AS (SELECT *, near <= 60 AND ends > 80 AS changed FROM d)
SELECT id, changed, (id % 10 = 0 OR changed) AND id NOT IN (1, 2) AS blocked FROM h""")
def overlap_block(spark, sf_dir):
    n = _nodes(spark, sf_dir)
    return lanes.overlap_control(n, n.where("label = 3"), n.where("id IN (1, 2)"), buffer=60.0, protect=80.0, action="block").select("id", "changed", "blocked")


@query(f"""WITH {POINTS}, d AS (SELECT id, {_NEAR.format('p.label = 3')} AS near FROM points n)
SELECT id, round(near, 6) AS lane_distance, round(least(25.0, 1 + 1.5 * greatest(0, near - 20) / 50), 6) AS lane_penalty, near > 90 AND id % 7 <> 0 AS lane_blocked FROM d""")
def lane_preference(spark, sf_dir):
    n = _nodes(spark, sf_dir)
    d = lanes.lane_preference(n, n.where("label = 3"), 20.0, preferred=70.0, hard=90.0)
    return d.select("id", F.round("lane_distance", 6).alias("lane_distance"), F.round("lane_penalty", 6).alias("lane_penalty"), "lane_blocked")


def _hit(spark, sf):
    prefix = F.when(F.col("id") % 11 == 0, "DB").otherwise("N")
    return points(spark, sf).select("id", (F.col("id") % 23).alias("hits"), (F.col("id") % 5 * (F.col("label") % 4)).cast("long").alias("degree"), (F.col("id") % 7).alias("pairs"), (F.col("label") - 1).alias("cluster"), prefix.alias("label_prefix"))


@query(f"""WITH {POINTS}, n AS (SELECT id, id % 23 AS hits, id % 5 * (label % 4) AS degree, id % 7 AS pairs, label - 1 AS cluster, id % 11 = 0 AS db FROM points), v AS (SELECT * FROM n WHERE hits >= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY hits DESC, degree DESC, pairs DESC, id) AS k FROM (SELECT *, max(degree >= 2) OVER (PARTITION BY cluster) AS any_ FROM v WHERE cluster >= 0 AND NOT db) WHERE degree >= 2 OR NOT any_),
z AS (SELECT * FROM v WHERE cluster < 0 AND NOT db AND hits >= (SELECT quantile_cont(hits, 0.9) FROM v WHERE cluster < 0) ORDER BY hits DESC, degree DESC, pairs DESC, id LIMIT 20),
u AS (SELECT id, hits, degree, pairs, 'cluster_peak_hit_count' AS candidate_type FROM r WHERE k <= 2 UNION ALL SELECT id, hits, degree, pairs, 'isolated_high_hit_bottleneck' FROM z)
SELECT id, candidate_type, 'IP' || lpad(CAST(row_number() OVER (ORDER BY hits DESC, degree DESC, pairs DESC, id) AS VARCHAR), 3, '0') AS candidate_id FROM u""")
def peak_candidates(spark, sf_dir):
    return lanes.peak_candidates(_hit(spark, sf_dir), per_cluster=2).select("id", "candidate_type", "candidate_id")


@query()
def shifted_candidates(spark, sf_dir):
    n = points(spark, sf_dir).select("id", "x", "y", (F.col("id") % 23).alias("hits"), (F.col("id") % 3 != 0).alias("eligible"), (F.col("id") % 29 * 10.0).alias("clearance"))
    c = n.where("id % 41 = 0").select(F.col("id").alias("place"), "id")
    return lanes.shifted(c, n, clear=150.0, reach=150.0, apart=20.0)
