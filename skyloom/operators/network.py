"""The master network of corridor nodes: its outer zone, edge costs, avoided edges, and candidate clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantiles import percentile
from .spatial import point_segment_distance


def outer_zone(nodes: DataFrame, ring: list[tuple[float, float]], roles: list[str], band: float, least: int = 3, key: str = "id") -> DataFrame:
    """Nodes (key, x, y, role) with boundary_m, radial (distance from the centre over the greatest) and is_outer.

    Outer is a node of an allowed role within `band` of the ring.  If fewer than `least` are, the `least` farthest of these roles are too.
    """
    away = F.least(*[point_segment_distance(F.col("x"), F.col("y"), *map(F.lit, (*a, *b))) for a, b in zip(ring, ring[1:] + ring[:1])])
    d = nodes.crossJoin(F.broadcast(nodes.agg(F.avg("x").alias("__cx"), F.avg("y").alias("__cy"))))  # one row
    d = d.withColumns({"boundary_m": away, "__r": F.hypot(F.col("x") - F.col("__cx"), F.col("y") - F.col("__cy")), "__ok": F.coalesce(F.col("role").isin(roles), F.lit(False))})
    near = F.col("__ok") & F.coalesce(F.col("boundary_m") <= band, F.lit(False))
    one = d.agg(F.greatest(F.max("__r"), F.lit(1.0)).alias("__top"), F.count_if(near).alias("__n"))
    far = d.where("__ok AND __r IS NOT NULL").orderBy(F.desc("__r"), key).limit(least).select(key, F.lit(True).alias("__far"))
    d = d.crossJoin(F.broadcast(one)).join(F.broadcast(far), key, "left")  # one row, and `least` rows
    flag = near | ((F.col("__n") < least) & F.coalesce("__far", F.lit(False)))
    return d.withColumns({"radial": F.col("__r") / F.col("__top"), "is_outer": flag}).drop("__cx", "__cy", "__r", "__ok", "__top", "__n", "__far")


def outer_edges(edges: DataFrame, outer: DataFrame, both: bool = False, key: str = "id") -> DataFrame:
    """Edges (u, v) with u_outer, v_outer and is_outer_edge: either end outer, or both ends; unknown nodes are inner."""
    flag = lambda end: outer.select(F.col(key).alias(end), F.col("is_outer").alias(f"{end}_outer"))
    d = edges.join(flag("u"), "u", "left").join(flag("v"), "v", "left").fillna(False, ["u_outer", "v_outer"])
    return d.withColumn("is_outer_edge", F.col("u_outer") & F.col("v_outer") if both else F.col("u_outer") | F.col("v_outer"))


def edge_costs(edges: DataFrame, weights: dict[str, float], clear_m: float = 600.0, floor: float = 0.05) -> DataFrame:
    """Edges (distance_m, density, clearance_m, support, is_tn, is_flz, is_outer_edge) with edge_cost, at least `floor`.

    Distance and density count over their 95th percentiles (1 at least); dense, supported and transfer edges are cheaper.
    """
    top = [percentile(edges, F.col(c), 0.95, f"__{c}") for c in ("distance_m", "density")]
    p = top[0].crossJoin(F.broadcast(top[1])).select(*[F.greatest(F.col(c), F.lit(1.0)).alias(c) for c in ("__distance_m", "__density")])  # one row
    flag = lambda c: F.col(c).cast("int").cast("double")
    w = lambda name: F.lit(float(weights.get(name, 0.0)))
    risk = 1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("clearance_m") / max(clear_m, 1.0)))
    cost = (w("distance") * F.col("distance_m") / F.col("__distance_m") - w("density") * F.col("density") / F.col("__density") + w("clearance") * risk
            - w("support") * F.col("support") - w("tn") * flag("is_tn") + w("flz") * flag("is_flz") + w("outer") * flag("is_outer_edge"))
    d = edges.crossJoin(F.broadcast(p)).withColumn("__raw", cost)  # one row
    return d.crossJoin(F.broadcast(d.agg(F.min("__raw").alias("__least")))).withColumn("edge_cost", F.col("__raw") - F.col("__least") + floor).drop("__raw", "__least", "__distance_m", "__density")  # one row


def avoided(edges: DataFrame, used_nodes: DataFrame, used_edges: DataFrame) -> DataFrame:
    """Edges (u, v) that touch a used node, and the used edges themselves, once each."""
    n = used_nodes.select(F.col("node").alias("__n")).distinct()
    touching = edges.select("u", "v").join(n, F.col("u") == F.col("__n"), "left_semi").union(edges.select("u", "v").join(n, F.col("v") == F.col("__n"), "left_semi"))
    return touching.union(used_edges.select("u", "v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def weighted_clusters(df: DataFrame, k: int, power: float = 1.0, seeds: int = 5, key: str = "id") -> DataFrame:
    """Weighted k-means of points (key, x, y, hits), weights 1 + hits^power: key, cluster, center_m.  The cheapest of some seeds wins.

    Rows without coordinates belong to no cluster.  Labels are arbitrary; `df` is read once per iteration, so give it materialised.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    d = df.where("x IS NOT NULL AND y IS NOT NULL").withColumn("__w", 1 + F.pow(F.greatest(F.coalesce("hits", F.lit(0)), F.lit(0)).cast("double"), power))
    v = VectorAssembler(inputCols=["x", "y"], outputCol="__v").transform(d)
    fits = [KMeans(k=k, seed=42 + i, weightCol="__w", featuresCol="__v", predictionCol="cluster").fit(v) for i in range(seeds)]
    best = min(fits, key=lambda m: m.summary.trainingCost)
    centres = F.array(*[F.struct(F.lit(float(c[0])).alias("x"), F.lit(float(c[1])).alias("y")) for c in best.clusterCenters()])
    out = best.transform(v).withColumn("__c", F.element_at(centres, F.col("cluster") + 1))
    return out.select(key, "cluster", F.hypot(F.col("x") - F.col("__c.x"), F.col("y") - F.col("__c.y")).alias("center_m"))
