"""Ordered-sequence and hit-count operators over route tables (route, an order, node)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def steps(df: DataFrame, route: str, order: list[str], x: Column, y: Column, slowness: Column) -> DataFrame:
    """Segment and cumulative distance and time along each route; time is distance times the mean slowness of both ends."""
    w = Window.partitionBy(route).orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumns({"path_step": F.row_number().over(w) - 1, "segment_m": F.coalesce(F.hypot(x - F.lag(x).over(w), y - F.lag(y).over(w)), F.lit(0.0)), "__s": (slowness + F.coalesce(F.lag(slowness).over(w), slowness)) / 2})
    d = d.withColumn("segment_s", F.col("segment_m") * F.col("__s"))
    return d.withColumns({"distance_m": F.sum("segment_m").over(run), "time_s": F.sum("segment_s").over(run)}).drop("__s")


def edges(df: DataFrame, route: str, order: list[str], node: str) -> DataFrame:
    """Consecutive node pairs (route, edge_seq, from_node, to_node); self-loops dropped."""
    w = Window.partitionBy(route).orderBy(*order)
    e = df.select(route, F.col(node).alias("from_node"), F.lead(node).over(w).alias("to_node"), F.row_number().over(w).alias("edge_seq"))
    return e.where("to_node IS NOT NULL AND from_node <> to_node")


def node_hits(df: DataFrame, route: str, node: str, lists: dict[str, str] | None = None) -> DataFrame:
    """Distinct routes and visits per node, and sorted distinct values of some columns as `;` lists."""
    extra = [F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), ";").alias(a) for c, a in (lists or {}).items()]
    return df.groupBy(node).agg(F.count_distinct(route).alias("hit_count"), F.count("*").alias("visit_count"), *extra)


def edge_hits(edge_rows: DataFrame, route: str) -> DataFrame:
    """Distinct routes per undirected edge (u < v)."""
    e = edge_rows.select(route, F.least("from_node", "to_node").alias("u"), F.greatest("from_node", "to_node").alias("v"))
    return e.groupBy("u", "v").agg(F.count_distinct(route).alias("hit_count"), F.count("*").alias("visit_count"))


def degree(edge_rows: DataFrame) -> DataFrame:
    """Distinct neighbours of each node."""
    both = edge_rows.select(F.col("from_node").alias("node"), F.col("to_node").alias("other")).union(edge_rows.select(F.col("to_node").alias("node"), F.col("from_node").alias("other")))
    return both.groupBy("node").agg(F.count_distinct("other").alias("degree"))


def islands(df: DataFrame, key: str, order: list[str], starts: Column, name: str = "island") -> DataFrame:
    """Gap-and-island numbers: a row where `starts` is true opens a new island; the first row is in island 1."""
    w = Window.partitionBy(key).orderBy(*order)
    flag = F.when(F.row_number().over(w) == 1, 1).when(F.coalesce(starts, F.lit(False)), 1).otherwise(0)
    return df.withColumn("__f", flag).withColumn(name, F.sum("__f").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__f")


def turns(df: DataFrame, route: str, order: list[str], x: Column, y: Column, least: float = 1.0) -> DataFrame:
    """Turn count (above `least` degrees) and total turn angle per route."""
    w = Window.partitionBy(route).orderBy(*order)
    d = df.withColumn("__a", F.degrees(F.atan2(y - F.lag(y).over(w), x - F.lag(x).over(w)))).withColumn("__p", F.lag("__a").over(w))
    raw = F.abs(F.col("__a") - F.col("__p")) % 360
    turn = F.when(raw > 180, 360 - raw).otherwise(raw)
    return d.groupBy(route).agg(F.count_if(turn > least).alias("turn_count"), F.coalesce(F.sum(turn), F.lit(0.0)).alias("turn_degrees"))


def overlap_share(paths: DataFrame, locked: DataFrame, route: str, node: str) -> DataFrame:
    """Distinct nodes of each route that are locked: shared, total, percent."""
    p = paths.select(route, node).distinct().join(locked.select(F.col(node), F.lit(1).alias("__l")).distinct(), node, "left")
    return p.groupBy(route).agg(F.count("__l").alias("shared"), F.count("*").alias("total"), (100.0 * F.count("__l") / F.count("*")).alias("percent"))


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def three_digits(part: Column, whole: Column) -> Column:
    """part / whole (whole numbers, 0 <= part <= whole) to three digits as C's printf has it: by the value of the double, of two equally near the even one.

    Java rounds the shortest decimals that give the double, and halves up; the two differ only in halves of a thousandth, which are listed.
    """
    halves = F.array(*[F.lit("%.3f" % (k / 2000)) for k in range(1, 2000, 2)])
    n = 2000 * part
    half = (n % whole == 0) & (n / whole % 2 == 1)
    return F.when(half, F.get(halves, ((n / whole - 1) / 2).cast("int"))).otherwise(F.format_string("%.3f", part / whole))


def cluster_sequence(df: DataFrame, route: str, seq: str, cluster: str) -> DataFrame:
    """Per route the clusters it meets, ordered by their median place (cut to a whole number, missing ones last) and number: n_nodes, n_clusters, cluster_sequence, coverage_sequence.

    Nodes without a cluster (null or negative) count only as nodes; coverage is a cluster's share of the route's nodes, to three digits.
    """
    total = df.groupBy(route).agg(F.count("*").alias("n_nodes"))
    per = df.where(F.col(cluster) >= 0).groupBy(route, F.col(cluster).alias("__c")).agg(F.floor(F.percentile(seq, 0.5)).alias("__m"), F.count("*").alias("__k"))
    share = F.concat(F.col("__c").cast("string"), F.lit(":"), three_digits(F.col("__k"), F.col("n_nodes")))
    one = per.join(total, route).groupBy(route).agg(F.sort_array(F.collect_list(F.struct(F.isnull("__m"), "__m", "__c", share.alias("__s")))).alias("__l"))
    text = lambda f: F.coalesce(F.array_join(F.transform("__l", f), ";"), F.lit(""))
    return total.join(one, route, "left").select(route, "n_nodes", F.greatest(F.coalesce(F.size("__l"), F.lit(0)), F.lit(0)).alias("n_clusters"),
                                                 text(lambda s: s["__c"].cast("string")).alias("cluster_sequence"), text(lambda s: s["__s"]).alias("coverage_sequence"))


def simplified(df: DataFrame, route: str, order: list[str], x: Column, y: Column, least: float = 1.0) -> DataFrame:
    """`df` without the inner nodes at which the route turns by `least` degrees or less; ends and nodes that repeat their neighbour's place stay."""
    w = Window.partitionBy(route).orderBy(*order)
    d = df.withColumns({"__a": F.atan2(y - F.lag(y).over(w), x - F.lag(x).over(w)), "__b": F.atan2(F.lead(y).over(w) - y, F.lead(x).over(w) - x),
                        "__still": F.coalesce((x == F.lag(x).over(w)) & (y == F.lag(y).over(w)), F.lit(False)) | F.coalesce((x == F.lead(x).over(w)) & (y == F.lead(y).over(w)), F.lit(False))})
    raw = F.abs(F.degrees(F.col("__b") - F.col("__a"))) % 360
    turn = F.when(raw > 180, 360 - raw).otherwise(raw)
    return d.where(turn.isNull() | F.col("__still") | (turn > least)).drop("__a", "__b", "__still")
