"""Lane rules on nodes (travel slowness, overlap, nearness to a main lane) and the choice and shift of candidate nodes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clean
from . import model, selection, spatial
from .graph import cut
from .quantiles import percentile


def effective_slowness(nodes: DataFrame, edges: DataFrame, limit: float = 10.0, fallback: float = 0.085) -> DataFrame:
    """`nodes` (id, slowness, active, special) with `effective`, the slowness to travel by.

    Special active nodes (facilities, ends) that are slow as a no-fly node, or not above 0, take the median of their flyable active
    neighbours over undirected edges (u, v), or the fallback.  A slowness that is missing or not finite counts as the fallback; so does
    one of any other active node that is not above 0.
    """
    s = F.when(F.abs(clean(F.col("slowness"))) < float("inf"), F.col("slowness")).otherwise(fallback)
    n = nodes.withColumn("__s", s.cast("double"))
    forced = F.col("active") & F.col("special") & ((F.col("__s") >= limit) | (F.col("__s") <= 0))
    both = edges.select("u", "v").union(edges.select("v", "u")).where("u <> v").distinct()
    flyable = n.where(F.col("active") & (F.col("__s") > 0) & (F.col("__s") < limit)).select(F.col("id").alias("v"), "__s")
    near = both.join(n.where(forced).select(F.col("id").alias("u")), "u", "left_semi").join(flyable, "v").groupBy(F.col("u").alias("id")).agg(F.percentile("__s", 0.5).alias("__m"))
    effective = F.when(forced, F.coalesce("__m", F.lit(fallback))).when(F.col("active") & (F.col("__s") <= 0), fallback).otherwise(F.col("__s"))
    return n.join(near, "id", "left").withColumn("effective", effective).drop("__s", "__m")


def overlap_control(nodes: DataFrame, path: DataFrame, ends: DataFrame, buffer: float = 150.0, protect: float = 150.0, action: str = "penalty", factor: float = 5.0, most: float = 1e6) -> DataFrame:
    """`nodes` (id, x, y, penalty, blocked) after a path (id, x, y) was taken between `ends` (id, x, y), with `changed`.

    Nodes within `buffer` of a path node, but not within `protect` of an end, get their penalty times `factor` (`most` at most) or are
    blocked; ends are never blocked.
    """
    if action not in ("penalty", "block", "none"):
        raise ValueError(f"unknown action {action}")
    if action == "none" or buffer <= 0:
        return nodes.withColumn("changed", F.lit(False))
    near = model.near_path(nodes, path, buffer)
    spared = ends.select("id") if protect <= 0 else model.near_path(nodes, ends, protect)
    hit = near.join(spared, "id", "left_anti").withColumn("__hit", F.lit(True))
    end = ends.select("id").distinct().withColumn("__end", F.lit(True))
    d = nodes.join(hit, "id", "left").join(end, "id", "left").withColumn("changed", F.coalesce("__hit", F.lit(False)))
    if action == "penalty":
        d = d.withColumn("penalty", F.when(F.col("changed"), F.least(F.col("penalty") * factor, F.lit(most))).otherwise(F.col("penalty")))
    else:
        d = d.withColumn("blocked", F.col("blocked") | F.col("changed"))
    return d.withColumn("blocked", F.col("blocked") & F.col("__end").isNull()).drop("__hit", "__end")


def lane_preference(nodes: DataFrame, path: DataFrame, buffer: float, preferred: float | None = None, weight: float = 1.5, most: float = 25.0, hard: float | None = None) -> DataFrame:
    """`nodes` (id, x, y, allowed) with their distance to the main lane's nearest node (id, x, y), the lane penalty and `lane_blocked`.

    The penalty grows with the distance beyond `buffer`, by `weight` per span to `preferred`; nodes beyond `hard` are blocked unless
    allowed.  Without a main lane distances are infinite, penalties one and nothing is blocked.
    """
    if not path.limit(1).count():
        return nodes.withColumns({"lane_distance": F.lit(float("inf")), "lane_penalty": F.lit(1.0), "lane_blocked": F.lit(False)})
    far = max(max(buffer * 2.5, buffer + 150.0) if preferred is None else preferred, buffer + 1.0)
    near = spatial.nearest_of_few(nodes.select("id", "x", "y"), path.select(F.col("id").alias("site"), "x", "y"), reach=buffer).select("id", F.col("dist").alias("lane_distance"))
    d = nodes.join(near, "id", "left").withColumn("lane_distance", F.coalesce("lane_distance", F.lit(float("inf"))))
    top = max(1.0, most)
    excess = F.greatest(F.lit(0.0), F.col("lane_distance") - buffer) / max(far - buffer, 1.0)
    block = (F.col("lane_distance") > hard) & ~F.col("allowed") if hard is not None and hard > 0 else F.lit(False)
    return d.withColumns({"lane_penalty": F.least(1.0 + max(0.0, weight) * excess, F.lit(top)), "lane_blocked": block})


def lane_spread(preference: DataFrame, path: DataFrame) -> DataFrame:
    """One row: mean and greatest finite distance of a path's (id) nodes to the main lane."""
    d = path.select("id").join(preference.select("id", "lane_distance"), "id").where(F.col("lane_distance") < float("inf"))
    return d.agg(F.avg("lane_distance").alias("mean"), F.max("lane_distance").alias("greatest"))


def peak_candidates(nodes: DataFrame, per_cluster: int = 1, least_hits: int = 2, least_degree: int = 2, prefixes: tuple = ("DB", "DK", "RA"), noise: float | None = 0.9, most_noise: int = 20) -> DataFrame:
    """The most hit nodes (id, hits, degree, pairs, cluster, label_prefix) of each cluster, and of the rest (cluster below 0) those hit
    as often as the percentile `noise` at least, with candidate_id and candidate_type.

    A cluster without a node of `least_degree` gives its strongest of any degree.  Ties go to the smaller id.
    """
    order = [F.col(c).desc() for c in ("hits", "degree", "pairs")] + [F.col("id")]
    hit = nodes.where(F.col("hits") >= least_hits)
    strong = F.col("degree") >= least_degree
    inside = model.excluded(hit.where("cluster >= 0"), list(prefixes)).withColumn("__strong", strong)
    w = Window.partitionBy("cluster").orderBy(F.col("__strong").desc(), *order)
    best = inside.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= per_cluster)  # per_cluster rows of each cluster go on
    best = best.withColumn("__top", F.max("__strong").over(Window.partitionBy("cluster"))).where("__strong = __top").drop("__strong", "__top", "__r")
    out = best.withColumn("candidate_type", F.lit("cluster_peak_hit_count"))
    if noise is not None:
        rest = hit.where("cluster < 0")
        bar = percentile(rest, F.col("hits"), noise, "__bar")
        top = model.excluded(rest.crossJoin(F.broadcast(bar)).where("hits >= __bar").drop("__bar"), list(prefixes))  # one row
        out = out.unionByName(top.orderBy(*order).limit(most_noise).withColumn("candidate_type", F.lit("isolated_high_hit_bottleneck")))
    out = cut(out.dropDuplicates(["id"]))
    place = model.numbered(out.select((-F.col("hits")).alias("h"), (-F.col("degree")).alias("d"), (-F.col("pairs")).alias("k"), "id"), ["h", "d", "k", "id"], "__n").select("id", "__n")
    number = (F.col("__n") + 1).cast("string")
    return out.join(place, "id").withColumn("candidate_id", F.concat(F.lit("IP"), F.lpad(number, F.greatest(F.length(number), F.lit(3)), F.lit("0")))).drop("__n")


def shifted(candidates: DataFrame, nodes: DataFrame, clear: float = 150.0, reach: float = 600.0, apart: float = 300.0, hit_loss: float = 1.0, weights: tuple[float, float, float] = (1.0, 0.25, 0.2),
            must_clear: bool = True, most: int = 100_000) -> DataFrame:
    """Candidates (place, id) moved away from no-fly nodes, in the order of `place`: place, id, to, distance, clearance_before,
    clearance, n_alternatives, score, reason.

    `nodes`: id, x, y, hits, eligible, clearance (metres to the nearest no-fly node; infinite if there is none).  A candidate
    nearer than `clear` moves to the eligible node within `reach` with the best sum of clearance, hits and (negative) distance, each
    times its weight, ties to the smaller id.  It must have a clearance of `clear` (or only a better one), keep hits, and be `apart` from
    all other candidates, moved or not.  The joins are distributed, and so is most of the choice: nodes too near a candidate that stays, or
    one that comes later and is where it was, fall out before they meet candidates.  What is left hangs on the moves before, so it streams
    sorted through one task, which holds the alternatives of one candidate and the places of those that may move, `most` at most (more raise an error).
    """
    at = cut(candidates.select("place", "id").join(nodes.select("id", "x", "y", "hits", "clearance"), "id"))
    total = at.limit(most + 1).count()
    if total > most:
        raise ValueError(f"more than {most} candidates")
    close = at.where(F.col("clearance") < clear).select("place", F.col("id").alias("c"), "x", "y", F.col("hits").alias("h0"), F.col("clearance").alias("clearance0"))
    fit = nodes.where("eligible").select(F.col("id").alias("to"), F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("hits").alias("h"), F.col("clearance").alias("cl"))
    good = F.col("cl") >= clear if must_clear else F.col("cl") > F.col("clearance0")
    met = spatial.radius_join(close, fit, reach).where("to <> c").withColumn("good", good)
    any_ = cut(met.groupBy("place", "c").agg(F.max("good").alias("good")))
    free = met.where("good")
    if apart > 0 and total > 1:
        moves = any_.select("place", F.col("c").alias("id"), F.col("good").alias("moves"))
        around = at.join(moves, ["place", "id"], "left").select(F.struct("place", "id").alias("who"), F.coalesce("moves", F.lit(False)).alias("moves"), F.col("x").alias("ox"), F.col("y").alias("oy"))
        held = spatial.radius_join(fit, around, apart * (1 + 1e-9), "rx", "ry", "ox", "oy").where(F.hypot(F.col("rx") - F.col("ox"), F.col("ry") - F.col("oy")) < apart)
        held = held.groupBy("to", "rx", "ry").agg(F.min("moves").alias("moves"), F.max("who").alias("last"))
        clear_of = fit.join(held, ["to", "rx", "ry"], "left").where("moves IS NULL OR moves").drop("moves")
        free = spatial.radius_join(close, clear_of, reach).where("to <> c").where(good).where(F.col("last").isNull() | (F.col("last") <= F.struct("place", F.col("c").alias("id")))).drop("last")
    free = cut(free)
    movers = free.select("place", F.col("c").alias("id")).distinct()
    may = any_.where("good").select("place", F.col("c").alias("id"))  # those without a free node too: they stand in the way of later ones
    spots = [tuple(r) for r in at.join(may, ["place", "id"]).select("place", "id", "x", "y").orderBy("place", "id").collect()]
    fixed = movers.select("place", F.col("id").alias("c"), F.lit(True).alias("streams"))
    none = F.when(F.col("good").isNull(), "none in reach").when(~F.col("good"), "none clear enough").when(F.col("streams").isNull(), "too near others")
    kept = at.withColumnRenamed("id", "c").join(any_, ["place", "c"], "left").join(fixed, ["place", "c"], "left").select(
        "place", F.col("c").alias("id"), F.col("c").alias("to"), F.lit(0.0).alias("distance"), F.col("clearance").alias("clearance_before"), "clearance", F.lit(0).cast("long").alias("n_alternatives"),
        F.lit(None).cast("double").alias("score"), F.when(F.col("clearance") >= clear, "clear").otherwise(none).alias("reason"))
    names = kept.columns
    loss, (wc, wh, wd) = max(0.0, min(1.0, hit_loss)), weights

    def move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        xy = np.array([s[2:] for s in spots], float).reshape(-1, 2)  # moves as candidates do
        index = {s[:2]: i for i, s in enumerate(spots)}

        def one(g: pd.DataFrame) -> tuple:
            r = g.iloc[0]
            me = index[r["place"], r["c"]]
            stay = (r["place"], r["c"], r["c"], 0.0, r["clearance0"], r["clearance0"], 0, None)
            x, y = g["rx"].to_numpy(), g["ry"].to_numpy()
            if apart > 0 and me:  # candidates that come later have been looked at
                others = xy[:me]
                others = others[(others[:, 0] > x.min() - apart) & (others[:, 0] < x.max() + apart) & (others[:, 1] > y.min() - apart) & (others[:, 1] < y.max() + apart)]
                g = g[[not len(others) or np.hypot(others[:, 0] - a, others[:, 1] - b).min() >= apart for a, b in zip(x, y)]]
                if not len(g):
                    return (*stay, "too near others")
            g = g[g["h"] >= r["h0"] * (1.0 - loss)]
            if not len(g):
                return (*stay, "too few hits")
            cl = np.minimum(g["cl"].to_numpy() / max(clear, 1.0), 2.0) / 2.0
            h = g["h"].to_numpy(float) / max(float(g["h"].max()), float(r["h0"]), 1.0)
            score = wc * cl + wh * h - wd * g["dist"].to_numpy() / max(reach, 1.0)
            b = g.iloc[int(score.argmax())]
            xy[me] = b["rx"], b["ry"]
            return (r["place"], r["c"], b["to"], b["dist"], r["clearance0"], b["cl"], len(g), float(score.max()), "shifted")

        def of(whole: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([one(g) for _, g in whole.groupby(["place", "c"], sort=True)], columns=names)

        held = None
        for pdf in batches:
            if not len(pdf):
                continue
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            last = (pdf["place"] == pdf["place"].iloc[-1]) & (pdf["c"] == pdf["c"].iloc[-1])
            if not last.all():
                yield of(pdf[~last])
            held = pdf[last]
        if held is not None:
            yield of(held)

    stream = free.coalesce(1).sortWithinPartitions("place", "c", "to")
    return kept.where("reason IS NOT NULL").unionByName(stream.mapInPandas(move, kept.schema))
