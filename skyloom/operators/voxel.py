"""Heights and voxels: references, power lines, terrain filling, mosaics, density layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import percentile
from .spatial import overlap_join


def height_reference(source: Column, terrain: Column, mode: str = "AUTO", least_top: float = 100.0, least_above: float = 2.0, most_above: float = 400.0) -> Column:
    """struct<agl, is_msl_top> of a source height, either above ground (AGL) or the top's elevation (MSL_TOP).

    AUTO takes a value for an elevation only if it is at least `least_top` and a plausible height above the terrain.  Missing is 0; no height is below 0.
    """
    h, t = F.coalesce(source, F.lit(0.0)), F.coalesce(terrain, F.lit(0.0))
    top = {"AGL": F.lit(False), "MSL_TOP": F.lit(True), "AUTO": (h >= least_top) & (h > t) & (h - t).between(least_above, most_above)}[mode]
    return F.struct(F.greatest(F.lit(0.0), F.when(top, h - t).otherwise(h)).alias("agl"), top.alias("is_msl_top"))


def powerline_interval(kind: Column, terrain: Column, height: Column, line_buffer: float, pole_buffer: float) -> Column:
    """struct<base, top>: a cable is a band about its height, not below ground; a pole stands from the ground to above its height."""
    t, h = F.coalesce(terrain, F.lit(0.0)), F.greatest(F.lit(0.0), F.coalesce(height, F.lit(0.0)))
    line = F.struct(F.greatest(t, t + h - line_buffer).alias("base"), (t + h + line_buffer).alias("top"))
    return F.when(kind == "line", line).when(kind == "pole", F.struct(t.alias("base"), (t + h + pole_buffer).alias("top")))


def powerline_burn(voxels: DataFrame, features: DataFrame, terrain_tops: DataFrame, line_buffer: float, pole_buffer: float, key: str = "xy_id") -> DataFrame:
    """Voxels (key, iz, z_bot, z_top) that a feature (key, feature, kind, terrain, height) burns: lines, poles and features of each.

    A feature starts above the burned terrain of its column (key, terrain_top); touching faces do not burn.
    """
    f = features.withColumn("__i", powerline_interval(F.col("kind"), F.col("terrain"), F.col("height"), line_buffer, pole_buffer)).where("__i IS NOT NULL")
    f = f.join(terrain_tops.select(key, "terrain_top"), key, "left").select(key, "feature", "kind", F.greatest("__i.base", "terrain_top").alias("base"), F.col("__i.top").alias("top"))
    hit = overlap_join(voxels.select(key, "iz", "z_bot", "z_top"), f.where("base < top"), key, "z_bot", "z_top", "base", "top")
    return hit.groupBy(key, "iz").agg(F.count_if(F.col("kind") == "line").alias("n_lines"), F.count_if(F.col("kind") == "pole").alias("n_poles"), F.count_distinct("feature").alias("n_features"))


def mosaic(tiles: DataFrame, order: str, value: str = "v") -> DataFrame:
    """Cells (ix, iy) of overlapping tiles: the valid value of the first tile wins; a cell without one stays null."""
    valid = F.when(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")), F.struct(F.col(order).alias("o"), F.col(value).alias("v")))
    return tiles.groupBy("ix", "iy").agg(F.min(valid).alias("__m")).select("ix", "iy", F.col("__m.v").alias(value))


def filled(df: DataFrame, sources: list[str], to: str, constant: float = 0.0) -> DataFrame:
    """`df` with `to`: the first source that is there, else the median of those found, else the constant; and `to`_source."""
    first = F.coalesce(*map(F.col, sources))
    name = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in sources])
    d = df.withColumn("__f", first)
    d = d.crossJoin(F.broadcast(percentile(d, F.col("__f"), 0.5, "__m")))  # one row
    kind = F.coalesce(name, F.when(F.col("__m").isNotNull(), F.lit("median")), F.lit("constant"))
    return d.withColumns({to: F.coalesce("__f", "__m", F.lit(constant)), f"{to}_source": kind}).drop("__f", "__m")


def combined(a: DataFrame, b: DataFrame, mode: str = "max", wa: float = 0.5, wb: float = 0.5, value: str = "v") -> DataFrame:
    """Two density layers (ix, iy, value), each over its maximum: their maximum, or their weighted mean or sum over its maximum; a cell missing from one counts 0 there."""
    def over_top(d: DataFrame, c: str) -> DataFrame:
        top = d.agg(F.max(c).alias("__t"))  # one row
        return d.crossJoin(F.broadcast(top)).withColumn(c, F.when(F.col("__t") > 0, F.col(c) / F.col("__t")).otherwise(F.col(c).cast("double"))).drop("__t")

    p, q = (over_top(d.select("ix", "iy", F.col(value).alias(c)), c) for d, c in ((a, "__p"), (b, "__q")))
    j = p.join(q, ["ix", "iy"], "full").fillna(0.0, ["__p", "__q"])
    how = {"max": F.greatest("__p", "__q"), "weighted_mean": wa * F.col("__p") + wb * F.col("__q"), "sum": F.col("__p") + F.col("__q")}[mode]
    d = j.select("ix", "iy", how.alias(value))
    return d if mode == "max" else over_top(d, value)
