"""Grids, stencils and voxel columns as joins on integer cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .quantiles import percentile


def regular(spark: SparkSession, nx: int, ny: int, step: float = 1.0) -> DataFrame:
    """nx * ny nodes, row by row."""
    return spark.range(nx * ny).select(F.col("id").alias("node_id"), (F.col("id") % nx).alias("ix"), F.floor(F.col("id") / nx).alias("iy")).withColumns({"x": F.col("ix") * step, "y": F.col("iy") * step})


def voxels(xy: DataFrame, levels: list[float]) -> DataFrame:
    """Every xy row at every level (`iz`, `z`)."""
    return xy.select("*", F.posexplode(F.array(*map(F.lit, levels))).alias("iz", "z"))


def cell_counts(df: DataFrame, x: Column, y: Column, size: float) -> DataFrame:
    return df.groupBy(F.floor(x / size).cast("long").alias("ix"), F.floor(y / size).cast("long").alias("iy")).agg(F.count("*").alias("n"))


def stencil(df: DataFrame, value: str, size: int = 3, clamp: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(ix, iy, v, w): each cell with the values around it.  With `clamp` (x0, x1, y0, y1) edges repeat; without, missing cells are absent."""
    h = size // 2
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-h, h + 1) for j in range(-h, h + 1)])
    c = df.select("ix", "iy", F.col(value).alias("v")).withColumn("__o", F.explode(offsets))
    tx, ty = F.col("ix") + F.col("__o.i"), F.col("iy") + F.col("__o.j")
    if clamp:
        x0, x1, y0, y1 = clamp
        tx, ty = F.least(F.lit(x1), F.greatest(F.lit(x0), tx)), F.least(F.lit(y1), F.greatest(F.lit(y0), ty))
    c = c.select("ix", "iy", "v", tx.alias("__tx"), ty.alias("__ty"))
    return c.join(df.select(F.col("ix").alias("__tx"), F.col("iy").alias("__ty"), F.col(value).alias("w")), ["__tx", "__ty"]).drop("__tx", "__ty")


def terrain(df: DataFrame, value: str, size: int = 3, clamp: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Moving mean, range, position index (value - mean) and ruggedness sqrt(mean (w - v)^2), the centre included."""
    g = stencil(df, value, size, clamp).groupBy("ix", "iy", "v").agg(F.avg("w").alias("mean"), (F.max("w") - F.min("w")).alias("relief"), F.sqrt(F.avg(F.pow(F.col("w") - F.col("v"), 2))).alias("tri"))
    return g.select("ix", "iy", F.col("v").alias(value), "mean", "relief", (F.col("v") - F.col("mean")).alias("tpi"), "tri")


def slope(df: DataFrame, value: str, step: float = 1.0) -> DataFrame:
    """Central differences inside, one-sided at edges; slope in degrees and aspect in degrees clockwise from north."""
    def gradient(along: str, across: str) -> Column:
        w = Window.partitionBy(across).orderBy(along)
        a, b, v = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
        return F.when(a.isNotNull() & b.isNotNull(), (b - a) / (2 * step)).when(b.isNotNull(), (b - v) / step).when(a.isNotNull(), (v - a) / step).otherwise(0.0)

    d = df.withColumn("gx", gradient("ix", "iy")).withColumn("gy", gradient("iy", "ix"))
    return d.withColumns({"slope_deg": F.degrees(F.atan(F.hypot("gx", "gy"))), "aspect_deg": (F.degrees(F.atan2(-F.col("gx"), -F.col("gy"))) + 360) % 360})


def blurred(df: DataFrame, value: str, sigma: float, truncate: float = 4.0) -> DataFrame:
    """Separable Gaussian over integer cells, zero outside: two explode-and-sum passes with map-side sums."""
    r = int(truncate * sigma + 0.5)
    import math
    k = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-r, r + 1)]
    kernel = F.array(*[F.struct(F.lit(i - r).alias("o"), F.lit(w / sum(k)).alias("w")) for i, w in enumerate(k)])
    out = df.select("ix", "iy", F.col(value).alias("v"))
    for axis in ("ix", "iy"):
        out = out.withColumn("__k", F.explode(kernel)).withColumns({axis: F.col(axis) + F.col("__k.o"), "v": F.col("v") * F.col("__k.w")}).groupBy("ix", "iy").agg(F.sum("v").alias("v"))
    return out.withColumnRenamed("v", value)


def spacing(df: DataFrame, column: str) -> DataFrame:
    """Median of positive differences of the sorted distinct values.

    The differences are taken inside ranges of the values, and across range borders from each range's least and greatest, so no task sorts all."""
    v = df.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL").distinct()
    r = v.repartitionByRange("v").withColumn("p", F.spark_partition_id())
    w = Window.partitionBy("p").orderBy("v")
    inner = r.withColumn("d", F.col("v") - F.lag("v").over(w)).where("d > 0").select("d")
    ends = r.groupBy("p").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    outer = ends.withColumn("d", F.col("lo") - F.lag("hi").over(Window.orderBy("lo"))).where("d > 0").select("d")  # a row per partition
    return percentile(inner.union(outer), F.col("d"), 0.5, "spacing")


def surface_stack(blocks: DataFrame, base: DataFrame, key: str, dz: float) -> DataFrame:
    """Blocks stacked on the base top of their column: rank in column and z."""
    w = Window.partitionBy(key).orderBy("block_id")
    return blocks.join(base.groupBy(key).agg(F.max("top").alias("base_top")), key, "left").withColumn("rank", F.row_number().over(w) - 1).withColumn("z", F.coalesce("base_top", F.lit(0.0)) + F.col("rank") * dz)
