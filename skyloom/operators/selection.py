"""Choosing nodes: candidate scores, top-k under separation, representatives, levels, samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def candidate_score(df: DataFrame, parts: dict[str, float], bonus: str | None = None, bonus_weight: float = 0.0) -> DataFrame:
    """`df` with `score`: the weighted sum of the columns over their maxima (1 at least), plus a bonus where the flag holds."""
    top = df.agg(*[F.greatest(F.coalesce(F.max(c), F.lit(0)), F.lit(1)).cast("double").alias(f"__{c}") for c in parts])
    score = sum((F.coalesce(F.col(c), F.lit(0)) / F.col(f"__{c}") * w for c, w in parts.items()), F.lit(0.0))
    if bonus is not None:
        score = score + F.when(F.col(bonus), bonus_weight).otherwise(0.0)
    return df.crossJoin(F.broadcast(top)).withColumn("score", score).drop(*[f"__{c}" for c in parts])  # one row


def separated(df: DataFrame, area: str, quota: int, apart: float, key: str = "id") -> DataFrame:
    """Per area the best `score` first, each at least `apart` from those taken before it, `quota` at most; adds `rank` from 1.

    Ties go to the smaller key.  Rows come sorted and stream through; a task holds only what it has taken (`quota` per area),
    so an area of any size fits, but is read by one task.
    """
    schema = df.schema
    ordered = df.repartition(F.col(area)).sortWithinPartitions(F.col(area), F.col("score").desc(), F.col(key))

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, xs, ys = None, [], []
        for pdf in batches:
            keep, rank = [], []
            for i, (a, x, y) in enumerate(zip(pdf[area], pdf["x"], pdf["y"])):
                if a != now:
                    now, xs, ys = a, [], []
                if len(xs) < quota and (not xs or np.hypot(np.array(xs) - x, np.array(ys) - y).min() >= apart):
                    xs.append(x), ys.append(y), keep.append(i), rank.append(len(xs))
            out = pdf.iloc[keep].copy()
            out["rank"] = rank
            yield out

    return ordered.mapInPandas(take, _with(schema, "rank", "int"))


def _with(schema, name: str, kind: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields] + [f"`{name}` {kind}"])


def representatives(df: DataFrame, cluster: str, key: str = "id") -> DataFrame:
    """Of each cluster the row with the most hits, then nearest its weighted centre, then the smallest key."""
    w = Window.partitionBy(cluster)
    weight = F.greatest(F.col("hits"), F.lit(1)).cast("double")
    centre = df.withColumn("__cx", F.sum(F.col("x") * weight).over(w) / F.sum(weight).over(w)).withColumn("__cy", F.sum(F.col("y") * weight).over(w) / F.sum(weight).over(w))
    far = F.round(F.hypot(F.col("x") - F.col("__cx"), F.col("y") - F.col("__cy")), 6)
    best = Window.partitionBy(cluster).orderBy(F.col("hits").desc(), far, F.col(key))
    return centre.withColumn("__rn", F.row_number().over(best)).where("__rn = 1").drop("__rn", "__cx", "__cy")


def nearest_level(df: DataFrame, levels: DataFrame, value: str = "z", level: str = "level") -> DataFrame:
    """`df` with the nearest of a few `levels` (checked to be 10 000 at most); the lower wins a tie."""
    n = levels.count()
    if n > 10_000:
        raise ValueError(f"{n} levels are not few")
    every = levels.agg(F.sort_array(F.collect_set(F.col(level).cast("double"))).alias("__levels"))
    near = F.array_min(F.transform("__levels", lambda v: F.struct(F.abs(v - F.col(value)).alias("d"), v.alias("v"))))
    return df.crossJoin(F.broadcast(every)).withColumn("nearest_level", near["v"]).drop("__levels")


def every_nth(df: DataFrame, n: int, order: list[str], special) -> DataFrame:
    """Every n-th ordinary row by xxhash64 of `order`, and all special rows."""
    flag = F.coalesce(special, F.lit(False))
    return df.where(flag | (F.pmod(F.xxhash64(*order), F.lit(n)) == 0))


def share_count(base: int, percent: float, least: int, most: int) -> int:
    """How many to choose: a percentage of `base`, rounded, within its bounds."""
    return max(least, min(most, round(base * percent / 100)))
