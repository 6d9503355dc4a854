"""Resampling as relations, for planes whose size is known only at run time."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from lumenframe.functions.planes import SUPPORT


def kernel(kind: str, x: Column) -> Column:
    d = F.abs(x)
    if kind == "box":
        return F.when((x > -0.5) & (x <= 0.5), 1.0).otherwise(0.0)
    if kind == "triangle":
        return F.greatest(F.lit(0.0), 1 - d)
    return F.when(d < 1, 1.5 * d * d * d - 2.5 * d * d + 1).when(d < 2, -0.5 * d * d * d + 2.5 * d * d - 4 * d + 2).otherwise(0.0)


def coefficients(spark: SparkSession, n_in: int, n_out: int, kind: str) -> DataFrame:
    """(o, i, w): each output index generates its own input range, so no range join is needed. Weights of one o sum to 1."""
    if n_in <= 0 or n_out <= 0:
        raise ValueError("sizes must be positive")
    scale = n_in / n_out
    wide = max(1.0, scale)
    reach = SUPPORT[kind] * wide
    o = spark.range(n_out).select(F.col("id").cast("int").alias("o"), ((F.col("id") + 0.5) * scale).alias("c"))
    low = F.greatest(F.lit(0), F.floor(F.col("c") - reach + 0.5)).cast("int")
    high = F.least(F.lit(n_in), F.floor(F.col("c") + reach + 0.5)).cast("int") - 1
    taps = o.select("o", "c", F.explode(F.sequence(low, high)).alias("i"))
    taps = taps.withColumn("k", kernel(kind, (F.col("i") - F.col("c") + 0.5) / wide))
    return taps.select("o", "i", (F.col("k") / F.sum("k").over(Window.partitionBy("o"))).alias("w"))


#: A coefficient table is broadcast up to so many rows; above, the join is left to the planner.
BROADCAST_TAPS = 1_000_000


def _small(df: DataFrame, n_in: int, n_out: int, kind: str) -> DataFrame:
    taps = n_out * (2 * math.ceil(SUPPORT[kind] * max(1.0, n_in / n_out)) + 1)
    return F.broadcast(df) if taps <= BROADCAST_TAPS else df


def resample_pixels(pixels: DataFrame, keys: list[str], size: tuple[int, int], to: tuple[int, int], kind: str) -> DataFrame:
    """(keys, x, y, v) of size (width, height) -> the same at size `to`; across first, then down, each one join and one sum with partial aggregation."""
    spark = pixels.sparkSession
    cx = _small(coefficients(spark, size[0], to[0], kind), size[0], to[0], kind)
    cy = _small(coefficients(spark, size[1], to[1], kind), size[1], to[1], kind)
    row = pixels.join(cx, pixels["x"] == cx["i"]).groupBy(*keys, "y", "o").agg(F.sum(F.col("v") * F.col("w")).alias("v")).withColumnRenamed("o", "x")
    return row.join(cy, row["y"] == cy["i"]).groupBy(*keys, "x", "o").agg(F.sum(F.col("v") * F.col("w")).alias("v")).withColumnRenamed("o", "y")


def blur_pixels(pixels: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """Box blur of (keys, x, y, v) by windows whose frames end at the edges; one pass along x, one along y.

    For a large radius, differences of running sums cost the same for any radius.
    """

    def along(df: DataFrame, fixed: str, moving: str) -> DataFrame:
        w = Window.partitionBy(*keys, fixed).orderBy(moving)
        if radius <= 16:
            return df.withColumn("v", F.avg("v").over(w.rowsBetween(-radius, radius)))
        run = df.withColumn("_s", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.row_number().over(w))
        run = run.withColumn("_last", F.last("_s").over(w.rowsBetween(0, radius))).withColumn("_end", F.last("_n").over(w.rowsBetween(0, radius)))
        before = F.coalesce(F.lag("_s", radius + 1).over(w), F.lit(0.0))
        begin = F.coalesce(F.lag("_n", radius + 1).over(w), F.lit(0))
        return run.withColumn("v", (F.col("_last") - before) / (F.col("_end") - begin)).drop("_s", "_n", "_last", "_end")

    return along(along(pixels, "y", "x"), "x", "y")
