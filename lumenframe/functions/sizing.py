"""Limits and sizes of images."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenframe.functions.numeric import half_up

MP = 1_000_000


def limits(ios: Column, mobile: Column, memory_gb: Column, low_memory: Column) -> Column:
    """struct<max_input, max_output, max_side>; an unknown memory is null."""
    desktop = F.when(memory_gb <= 2, 12 * MP).when(memory_gb <= 4, 24 * MP).when(memory_gb >= 8, 48 * MP).otherwise(36 * MP)
    out = F.when(ios, 4096 * 4096).when(mobile, F.when(memory_gb <= 3, 12 * MP).otherwise(16 * MP)).otherwise(desktop)
    return F.struct(
        F.when(ios, 50 * MP).when(mobile, 64 * MP).otherwise(150 * MP).cast("long").alias("max_input"),
        F.when(low_memory, F.least(out, F.lit(6 * MP))).otherwise(out).cast("long").alias("max_output"),
        F.when(ios | mobile, 8192).otherwise(16384).cast("long").alias("max_side"),
    )


def too_large(width: Column, height: Column, lim: Column) -> Column:
    return width.cast("long") * height > lim["max_input"]


def plan(width: Column, height: Column, max_output: Column, max_side: Column) -> Column:
    """struct<width, height, scaled>: the size that the limits allow.

    Rounding may leave a few pixels too many: the longer side gives them up, the
    width first. At most four steps are needed, as flooring loses up to one pixel
    a side; eight are folded. The fold is interpreted, so only sizes that need it take it.
    """
    scale = F.least(F.lit(1.0), F.sqrt(max_output / (width.cast("double") * height)), max_side / F.greatest(width, height).cast("double"))
    floor = lambda v: F.greatest(F.lit(1), F.floor(v * scale)).cast("long")
    start = F.struct(floor(width).alias("w"), floor(height).alias("h"))

    def less(s: Column, _: Column) -> Column:
        over = s["w"] * s["h"] > max_output
        wide = s["w"] >= s["h"]
        return F.struct((s["w"] - F.when(over & wide, 1).otherwise(0)).cast("long").alias("w"), (s["h"] - F.when(over & ~wide, 1).otherwise(0)).cast("long").alias("h"))

    fit = F.aggregate(F.sequence(F.lit(1), F.lit(8)), start, less)
    side = lambda whole, k: F.when(scale >= 1, whole).when(floor(width) * floor(height) <= max_output, floor(whole)).otherwise(fit[k]).cast("long")
    return F.struct(side(width, "w").alias("width"), side(height, "h").alias("height"), (scale < 1).alias("scaled"))


def working_memory(width: Column, height: Column) -> Column:
    return width.cast("long") * height * 10 + 160 * MP


def fit_within(width: Column, height: Column, side: int) -> Column:
    scale = F.least(F.lit(1.0), F.lit(float(side)) / F.greatest(width, height))
    one = lambda v: F.greatest(F.lit(1), half_up(v * scale)).cast("long")
    return F.struct(one(width).alias("width"), one(height).alias("height"))


def grid(n_pixels: Column, work_pixels: int = 2_000_000, radii: tuple[int, int] = (90, 6)) -> Column:
    """struct<s, r1, r2>: reduction of the working grid and its blur radii."""
    s = F.greatest(F.lit(1), F.ceil(F.sqrt(n_pixels / F.lit(float(work_pixels))))).cast("long")
    r = lambda v: F.greatest(F.lit(1), half_up(F.lit(float(v)) / s)).cast("long")
    return F.struct(s.alias("s"), r(radii[0]).alias("r1"), r(radii[1]).alias("r2"))
