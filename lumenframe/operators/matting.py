"""From image and matte to the cut-out: model input, matte, clean foreground colours, composition.

Every image is a row with array columns, so a job of any number of images is one
stage without a shuffle.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.numeric import byte_even, byte_floor, clamp, sigmoid
from lumenframe.functions.planes import Taps, blurred, grid_factor, resampled, times

EPSILON = 1e-5
#: Usual means and deviations of red, green and blue.
MEAN, DEVIATION = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
RGB = "rgb"


def each(f, *arrays: str) -> Column:
    """f over arrays of equal length."""
    at = F.arrays_zip(*[F.col(a).alias(f"f{k}") for k, a in enumerate(arrays)])
    return F.transform(at, lambda s: f(*[s[f"f{k}"] for k in range(len(arrays))]))


def normalised(plane: str, mean: float, deviation: float) -> Column:
    return F.transform(plane, lambda v: (v / 255.0 - mean) / deviation)


def flatten(df: DataFrame) -> DataFrame:
    """r, g, b on white where the image is transparent."""
    return df.withColumns({c: each(lambda v, a: byte_even(v * (a / 255.0) + 255.0 * (1 - a / 255.0)), c, "a") for c in RGB})


def model_input(df: DataFrame, size: tuple[int, int], to: tuple[int, int]) -> DataFrame:
    """vec_id, in_r, in_g, in_b: flattened, resampled by triangles, normalised."""
    return model_input_columns(df, size, to).select("vec_id", *[f"in_{c}" for c in RGB])


def mock_matte(df: DataFrame, strips: int = 0, width: int = 0) -> DataFrame:
    """Adds matte: sigmoid of four times the channels' mean; with strips, each twelfth of the columns counts a millionth more."""
    mean = each(lambda r, g, b: (r + g + b) / 3.0, "in_r", "in_g", "in_b")
    if strips:
        gain = lambda i: 1.0 + F.floor(i % width * strips / F.lit(width)) * 1e-6
        return df.withColumn("matte", F.transform(mean, lambda v, i: sigmoid(4.0 * v * gain(i))))
    return df.withColumn("matte", F.transform(mean, lambda v: sigmoid(4.0 * v)))


def alpha_from(df: DataFrame, size: tuple[int, int], to: tuple[int, int]) -> DataFrame:
    """Adds alpha (bytes at the image's size): the matte, enlarged by the cubic, never above the source's alpha."""
    df = resampled(df, "matte", *size, *to, "bicubic", "_fine")
    df = df.withColumn("_fine", F.transform("_fine", byte_floor))
    return df.withColumn("alpha", each(lambda m, s: F.floor((m * s + 127) / F.lit(255)).cast("int"), "_fine", "a")).drop("_fine")


def estimates(df: DataFrame, width: int, height: int, r1: int, r2: int) -> DataFrame:
    """Adds fg_c and bg_c for working planes p_r, p_g, p_b and p_a: blur fusion in two passes.

    The first foreground is clamped, the first background is not.
    """
    for k, r in ((1, r1), (2, r2)):
        df = blurred(df, "p_a", width, height, r, f"_a{k}")
    for c in RGB:
        p = f"p_{c}"
        df = df.withColumn("_x", each(lambda i, a: i * a, p, "p_a")).withColumn("_y", each(lambda i, a: i * (1 - a), p, "p_a"))
        df = blurred(blurred(df, "_x", width, height, r1, "_x"), "_y", width, height, r1, "_y")
        df = df.withColumn("_x", each(lambda x, m: x / (m + EPSILON), "_x", "_a1")).withColumn("_y", each(lambda y, m: y / (1 - m + EPSILON), "_y", "_a1"))
        df = df.withColumn("_x", each(lambda f, b, i, a: clamp(f + a * (i - a * f - (1 - a) * b), 0.0, 1.0), "_x", "_y", p, "p_a"))
        df = df.withColumn("_x", each(lambda f, a: f * a, "_x", "p_a")).withColumn("_y", each(lambda b, a: b * (1 - a), "_y", "p_a"))
        df = blurred(blurred(df, "_x", width, height, r2, "_x"), "_y", width, height, r2, "_y")
        df = df.withColumn(f"fg_{c}", each(lambda x, m: x / (m + EPSILON), "_x", "_a2")).withColumn(f"bg_{c}", each(lambda y, m: y / (1 - m + EPSILON), "_y", "_a2"))
    return df.drop("_x", "_y", "_a1", "_a2")


def bilinear(n_fine: int, n_coarse: int) -> Taps:
    """Looks positions of a fine grid up in a coarse one; half-pixel centres, clamped at the edges."""
    at = np.clip((np.arange(n_fine) + 0.5) * (n_coarse / n_fine) - 0.5, 0, n_coarse - 1)
    low = np.floor(at).astype(int)
    share = at - low
    return Taps(n_coarse, np.stack([low, np.minimum(low + 1, n_coarse - 1)], 1), np.stack([1 - share, share], 1))


def working_grid(width: int, height: int, radii: tuple[int, int], work_pixels: int) -> tuple[int, int, int, int, int]:
    """Reduction, size and radii of the grid on which colours are estimated."""
    s = grid_factor(width * height, work_pixels)
    half = lambda v: int(v + 0.5)
    ww, wh = (width, height) if s == 1 else (max(1, half(width / s)), max(1, half(height / s)))
    return s, ww, wh, *(max(1, half(r / s)) for r in radii)


def foreground(df: DataFrame, width: int, height: int, radii: tuple[int, int] = (90, 6), work_pixels: int = 2_000_000) -> DataFrame:
    """r, g, b, a of the cut-out from r, g, b and alpha; soft pixels get estimated colours, clear ones become 0, 0, 0, 0."""
    s, ww, wh, r1, r2 = working_grid(width, height, radii, work_pixels)
    for c in ("r", "g", "b", "alpha"):
        p = "p_a" if c == "alpha" else f"p_{c}"
        df = df.withColumn(p, F.transform(c, lambda v: v / 255.0))
        if s > 1:
            df = resampled(df, p, width, height, ww, wh, "box", p)
    df = estimates(df, ww, wh, r1, r2)
    for c in RGB:
        for g in (f"fg_{c}", f"bg_{c}"):
            if s > 1:
                df = times(df, g, ww, wh, bilinear(width, ww), bilinear(height, wh), g)
        share = lambda v: v / 255.0
        soft = lambda f, b, i, a: byte_even((f + share(a) * (share(i) - share(a) * f - (1 - share(a)) * b)) * 255.0)
        df = df.withColumn(c, each(lambda f, b, i, a, soft=soft: F.when(a == 255, i).when(a == 0, 0).otherwise(soft(f, b, i, a)), f"fg_{c}", f"bg_{c}", c, "alpha"))
    return df.withColumn("a", F.col("alpha")).drop("alpha", *[f"{x}_{c}" for x in ("p", "fg", "bg") for c in RGB], "p_a")


def composed(df: DataFrame, colour: tuple[int, int, int]) -> DataFrame:
    """r, g, b on a background colour; a becomes 255."""
    df = df.withColumns({c: each(lambda v, a, bg=bg: byte_even(v * (a / 255.0) + bg * (1 - a / 255.0)), c, "a") for c, bg in zip(RGB, colour, strict=True)})
    return df.withColumn("a", F.transform("a", lambda _: F.lit(255)))


def cut_out(df: DataFrame, width: int, height: int, grid: tuple[int, int], radii: tuple[int, int] = (1, 1)) -> DataFrame:
    """The whole job for images r, g, b, a of one size: model input, mock matte, alpha, foreground. One projection, no join."""
    made = mock_matte(model_input_columns(df, (width, height), grid))
    return foreground(alpha_from(made, grid, (width, height)), width, height, radii)


def model_input_columns(df: DataFrame, size: tuple[int, int], to: tuple[int, int]) -> DataFrame:
    """model_input beside the image's own columns."""
    kept = df.withColumns({f"_{c}": F.col(c) for c in RGB})
    flat = flatten(kept)
    for k, c in enumerate(RGB):
        flat = flat.withColumn(c, F.transform(c, lambda v: v.cast("double")))
        flat = resampled(flat, c, *size, *to, "triangle", f"in_{c}")
        flat = flat.withColumn(f"in_{c}", normalised(f"in_{c}", MEAN[k], DEVIATION[k]))
    return flat.withColumns({c: F.col(f"_{c}") for c in RGB}).drop(*[f"_{c}" for c in RGB])

