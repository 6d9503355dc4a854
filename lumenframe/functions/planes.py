"""Planes as array columns: one row is one image, so nothing is shuffled.

Sizes are known when the plan is made. For small planes coefficients become
literals, and a pass is one generated expression for each output element. Larger
planes pass in Arrow batches, as so long an expression would take longer to compile
than to run; there, weighted sums cost their taps and blurs cost the same for any radius.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUPPORT = {"box": 0.5, "triangle": 1.0, "bicubic": 2.0}


def kernel(kind: str, x: np.ndarray) -> np.ndarray:
    """box on (-1/2, 1/2], triangle, or the cubic with a = -1/2."""
    if kind == "box":
        return ((x > -0.5) & (x <= 0.5)).astype(float)
    d = np.abs(x)
    if kind == "triangle":
        return np.clip(1 - d, 0, None)
    near, far = 1.5 * d**3 - 2.5 * d**2 + 1, -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2
    return np.where(d < 1, near, np.where(d < 2, far, 0.0))


@dataclass(frozen=True)
class Taps:
    """One pass that gives each output a weighted sum of a few inputs: index and weight are n_out x taps."""

    n_in: int
    index: np.ndarray
    weight: np.ndarray

    @property
    def n_out(self) -> int:
        return len(self.index)

    def dense(self) -> np.ndarray:
        out = np.zeros((self.n_out, self.n_in))
        np.add.at(out, (np.arange(self.n_out)[:, None], self.index), self.weight)
        return out

    def along(self, a: np.ndarray, axis: int) -> np.ndarray:
        """Cost and memory follow the taps, not the product of both sizes."""
        shape = [1] * a.ndim
        shape[axis] = self.n_out
        parts = (np.take(a, self.index[:, k], axis) * self.weight[:, k].astype(a.dtype).reshape(shape) for k in range(self.index.shape[1]))
        return reduce(np.add, parts)


@dataclass(frozen=True)
class Sliding:
    """One pass that averages at most 2 radius + 1 neighbours; edges average what is there."""

    n_in: int
    radius: int

    @property
    def n_out(self) -> int:
        return self.n_in

    def dense(self) -> np.ndarray:
        return box(self.n_in, self.radius)

    def along(self, a: np.ndarray, axis: int) -> np.ndarray:
        """Differences of running sums, kept in doubles: the same cost for any radius."""
        v = np.moveaxis(a, axis, 0)
        n, r = self.n_in, min(self.radius, self.n_in - 1)
        sums = np.empty((n + 1, *v.shape[1:]))
        sums[0] = 0
        np.cumsum(v, 0, out=sums[1:])
        out = np.empty(v.shape)
        out[: n - r], out[n - r :] = sums[r + 1 :], sums[n]
        out[r + 1 :] -= sums[1 : n - r]
        i = np.arange(n)
        out /= (np.minimum(i + r + 1, n) - np.maximum(i - r, 0)).reshape(-1, *[1] * (v.ndim - 1))
        return np.moveaxis(out, 0, axis)


def taps(n_in: int, n_out: int, kind: str) -> Taps:
    """Weights of each output sum to 1. The kernel widens only when it shrinks."""
    if n_in <= 0 or n_out <= 0:
        raise ValueError("sizes must be positive")
    scale = n_in / n_out
    wide = max(1.0, scale)
    centre = (np.arange(n_out)[:, None] + 0.5) * scale
    reach = SUPPORT[kind] * wide
    low, end = np.floor(centre - reach + 0.5).astype(int), np.floor(centre + reach + 0.5).astype(int)
    i = low + np.arange((end - low).max())
    inside = (i >= 0) & (i < np.minimum(end, n_in))
    w = np.where(inside, kernel(kind, (i - centre + 0.5) / wide), 0.0)
    return Taps(n_in, np.clip(i, 0, n_in - 1), w / w.sum(axis=1, keepdims=True))


def coefficients(n_in: int, n_out: int, kind: str) -> np.ndarray:
    """The same as a matrix n_out x n_in, for literals and small planes."""
    return taps(n_in, n_out, kind).dense()


def combination(values: list[Column], weights: list[float]) -> Column:
    parts = [v * float(w) for v, w in zip(values, weights, strict=True) if w]
    return reduce(lambda a, b: a + b, parts) if parts else F.lit(0.0)


def across(plane: Column, width: int, height: int, matrix: np.ndarray) -> Column:
    """Each row of the plane times a matrix."""
    rows = [[plane[y * width + x] for x in range(width)] for y in range(height)]
    return F.array(*[combination(row, list(w)) for row in rows for w in matrix])


def down(plane: Column, width: int, height: int, matrix: np.ndarray) -> Column:
    """Each column of the plane times a matrix."""
    columns = [[plane[y * width + x] for y in range(height)] for x in range(width)]
    return F.array(*[combination(columns[x], list(w)) for w in matrix for x in range(width)])


#: Products of both passes up to which they are expressions.
LITERAL_TERMS = 64


def times(df: DataFrame, plane: str, width: int, height: int, px: Taps | Sliding, py: Taps | Sliding, out: str) -> DataFrame:
    """Both passes over a plane, across first."""
    few = height * px.n_out <= LITERAL_TERMS and px.n_out * py.n_out <= LITERAL_TERMS
    if few and height * np.count_nonzero(mx := px.dense()) + px.n_out * np.count_nonzero(my := py.dense()) <= LITERAL_TERMS:
        df = df.withColumn("_pass", across(F.col(plane), width, height, mx))
        return df.withColumn(out, down(F.col("_pass"), px.n_out, height, my)).drop("_pass")

    def product(planes: pd.Series) -> pd.Series:
        if not len(planes):
            return pd.Series([], dtype=object)
        made = py.along(px.along(np.stack(planes.to_numpy()).reshape(-1, height, width), 2), 1)
        return pd.Series(list(made.reshape(len(planes), -1)))

    return df.withColumn(out, F.pandas_udf(product, "array<double>")(F.col(plane).cast("array<double>")))


def resampled(df: DataFrame, plane: str, width: int, height: int, to_width: int, to_height: int, kind: str, out: str) -> DataFrame:
    """Two passes, across and then down; no rounding between them."""
    return times(df, plane, width, height, taps(width, to_width, kind), taps(height, to_height, kind), out)


def box(n: int, radius: int) -> np.ndarray:
    """Averages over at most 2 radius + 1 neighbours; edges average what is there."""
    i = np.arange(n)
    w = (np.abs(i[:, None] - i[None, :]) <= radius).astype(float)
    return w / w.sum(axis=1, keepdims=True)


def blurred(df: DataFrame, plane: str, width: int, height: int, radius: int, out: str) -> DataFrame:
    return times(df, plane, width, height, Sliding(width, radius), Sliding(height, radius), out)


def grid_factor(n_pixels: int, work_pixels: int = 2_000_000) -> int:
    return max(1, math.ceil(math.sqrt(n_pixels / work_pixels)))


def matmul(a: Column, b: Column, n: int) -> Column:
    """Product of two n x n planes, in Arrow batches."""

    def product(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        square = lambda v: np.stack(v.to_numpy()).reshape(-1, n, n)
        return pd.Series(list((square(x) @ square(y)).reshape(len(x), -1)))

    return F.pandas_udf(product, "array<double>")(a, b)
