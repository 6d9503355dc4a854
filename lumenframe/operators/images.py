"""Whole images of any size as bytes: one Arrow pass, one image at a time, in strips of rows.

Spark cuts Arrow batches by bytes (64 MB unless the session says otherwise), and each
image is given back as soon as it is made, so a task holds a few images at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lumenframe.functions.planes import Sliding, Taps, taps
from lumenframe.operators.matting import EPSILON, bilinear, working_grid
from lumenframe.sources.png import encode

#: Pixels of a strip; what a step needs beside the image and the working grid follows it.
STRIP = 1 << 18


def _strips(height: int, width: int) -> Iterator[tuple[int, int]]:
    step = max(1, STRIP // max(1, width))
    return ((y, min(height, y + step)) for y in range(0, height, step))


def reduced(plane: np.ndarray, px: Taps, py: Taps) -> np.ndarray:
    """A byte plane as shares of 1 on a smaller grid; across in strips, then down."""
    height, width = plane.shape
    rows = np.empty((height, px.n_out))
    for begin, end in _strips(height, width):
        rows[begin:end] = px.along(plane[begin:end] / 255.0, 1)
    return py.along(rows, 0)


def fused(colour: np.ndarray, alpha: np.ndarray, r1: int, r2: int, means: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Foreground and background of one channel: blur fusion in two passes, given the blurred alphas."""
    height, width = alpha.shape
    blur = lambda v, r: Sliding(height, r).along(Sliding(width, r).along(v, 1), 0)
    estimate = lambda f, b, r, mean: (blur(f, r) / (mean + EPSILON), blur(b, r) / (1 - mean + EPSILON))
    f, b = estimate(colour * alpha, colour * (1 - alpha), r1, means[0])
    f = np.clip(f + alpha * (colour - alpha * f - (1 - alpha) * b), 0.0, 1.0)
    return estimate(f * alpha, b * (1 - alpha), r2, means[1])


def looked_up(plane: np.ndarray, px: Taps, py: Taps, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Values of single pixels of a finer grid."""
    return sum(py.weight[y, j] * px.weight[x, i] * plane[py.index[y, j], px.index[x, i]] for j in range(py.index.shape[1]) for i in range(px.index.shape[1]))


def cut(rgba: np.ndarray, alpha: np.ndarray, radii: tuple[int, int] = (90, 6), work_pixels: int = 2_000_000) -> np.ndarray:
    """height x width x 4 bytes of the cut-out; without soft pixels nothing is estimated."""
    height, width = alpha.shape
    out = np.dstack([rgba[..., :3], alpha])
    out[alpha == 0, :3] = 0
    if not ((alpha > 0) & (alpha < 255)).any():
        return out
    s, ww, wh, r1, r2 = working_grid(width, height, radii, work_pixels)
    small = (lambda p: p / 255.0) if s == 1 else lambda p: reduced(p, taps(width, ww, "box"), taps(height, wh, "box"))
    a = small(alpha)
    means = tuple(Sliding(wh, r).along(Sliding(ww, r).along(a, 1), 0) for r in (r1, r2))
    px, py = bilinear(width, ww), bilinear(height, wh)
    for k in range(3):
        estimates = fused(small(rgba[..., k]), a, r1, r2, means)
        for begin, end in _strips(height, width):
            part = alpha[begin:end]
            y, x = np.nonzero((part > 0) & (part < 255))
            f, b = (e[begin + y, x] if s == 1 else looked_up(e, px, py, x, begin + y) for e in estimates)
            share, i = part[y, x] / 255.0, rgba[begin + y, x, k] / 255.0
            out[begin + y, x, k] = np.rint(np.clip((f + share * (i - share * f - (1 - share) * b)) * 255.0, 0, 255)).astype(np.uint8)
    return out


def cut_images(df: DataFrame, key: str, radii: tuple[int, int] = (90, 6), work_pixels: int = 2_000_000, packed: bool = False) -> DataFrame:
    """(key, width, height, rgba, alpha) -> key, width, height, the cut-out as rgba or, if packed, as png, and error.

    rgba has four bytes a pixel and alpha one, rows from the top. Each image has a size of
    its own. An image whose bytes are null or do not fit its size has an error and no
    result; other columns of df are ignored.
    """
    kind, made = df.schema[key].dataType.simpleString(), "png" if packed else "rgba"

    def one(width, height, rgba, alpha) -> tuple[bytes | None, str | None]:
        if width is None or height is None or rgba is None or alpha is None or min(width, height) < 1:
            return None, "no image"
        if len(rgba) != 4 * width * height or len(alpha) != width * height:
            return None, "size and bytes differ"
        image = cut(np.frombuffer(rgba, np.uint8).reshape(height, width, 4), np.frombuffer(alpha, np.uint8).reshape(height, width), radii, work_pixels)
        return encode(image) if packed else image.tobytes(), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                size = [batch.column(c)[k].as_py() for c in (1, 2)]
                data = [None if (v := batch.column(c)[k]).as_buffer() is None else v.as_buffer() for c in (3, 4)]
                result, error = one(*size, *data)
                columns = [batch.column(c).slice(k, 1) for c in range(3)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([result], pa.binary()), pa.array([error], pa.string())], names=["_key", "width", "height", made, "error"])

    chosen = df.select(df[key].alias("_key"), df["width"].cast("int"), df["height"].cast("int"), "rgba", "alpha")
    return chosen.mapInArrow(run, f"_key {kind}, width int, height int, {made} binary, error string").withColumnRenamed("_key", key)


def pixel_rows(df: DataFrame, key: str) -> DataFrame:
    """(key, rgba) -> key, p, r, g, b, a: one row for each pixel, in strips; images without a result give none.

    Expressions would read or copy the whole image again for each pixel.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                if (data := batch.column(1)[k].as_buffer()) is None:
                    continue
                image = np.frombuffer(data, np.uint8).reshape(-1, 4)
                for low in range(0, len(image), STRIP):
                    part = image[low : low + STRIP].astype(np.int32)
                    at = pa.array(np.arange(low, low + len(part), dtype=np.int32))
                    yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(0)[k], len(part)), at, *(pa.array(part[:, c].copy()) for c in range(4))], names=["_key", "p", *"rgba"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(df[key].alias("_key"), "rgba").mapInArrow(run, f"_key {kind}, p int, r int, g int, b int, a int").withColumnRenamed("_key", key)
