"""Rectangles in an image's unit square, as struct columns of x, y, w, h."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenframe.functions.numeric import clamp, half_up

LEAST = 1e-6  # smallest side


def rect(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def valid(r: Column) -> Column:
    fine = [~F.isnan(r[k]) & (F.abs(r[k]) < float("inf")) for k in "xywh"]
    return F.coalesce(fine[0] & fine[1] & fine[2] & fine[3] & (r["w"] > 0) & (r["h"] > 0), F.lit(False))


def whole(r: Column, slack: float = 1e-3) -> Column:
    return (r["x"] <= slack) & (r["y"] <= slack) & (r["x"] + r["w"] >= 1 - slack) & (r["y"] + r["h"] >= 1 - slack)


def contains(outer: Column, inner: Column, slack: float = 1e-4) -> Column:
    far = lambda r, at, side: r[at] + r[side]
    return (
        (inner["x"] >= outer["x"] - slack)
        & (inner["y"] >= outer["y"] - slack)
        & (far(inner, "x", "w") <= far(outer, "x", "w") + slack)
        & (far(inner, "y", "h") <= far(outer, "y", "h") + slack)
    )


def same(a: Column, b: Column, slack: float = 1e-4) -> Column:
    out = F.lit(True)
    for k in "xywh":
        out = out & (F.abs(a[k] - b[k]) < slack)
    return out


def clamped(r: Column, least: float = LEAST) -> Column:
    w, h = clamp(r["w"], least, 1.0), clamp(r["h"], least, 1.0)
    return rect(clamp(r["x"], 0.0, 1 - w), clamp(r["y"], 0.0, 1 - h), w, h)


def relative(outer: Column, inner: Column) -> Column:
    """inner in the coordinates of what a crop to outer leaves."""
    return clamped(rect((inner["x"] - outer["x"]) / outer["w"], (inner["y"] - outer["y"]) / outer["h"], inner["w"] / outer["w"], inner["h"] / outer["h"]))


def moved(r: Column, dx: Column, dy: Column) -> Column:
    return rect(clamp(r["x"] + dx, 0.0, 1 - r["w"]), clamp(r["y"] + dy, 0.0, 1 - r["h"]), r["w"], r["h"])


def fitted(r: Column, ratio: Column) -> Column:
    """The largest rectangle of a width/height ratio around the same centre."""
    tall = r["w"] / ratio > r["h"]
    w = F.when(tall, r["h"] * ratio).otherwise(r["w"])
    h = F.when(tall, r["h"]).otherwise(r["w"] / ratio)
    return clamped(rect(r["x"] + r["w"] / 2 - w / 2, r["y"] + r["h"] / 2 - h / 2, w, h))


def resized(r: Column, corner: str, dx: Column, dy: Column, least: float, ratio: float | None = None) -> Column:
    """One corner (nw, ne, sw, se) follows (dx, dy), the opposite one stays."""
    west, north = "w" in corner, "n" in corner
    along = lambda at, side, back, d: (
        (lambda anchor, room, reach: (anchor, room, clamp(reach, 0.0, room)))(
            r[at] + r[side] if back else r[at],
            r[at] + r[side] if back else 1 - r[at],
            -(r[at] + d - (r[at] + r[side])) if back else r[at] + r[side] + d - r[at],
        )
    )
    ax, room_w, w = along("x", "w", west, dx)
    ay, room_h, h = along("y", "h", north, dy)
    if ratio:
        wide = w / ratio > h
        w, h = F.when(wide, w).otherwise(h * ratio), F.when(wide, w / ratio).otherwise(h)
        shrink = F.least(F.lit(1.0), F.try_divide(room_w, w), F.try_divide(room_h, h))
        w, h = w * shrink, h * shrink
        grow = F.greatest(F.lit(1.0), F.try_divide(F.lit(least), w), F.try_divide(F.lit(least), h))
        w, h = F.least(w * grow, room_w), F.least(h * grow, room_h)
    else:
        w, h = F.greatest(w, F.least(F.lit(least), room_w)), F.greatest(h, F.least(F.lit(least), room_h))
    return rect(ax - w if west else ax, ay - h if north else ay, w, h)


def pixels(r: Column, width: Column, height: Column) -> Column:
    """Whole pixels, at least one each way."""

    def span(at: str, side: str, size: Column) -> tuple[Column, Column]:
        low = clamp(half_up(r[at] * size), 0, size - 1)
        return low, clamp(half_up((r[at] + r[side]) * size), low + 1, size) - low

    (x, w), (y, h) = span("x", "w", width), span("y", "h", height)
    return rect(x, y, w, h)


def opened(r: Column, least: float, pixel_ratio: float | None, aspect: Column) -> Column:
    """A crop as it opens: clamped, then of the wanted pixel ratio."""
    start = clamped(r, least)
    return fitted(start, F.lit(pixel_ratio) / aspect) if pixel_ratio else start


def placement(r: Column) -> Column:
    """Where a region's preview lies, in per cent."""
    return F.struct((-r["x"] / r["w"] * 100).alias("left"), (-r["y"] / r["h"] * 100).alias("top"), (100 / r["w"]).alias("width"), (100 / r["h"]).alias("height"))
