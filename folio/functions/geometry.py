"""Crop quads (``array<struct<x,y>>``: top left, top right, bottom right, bottom left), boxes and gray levels."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType


def point(x, y) -> Column:
    num = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("double")
    return F.struct(num(x).alias("x"), num(y).alias("y"))


def full_frame(width, height) -> Column:
    return F.array(point(0, 0), point(width, 0), point(width, height), point(0, height))


def rotated(quad: Column, old_height) -> Column:
    """The quad in the frame turned a quarter clockwise."""
    turn = lambda p: point(F.lit(old_height) - p["y"], p["x"])
    return F.transform(F.concat(F.slice(quad, 4, 1), F.slice(quad, 1, 3)), turn)


def is_full_frame(quad: Column, width, height) -> Column:
    w, h = F.lit(width), F.lit(height)
    slack = F.greatest(F.lit(2.0), F.least(w, h) * 0.01)
    near = lambda p, q: (F.abs(p["x"] - q["x"]) <= slack) & (F.abs(p["y"] - q["y"]) <= slack)
    return F.forall(F.zip_with(quad, full_frame(w, h), near), lambda ok: ok)


def contains(quad: Column, px, py) -> Column:
    """Whether a ray from the point crosses the outline an odd number of times."""
    x, y = F.lit(px), F.lit(py)
    crossings = []
    for i in range(4):
        a, b = quad[i], quad[(i + 3) % 4]
        spans = (a["y"] > y) != (b["y"] > y)
        at = a["x"] + F.try_divide((b["x"] - a["x"]) * (y - a["y"]), b["y"] - a["y"])
        crossings.append(F.when(spans & (x < at), 1).otherwise(0))
    return reduce(lambda s, c: s + c, crossings) % 2 == 1


def _limit(v: Column, low, high) -> Column:
    return F.greatest(low if isinstance(low, Column) else F.lit(low), F.least(high if isinstance(high, Column) else F.lit(high), v))


def _ends(quad: Column) -> tuple[Column, Column, Column, Column]:
    xs, ys = F.transform(quad, lambda p: p["x"]), F.transform(quad, lambda p: p["y"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def moved(quad: Column, dx, dy, width, height) -> Column:
    """Shifted as far as every corner stays in the image."""
    x0, y0, x1, y1 = _ends(quad)
    sx, sy = _limit(F.lit(dx), -x0, F.lit(width) - x1), _limit(F.lit(dy), -y0, F.lit(height) - y1)
    return F.transform(quad, lambda p: point(p["x"] + sx, p["y"] + sy))


def corner_moved(quad: Column, index: int, dx, dy, width, height) -> Column:
    new = point(_limit(quad[index]["x"] + F.lit(dx), 0.0, float(width)), _limit(quad[index]["y"] + F.lit(dy), 0.0, float(height)))
    return F.transform(quad, lambda p, i: F.when(i == index, new).otherwise(p))


def edge_moved(quad: Column, edge: int, dx, dy, width, height) -> Column:
    """Both corners of an edge move along one axis: even edges up and down, odd ones sideways."""
    ends = (edge, (edge + 1) % 4)
    up = edge % 2 == 0
    shift = lambda p: (
        point(p["x"], _limit(p["y"] + F.lit(dy), 0.0, float(height))) if up else point(_limit(p["x"] + F.lit(dx), 0.0, float(width)), p["y"])
    )
    return F.transform(quad, lambda p, i: F.when(i.isin(*ends), shift(p)).otherwise(p))


def handle_at(quad: Column, px, py, scale=1.0, margin: float = 18.0) -> Column:
    """What a pointer takes hold of: the nearest corner ``c0..c3``, else edge middle ``e0..e3``, else ``move`` or ``none``."""
    s, x, y = F.lit(scale), F.lit(px), F.lit(py)
    away = lambda cx, cy: F.hypot(x - cx, y - cy)

    def nearest(mark: str, spots: list[Column]) -> Column:
        least = F.least(*spots)
        found = F.when(F.lit(False), "")
        for i, d in enumerate(spots):
            found = found.when(d == least, f"{mark}{i}")
        return F.when(least < margin, found)

    corners = [away(quad[i]["x"] * s, quad[i]["y"] * s) for i in range(4)]
    edges = [
        away((quad[i]["x"] + quad[(i + 1) % 4]["x"]) * s / 2, (quad[i]["y"] + quad[(i + 1) % 4]["y"]) * s / 2) for i in range(4)
    ]
    inside = F.when(contains(F.transform(quad, lambda p: point(p["x"] * s, p["y"] * s)), px, py), "move")
    return F.coalesce(nearest("c", corners), nearest("e", edges), inside, F.lit("none"))


def bounds(quad: Column, width, height) -> Column:
    x0, y0, x1, y1 = _ends(quad)
    left, top = _limit(x0, 0.0, float(width)), _limit(y0, 0.0, float(height))
    right, bottom = _limit(x1, 0.0, float(width)), _limit(y1, 0.0, float(height))
    return F.struct(
        left.alias("x"), top.alias("y"), F.greatest(F.lit(1.0), right - left).alias("width"), F.greatest(F.lit(1.0), bottom - top).alias("height")
    )


def iou(a: Column, b: Column) -> Column:
    """Overlap of two boxes ``struct(x, y, width, height)`` over their union."""
    w = F.greatest(F.lit(0.0), F.least(a["x"] + a["width"], b["x"] + b["width"]) - F.greatest(a["x"], b["x"]))
    h = F.greatest(F.lit(0.0), F.least(a["y"] + a["height"], b["y"] + b["height"]) - F.greatest(a["y"], b["y"]))
    both = w * h
    return F.coalesce(F.try_divide(both, a["width"] * a["height"] + b["width"] * b["height"] - both), F.lit(0.0))


@F.pandas_udf(ArrayType(IntegerType()))
def histogram(levels: pd.Series) -> pd.Series:
    """Counts of the gray levels 0 to 255 in an array of levels; null and other levels are not counted, a null array has none."""
    out = []
    for found in levels:
        values = np.array([] if found is None else [x for x in found if x is not None], np.float64)
        values = values[(values >= 0) & (values < 256) & (values == np.floor(values))]
        out.append(np.bincount(values.astype(np.int64), minlength=256).astype(np.int32))
    return pd.Series(out)


def clip_points(counts: Column, share: float = 0.01) -> Column:
    """Black and white point: the levels at which the running share from below and from above passes ``share``."""
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("black"), F.lit(None).cast("int").alias("white"), _total(counts).alias("total"))

    def step(s: Column, n: Column) -> Column:
        run = s["sum"] + n
        return F.struct(
            run.alias("sum"),
            (s["at"] + 1).alias("at"),
            F.coalesce(s["black"], F.when(run > s["total"] * share, s["at"])).alias("black"),
            F.coalesce(s["white"], F.when(run >= s["total"] * (1 - share), s["at"])).alias("white"),
            s["total"].alias("total"),
        )

    return F.aggregate(counts, start, step, lambda s: F.struct(s["black"].alias("black"), s["white"].alias("white")))


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x)


def leveled(levels: Column, black: Column, white: Column) -> Column:
    """Levels stretched so that the points become 0 and 255."""
    span = F.greatest(white - black, F.lit(1))
    return F.transform(levels, lambda v: _limit(F.round((v - black) * 255.0 / span).cast("int"), 0, 255))


def auto_levels(black: Column, white: Column, least: float = 0.05) -> Column:
    """``struct(brightness, contrast)``, -50 to 50: the sliders that take the points to 0 and 255; 0 where they lie too close."""
    low, high = black / 255.0, white / 255.0
    total, span = low + high, high - low
    k1 = F.when(total > 0.01, 1 / total).otherwise(1.0)
    k2 = F.when(total > 0.01, F.try_divide(total, span)).otherwise(1.0)
    slider = lambda k: F.when(span < least, 0).otherwise(F.round(_limit((k - 1) * 100, -50.0, 50.0)).cast("int"))
    return F.struct(slider(k1).alias("brightness"), slider(k2).alias("contrast"))


def sharpened(center: Column, north: Column, south: Column, west: Column, east: Column, amount) -> Column:
    """A gray level by a kernel between identity (amount 0) and a full Laplacian sharpening (100)."""
    t = F.lit(amount) / 100.0
    return _limit((1 + 4 * t) * center - t * (north + south + west + east), 0.0, 255.0)
