"""Box algebra over structs (x, y, width, height); doubles throughout, nothing divides by zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x, y, width, height) -> Column:
    return F.struct(*[c.cast("double").alias(n) for c, n in zip((x, y, width, height), ("x", "y", "width", "height"), strict=True)])


def right(b: Column) -> Column:
    return b["x"] + b["width"]


def bottom(b: Column) -> Column:
    return b["y"] + b["height"]


def area(b: Column) -> Column:
    return F.greatest(b["width"], F.lit(0.0)) * F.greatest(b["height"], F.lit(0.0))


def center(b: Column) -> tuple[Column, Column]:
    return b["x"] + b["width"] / 2, b["y"] + b["height"] / 2


def contains_point(b: Column, x: Column, y: Column) -> Column:
    return x.between(b["x"], right(b)) & y.between(b["y"], bottom(b))


def intersection(a: Column, b: Column) -> Column:
    w = F.least(right(a), right(b)) - F.greatest(a["x"], b["x"])
    h = F.least(bottom(a), bottom(b)) - F.greatest(a["y"], b["y"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    joint = area(a) + area(b) - intersection(a, b)
    return F.when(joint > 0, intersection(a, b) / joint).otherwise(F.lit(0.0))


def coverage(inner: Column, outer: Column) -> Column:
    return F.when(area(inner) > 0, intersection(inner, outer) / area(inner)).otherwise(F.lit(0.0))


def distance_sq(b: Column, x: Column, y: Column) -> Column:
    """From a point to the nearest point of a box."""
    dx = x - F.greatest(b["x"], F.least(x, right(b)))
    dy = y - F.greatest(b["y"], F.least(y, bottom(b)))
    return dx * dx + dy * dy


def union_of(column: str) -> Column:
    """Aggregate: the box around all boxes; null if there are none."""
    b = F.col(column)
    x, y = F.min(b["x"]), F.min(b["y"])
    return F.when(x.isNotNull(), box(x, y, F.max(right(b)) - x, F.max(bottom(b)) - y))


def rotate(b: Column, angle: Column, width: Column, height: Column) -> Column:
    """A box on a page turned by a multiple of 90 degrees."""
    a = F.pmod(angle, F.lit(360))
    return (
        F.when(a == 90, box(b["y"], width - right(b), b["height"], b["width"]))
        .when(a == 180, box(width - right(b), height - bottom(b), b["width"], b["height"]))
        .when(a == 270, box(height - bottom(b), b["x"], b["height"], b["width"]))
        .otherwise(b)
    )


def flip(b: Column, height: Column) -> Column:
    """Between y-up and y-down coordinates."""
    return box(b["x"], height - bottom(b), b["width"], b["height"])


def from_corners(values: Column) -> Column:
    """A box from [x0, y0, x1, y1, x2, y2, ...]: any polygon or corner pair."""
    v = F.transform(values, lambda t: t.cast("double"))
    xs, ys = F.filter(v, lambda _, i: i % 2 == 0), F.filter(v, lambda _, i: i % 2 == 1)
    x, y = F.array_min(xs), F.array_min(ys)
    return box(x, y, F.array_max(xs) - x, F.array_max(ys) - y)


def pixels_to_page(b: Column, left: Column, top: Column, scale: Column) -> Column:
    """A box in a rendered crop (pixels, y down) in page space (y up): the crop's left and top there, and
    pixels a unit."""
    height = b["height"] / scale
    return box(left + b["x"] / scale, top - b["y"] / scale - height, b["width"] / scale, height)


def unletterbox(b: Column, pad_x: Column, pad_y: Column, scale: Column) -> Column:
    """A box of a padded, scaled model input in its source image."""
    return box((b["x"] - pad_x) / scale, (b["y"] - pad_y) / scale, b["width"] / scale, b["height"] / scale)
