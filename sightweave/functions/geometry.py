"""Boxes as column expressions: corners x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    return tuple(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2"))


def area(a: Box) -> Column:
    return F.greatest(F.lit(0), a[2] - a[0]) * F.greatest(F.lit(0), a[3] - a[1])


def intersection(a: Box, b: Box) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(F.lit(0), w) * F.greatest(F.lit(0), h)


def iou(a: Box, b: Box, floored: bool = False) -> Column:
    """Intersection over union; floored takes each area as one at least, else an empty union gives 0."""
    inter = intersection(a, b)
    if floored:
        return inter / (F.greatest(F.lit(1), area(a)) + F.greatest(F.lit(1), area(b)) - inter)
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def containment(inner: Box, other: Box, of_smaller: bool = False) -> Column:
    """Share of inner (or of the smaller of both) that lies in the other box."""
    base = F.least(area(inner), area(other)) if of_smaller else area(inner)
    return F.when(base > 0, intersection(inner, other) / base).otherwise(0.0)


def clamped(a: Box, width: int, height: int) -> Column:
    """The box inside the frame as a struct; null if nothing of it is left."""
    x1, x2 = (F.least(F.greatest(v, F.lit(0)), F.lit(width)) for v in (a[0], a[2]))
    y1, y2 = (F.least(F.greatest(v, F.lit(0)), F.lit(height)) for v in (a[1], a[3]))
    return F.when((x2 > x1) & (y2 > y1), F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")))


def shrink_scale(width: Column, height: Column, max_width: int, max_height: int) -> Column:
    """The factor that fits a frame into the limits; never enlarges."""
    return F.least(F.lit(1.0), F.lit(float(max_width)) / width, F.lit(float(max_height)) / height)
