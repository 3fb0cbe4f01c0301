"""Rectangles as four Columns, in one pixel space."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pixels of a page at 160 DPI for one PDF point, and the scale that geometric limits assume.
ZOOM = 160 / 72
BASE_ZOOM = 2.22


@dataclass(frozen=True)
class Rect:
    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @classmethod
    def of(cls, prefix: str = "", suffix: str = "") -> Rect:
        return cls(*(F.col(f"{prefix}{n}{suffix}").cast("double") for n in ("x0", "y0", "x1", "y1")))

    @classmethod
    def field(cls, c: Column) -> Rect:
        return cls(*(c[n] for n in ("x0", "y0", "x1", "y1")))

    @property
    def width(self) -> Column:
        return self.x1 - self.x0

    @property
    def height(self) -> Column:
        return self.y1 - self.y0

    @property
    def area(self) -> Column:
        return self.width * self.height

    @property
    def middle(self) -> Column:
        return (self.x0 + self.x1) * 0.5

    def struct(self) -> Column:
        return F.struct(self.x0.alias("x0"), self.y0.alias("y0"), self.x1.alias("x1"), self.y1.alias("y1"))


def _span(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def overlap(a: Rect, b: Rect) -> tuple[Column, Column, Column]:
    """Width, height and area of the intersection."""
    w, h = _span(a.x0, a.x1, b.x0, b.x1), _span(a.y0, a.y1, b.y0, b.y1)
    return w, h, w * h


def touches(a: Rect, b: Rect) -> Column:
    """Whether they share a point; edges count."""
    return (a.x1 >= b.x0) & (b.x1 >= a.x0) & (a.y1 >= b.y0) & (b.y1 >= a.y0)


def iou(a: Rect, b: Rect) -> Column:
    both = overlap(a, b)[2]
    union = F.greatest(F.lit(0.0), a.area) + F.greatest(F.lit(0.0), b.area) - both
    return F.when((both <= 0) | (union <= 0), 0.0).otherwise(both / union)


def horizontal_overlap(a: Rect, b: Rect) -> Column:
    """Shared width by the lesser width, which counts as 1 at least."""
    return _span(a.x0, a.x1, b.x0, b.x1) / F.greatest(F.lit(1.0), F.least(a.width, b.width))


def coverage(block: Rect, region: Rect) -> Column:
    """The share of a block's area that a region covers."""
    return overlap(block, region)[2] / F.greatest(F.lit(1.0), block.area)


def significant(block: Rect, region: Rect) -> Column:
    """An overlap of 18 % of the block's area, or a wide one of some height."""
    w, h, both = overlap(block, region)
    wide = (w / F.greatest(F.lit(1.0), block.width) >= 0.62) & (h >= F.greatest(F.lit(8.0), block.height * 0.18))
    return (both > 0) & ((both / F.greatest(F.lit(1.0), block.area) >= 0.18) | wide)


def half(r: Rect, page_width: Column) -> Column:
    """0 for the left half of a page, 1 for the right."""
    return F.when(r.middle < page_width * 0.5, 0).otherwise(1)


def rgb(c: Column) -> Column:
    """r, g and b of a colour, which may be an int or a long."""
    return F.struct(*(F.shiftright(c, k).bitwiseAND(255).cast("int").alias(n) for n, k in (("r", 16), ("g", 8), ("b", 0))))


def scaled(base: float, zoom: float, least: float) -> float:
    return max(least, base * zoom / BASE_ZOOM)


def coerced(values: Column) -> Column:
    """A rectangle from [x0, y0, x1, y1] or [x, y, width, height]; null for anything else."""
    v = [F.try_element_at(values, F.lit(k)).cast("double") for k in (1, 2, 3, 4)]
    flipped = ((v[2] <= v[0]) | (v[3] <= v[1])) & (v[2] > 0) & (v[3] > 0)
    x1, y1 = F.when(flipped, v[0] + v[2]).otherwise(v[2]), F.when(flipped, v[1] + v[3]).otherwise(v[3])
    return F.when((x1 > v[0]) & (y1 > v[1]), Rect(v[0], v[1], x1, y1).struct())


def bounds(points: Column) -> Column:
    """The rectangle around an array of points [x, y], of which there must be two."""
    sound = F.filter(points, lambda p: F.size(p) >= 2)
    xs, ys = F.transform(sound, lambda p: p[0].cast("double")), F.transform(sound, lambda p: p[1].cast("double"))
    return F.when(F.size(sound) >= 2, F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1")))


def clamped(rect: Column, width: Column, height: Column, least: float = 6.0) -> Column:
    """The part of a rectangle on the image; null if it is under 6 pixels wide or high."""
    cut = lambda c, most: F.greatest(F.lit(0.0), F.least(most.cast("double"), c))
    r = Rect(cut(rect["x0"], width), cut(rect["y0"], height), cut(rect["x1"], width), cut(rect["y1"], height))
    return F.when((r.width >= least) & (r.height >= least), r.struct())
