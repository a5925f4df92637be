"""Points and half-open rectangles as column expressions and plain values."""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .color import num

MOST = (1 << 31) - 1


@dataclass(frozen=True)
class Rect:
    """x0 <= x < x1, y0 <= y < y1, as values; empty ones are equal and inside all others."""

    x0: int = 0
    y0: int = 0
    x1: int = 0
    y1: int = 0

    @staticmethod
    def of(xa: int, ya: int, xb: int, yb: int) -> Rect:
        return Rect(min(xa, xb), min(ya, yb), max(xa, xb), max(ya, yb))

    @property
    def empty(self) -> bool:
        return self.x0 >= self.x1 or self.y0 >= self.y1

    def shift(self, dx: int, dy: int) -> Rect:
        return Rect(self.x0 + dx, self.y0 + dy, self.x1 + dx, self.y1 + dy)

    def meet(self, o: Rect) -> Rect:
        got = Rect(max(self.x0, o.x0), max(self.y0, o.y0), min(self.x1, o.x1), min(self.y1, o.y1))
        return Rect() if got.empty else got

    def holds(self, x, y) -> Column:
        """Predicate on pixel columns; a range filter that reaches a scan."""
        x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
        return (x >= self.x0) & (x < self.x1) & (y >= self.y0) & (y < self.y1)


class Box(NamedTuple):
    """A rectangle of four columns."""

    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @staticmethod
    def named(prefix: str = "") -> Box:
        return Box(*(num(prefix + c) for c in ("x0", "y0", "x1", "y1")))

    @staticmethod
    def normal(xa, ya, xb, yb) -> Box:
        xa, ya, xb, yb = map(num, (xa, ya, xb, yb))
        return Box(F.least(xa, xb), F.least(ya, yb), F.greatest(xa, xb), F.greatest(ya, yb))

    @property
    def dx(self) -> Column:
        return self.x1 - self.x0

    @property
    def dy(self) -> Column:
        return self.y1 - self.y0

    @property
    def empty(self) -> Column:
        return (self.x0 >= self.x1) | (self.y0 >= self.y1)

    def shift(self, dx, dy) -> Box:
        return Box(self.x0 + num(dx), self.y0 + num(dy), self.x1 + num(dx), self.y1 + num(dy))

    def meet(self, o: Box) -> Box:
        got = Box(F.greatest(self.x0, o.x0), F.greatest(self.y0, o.y0), F.least(self.x1, o.x1), F.least(self.y1, o.y1))
        return Box(*(F.when(got.empty, num(0)).otherwise(c) for c in got))

    def join(self, o: Box) -> Box:
        """Smallest rectangle that holds both; empty ones don't count."""
        both = Box(F.least(self.x0, o.x0), F.least(self.y0, o.y0), F.greatest(self.x1, o.x1), F.greatest(self.y1, o.y1))
        return Box(*(F.when(self.empty, b).when(o.empty, a).otherwise(c) for a, b, c in zip(self, o, both)))

    def equals(self, o: Box) -> Column:
        same = (self.x0 == o.x0) & (self.y0 == o.y0) & (self.x1 == o.x1) & (self.y1 == o.y1)
        return same | (self.empty & o.empty)

    def within(self, o: Box) -> Column:
        return self.empty | ((self.x0 >= o.x0) & (self.y0 >= o.y0) & (self.x1 <= o.x1) & (self.y1 <= o.y1))

    def overlaps(self, o: Box) -> Column:
        return ~self.empty & ~o.empty & (self.x0 < o.x1) & (o.x0 < self.x1) & (self.y0 < o.y1) & (o.y0 < self.y1)

    def holds(self, x, y) -> Column:
        x, y = num(x), num(y)
        return (x >= self.x0) & (x < self.x1) & (y >= self.y0) & (y < self.y1)

    def columns(self, prefix: str = "") -> list[Column]:
        return [c.alias(prefix + n) for c, n in zip(self, self._fields)]


def _checked(value: Column, *parts: Column) -> Column:
    """``value`` if no part is negative and it fits in 31 bits, else -1; null (no 64-bit product) counts as too large."""
    bad = F.lit(False)
    for p in parts:
        bad = bad | (p < 0)
    return F.when(bad | value.isNull() | (value > MOST), num(-1)).otherwise(value)


def mul3(x, y, z) -> Column:
    x, y, z = map(num, (x, y, z))
    return _checked(F.try_multiply(F.try_multiply(x, y), z), x, y, z)


def add2(x, y) -> Column:
    x, y = num(x), num(y)
    return _checked(F.try_add(x, y), x, y)


def buffer_length(pixel_bytes, box: Box) -> Column:
    """Bytes of a pixel buffer; null where it has no size of 31 bits."""
    size = mul3(pixel_bytes, box.dx, box.dy)
    return F.when(size >= 0, size)


# Ratio names, horizontal and vertical pixels for a chroma sample.
RATIOS = {"444": (1, 1), "422": (2, 1), "420": (2, 2), "440": (1, 2), "411": (4, 1), "410": (4, 2)}


def _cut(v: Column, n: int) -> Column:
    """v / n, truncated towards 0."""
    return v if n == 1 else F.when(v >= 0, F.floor(v / n)).otherwise(F.ceil(v / n)).cast("long")


def chroma_place(x, y, ratio: str) -> tuple[Column, Column]:
    h, v = RATIOS[ratio]
    return _cut(num(x), h), _cut(num(y), v)


def pixel_offset(x, y, box: Box, stride, pixel_bytes) -> Column:
    return (num(y) - box.y0) * num(stride) + (num(x) - box.x0) * num(pixel_bytes)


def luma_offset(x, y, box: Box, stride) -> Column:
    return pixel_offset(x, y, box, stride, 1)


def chroma_offset(x, y, box: Box, stride, ratio: str) -> Column:
    h, v = RATIOS[ratio]
    cx, cy = chroma_place(x, y, ratio)
    return (cy - _cut(box.y0, v)) * num(stride) + cx - _cut(box.x0, h)


def plane_sizes(box: Box, ratio: str) -> tuple[Column, Column, Column, Column]:
    """Width and height of the luma plane, then of a chroma plane."""
    h, v = RATIOS[ratio]
    wide = box.dx if h == 1 else _cut(box.x1 + (h - 1), h) - _cut(box.x0, h)
    high = box.dy if v == 1 else _cut(box.y1 + (v - 1), v) - _cut(box.y0, v)
    return box.dx, box.dy, wide, high
