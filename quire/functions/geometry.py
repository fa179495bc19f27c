"""Boxes as four columns (x, y, w, h): expressions only, so predicates stay visible to the planner."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box:
    """Column expressions of one box."""

    def __init__(self, x: Column, y: Column, w: Column, h: Column):
        self.x, self.y, self.w, self.h = x, y, w, h
        self.right, self.bottom = x + w, y + h
        self.area = w * h
        self.centre_x, self.centre_y = x + w / 2, y + h / 2

    def overlap(self, other: Box) -> Column:
        wide = F.least(self.right, other.right) - F.greatest(self.x, other.x)
        tall = F.least(self.bottom, other.bottom) - F.greatest(self.y, other.y)
        return F.greatest(F.lit(0.0), wide) * F.greatest(F.lit(0.0), tall)

    def touches(self, other: Box, pad: float = 0.0) -> Column:
        return (self.x - pad < other.right) & (other.x - pad < self.right) & (self.y - pad < other.bottom) & (other.y - pad < self.bottom)

    def within(self, outer: Box, pad: float = 0.0) -> Column:
        return (self.x >= outer.x - pad) & (self.y >= outer.y - pad) & (self.right <= outer.right + pad) & (self.bottom <= outer.bottom + pad)

    def holds(self, px: Column, py: Column) -> Column:
        return (px >= self.x) & (px <= self.right) & (py >= self.y) & (py <= self.bottom)

    def scaled(self, by: Column | float) -> Box:
        return Box(self.x / by, self.y / by, self.w / by, self.h / by)

    def turned_back(self, rotation: Column, width: Column, height: Column) -> Box:
        """The box on the page as printed, given on a page turned by quarter turns (its width and height)."""
        x0, y0, x1, y1 = self.x, self.y, self.right, self.bottom
        nx = F.when(rotation == 90, y0).when(rotation == 180, width - x1).when(rotation == 270, height - y1).otherwise(x0)
        ny = F.when(rotation == 90, width - x1).when(rotation == 180, height - y1).when(rotation == 270, x0).otherwise(y0)
        quarter = rotation.isin(90, 270)
        return Box(nx, ny, F.when(quarter, self.h).otherwise(self.w), F.when(quarter, self.w).otherwise(self.h))


def box(prefix: str = "", x: str = "x", y: str = "y", w: str = "w", h: str = "h") -> Box:
    return Box(*(F.col(prefix + c) for c in (x, y, w, h)))


def edges(prefix: str = "", x0: str = "x0", top: str = "top", x1: str = "x1", bottom: str = "bottom") -> Box:
    """A box given by its edges."""
    a, b, c, d = (F.col(prefix + n) for n in (x0, top, x1, bottom))
    return Box(a, b, c - a, d - b)
