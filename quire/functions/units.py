"""Sizes: millimetres, pixels, points, ratios, placement of an image on a page, copies on a sheet."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ---
MM_POINTS = 72 / 25.4
PX_POINTS = 0.75
MIN_SIDE, MAX_SIDE, MAX_PIXELS = 16, 8192, 40_000_000
# --------------------


def rounded(value: Column) -> Column:
    """Half up, also below zero."""
    return F.floor(value + 0.5)


def mm_to_pixels(mm: Column, dpi: Column) -> Column:
    return rounded(mm / 25.4 * dpi).cast("int")


def two_decimals(value: Column) -> Column:
    """A number from 1 up with two decimals, as C prints it: the exact binary value rounded, ties to even.

    Java's formatter rounds the shortest decimal that names the value, and ties up. The fraction is counted in 2^-52,
    which is exact, and its hundredths fit a long.
    """
    whole = F.floor(value)
    parts = ((value - whole) * F.lit(float(2**52))).cast("long") * 100
    down, rest = F.shiftright(parts, 52), parts % 2**52
    up = (rest > 2**51) | ((rest == 2**51) & (down % 2 == 1))
    hundredths = whole * 100 + down + up.cast("long")
    return F.concat(F.floor(hundredths / 100).cast("string"), F.lit("."), F.lpad((hundredths % 100).cast("string"), 2, "0"))


def ratio_label(width: Column, height: Column) -> Column:
    """4:5 where both sides reduce to at most 32, else 1.91:1 or 1:1.91."""
    # Euclid over a fixed number of steps: sides are below 2^31, and 46 steps settle any such pair.
    step = lambda acc, _: F.struct(F.when(acc["b"] == 0, acc["a"]).otherwise(acc["b"]).alias("a"), F.when(acc["b"] == 0, F.lit(0)).otherwise(acc["a"] % acc["b"]).alias("b"))
    d = F.aggregate(F.sequence(F.lit(1), F.lit(46)), F.struct(width.cast("int").alias("a"), height.cast("int").alias("b")), step)["a"]
    short = lambda v: F.regexp_replace(two_decimals(v), "0$", "")
    exact = (width / d <= 32) & (height / d <= 32)
    return (
        F.when(exact, F.concat((width / d).cast("int").cast("string"), F.lit(":"), (height / d).cast("int").cast("string")))
        .when(width >= height, F.concat(short(width / height), F.lit(":1"))).otherwise(F.concat(F.lit("1:"), short(height / width)))
    )


def custom_size_problem(width: Column, height: Column) -> Column:
    return (
        F.when(width.isNull() | height.isNull() | (width != F.floor(width)) | (height != F.floor(height)), "invalid")
        .when((width < MIN_SIDE) | (height < MIN_SIDE), "tooSmall").when((width > MAX_SIDE) | (height > MAX_SIDE), "tooLarge").when(width * height > MAX_PIXELS, "tooManyPixels")
    )


def placement(width: Column, height: Column, page_w: Column, page_h: Column, margin_mm: float, fit: str, orientation: str = "auto") -> Column:
    """Where an image goes on a page, in points from the top left: struct of page and box.

    ``fit``: contain, cover (the box is the area, the image is cropped) or original (never enlarged).
    """
    if fit not in ("contain", "cover", "original"):
        raise ValueError(f"unknown fit: {fit}")
    margin = max(0.0, margin_mm) * MM_POINTS
    natural_w, natural_h = width * PX_POINTS, height * PX_POINTS
    landscape = F.lit(orientation == "landscape") | (F.lit(orientation == "auto") & (width > height))
    swap = landscape != (page_w > page_h)
    pw, ph = F.when(swap, page_h).otherwise(page_w), F.when(swap, page_w).otherwise(page_h)
    aw, ah = F.greatest(F.lit(1.0), pw - 2 * margin), F.greatest(F.lit(1.0), ph - 2 * margin)
    scale = F.least(aw / natural_w, ah / natural_h)
    if fit == "original":
        scale = F.least(F.lit(1.0), scale)
    dw, dh = (aw, ah) if fit == "cover" else (natural_w * scale, natural_h * scale)
    return F.struct(pw.alias("page_w"), ph.alias("page_h"), (margin + (aw - dw) / 2).alias("x"), (margin + (ah - dh) / 2).alias("y"), dw.alias("w"), dh.alias("h"), F.lit(fit == "cover").alias("crop"))


def sheet_capacity(paper_w: Column, paper_h: Column, margin: Column, gap: Column, item_w: Column, item_h: Column) -> Column:
    columns = F.floor((paper_w - margin * 2 + gap) / (item_w + gap))
    rows = F.floor((paper_h - margin * 2 + gap) / (item_h + gap))
    return F.struct(columns.alias("columns"), rows.alias("rows"), (columns * rows).alias("copies"))
