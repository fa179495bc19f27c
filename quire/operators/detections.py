"""Detected marks in images: joined text pieces, repeated patterns, overlays, scores."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.geometry import box
from quire.plans.folds import Group, fold_groups

# --- fixed values ---
MIN_CONFIDENCE = 0.4
PRESELECT = 0.6
TOP = 12
SIMILAR = 0.2
PATTERN_LINES = 3
OVERLAY_SHARE = 0.3
# --------------------

_FIELDS = "region_no int, type string, score double, x double, y double, w double, h double, angle double, line_height double, elongation double"
_COLUMNS = [f.split()[0] for f in _FIELDS.split(", ")]


def _lesser(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(b < a, b, a)


def _larger(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(b > a, b, a)


def join_text_regions(regions: DataFrame, image: str = "image_id") -> DataFrame:
    """Pieces of one line of text become one region: like angle, same centre line, little gap.

    A piece is compared with the region as grown so far, left to right, so an image is walked. ``place`` is a region's
    number in that order, which later steps follow.
    """
    schema = f"{image} {regions.schema[image].dataType.simpleString()}, {_FIELDS}, place int"

    def rule(g: Group) -> Group:
        order = np.argsort(g["x"].astype(float), axis=1, kind="stable")
        g = {c: np.take_along_axis(v, order, axis=1) for c, v in g.items()}
        x, y, w, h, angle, lh, el, score = (g[c].astype(float) for c in ("x", "y", "w", "h", "angle", "line_height", "elongation", "score"))
        joined = np.zeros(x.shape, bool)
        joined[:, 0] = True
        for i in range(1, x.shape[1]):
            j, one = slice(0, i), slice(i, i + 1)
            fits = (
                joined[:, j] & (np.abs(angle[:, j] - angle[:, one]) < 8) & (np.abs(y[:, j] + h[:, j] / 2 - y[:, one] - h[:, one] / 2) < np.maximum(h[:, j], h[:, one]) * 0.5)
                & (x[:, one] - (x[:, j] + w[:, j]) < np.maximum(lh[:, j], lh[:, one]) * 1.2) & (x[:, one] + w[:, one] > x[:, j]))
            found = fits.any(axis=1)
            joined[~found, i] = True
            r = np.flatnonzero(found)
            k = np.argmax(fits[r], axis=1)
            left, top = _lesser(x[r, k], x[r, i]), _lesser(y[r, k], y[r, i])
            right, bottom = _larger(x[r, k] + w[r, k], x[r, i] + w[r, i]), _larger(y[r, k] + h[r, k], y[r, i] + h[r, i])
            x[r, k], y[r, k], w[r, k], h[r, k] = left, top, right - left, bottom - top
            score[r, k] = _larger(score[r, k], score[r, i])
            el[r, k] = _larger(el[r, k], w[r, k] / _larger(np.ones(len(r)), h[r, k]))
        out = {"x": x, "y": y, "w": w, "h": h, "score": score, "angle": angle, "line_height": lh, "elongation": el, "place": np.cumsum(joined, axis=1) - 1}
        return {c: {**g, **out}[c][joined] for c in (image, *_COLUMNS, "place")}

    return fold_groups(regions.select(image, *_COLUMNS), [image], ["region_no"], schema, rule, alike=True)


def _place(regions: DataFrame) -> Column:
    """A region's place among its image's: the one given to joined texts, or else its number."""
    return F.col("place" if "place" in regions.columns else "region_no").cast("int").alias("place")


def _similar(h: np.ndarray) -> np.ndarray:
    """How many heights of a row's group are within 20 % of its own, itself included."""
    if h.shape[1] <= 64:
        return sum((np.abs(h[:, j:j + 1] - h) <= h * SIMILAR).astype(int) for j in range(h.shape[1]))
    out = np.zeros(h.shape, int)
    for group, counts in zip(h, out):
        known = np.flatnonzero(np.isfinite(group) & (group >= 0))
        values, at, n = np.unique(group[known], return_inverse=True, return_counts=True)
        before = np.append(0, np.cumsum(n))
        # A little too wide, then drawn in to where the rule itself ends.
        lo = np.searchsorted(values, values * (1 - SIMILAR) * (1 - 1e-9))
        hi = np.searchsorted(values, values * (1 + SIMILAR) * (1 + 1e-9), side="right")
        far = lambda i: np.abs(values[i] - values) > values * SIMILAR
        while far(lo).any():
            lo += far(lo)
        while far(hi - 1).any():
            hi -= far(hi - 1)
        counts[known] = (before[hi] - before[lo])[at]
    return out


def mark_patterns(texts: DataFrame, image: str = "image_id", together: bool = False) -> DataFrame:
    """Texts of which at least three (itself included) have a height within 20 % of its own become a pattern.

    Images of one size are compared at once; an image with very many lines costs its distinct heights only.
    """
    schema = f"{image} {texts.schema[image].dataType.simpleString()}, {_FIELDS}, place int"

    def rule(g: Group) -> Group:
        kind = np.where(_similar(g["line_height"].astype(float)) >= PATTERN_LINES, "pattern", g["type"])
        return {c: v.ravel() for c, v in {**g, "type": kind}.items()}

    return fold_groups(texts.select(image, *_COLUMNS, _place(texts)), [image], [], schema, rule, together, alike=True)


def merge_overlays(texts: DataFrame, overlays: DataFrame, image: str = "image_id") -> DataFrame:
    """A mark around detected text becomes one logo region covering both; other overlays stay.

    Overlays take their first text in order; a text already grown is met as grown, so an image is walked.
    """
    both = texts.select(image, *_COLUMNS, _place(texts), F.lit(0).alias("_overlay")).unionByName(overlays.select(image, *_COLUMNS, _place(overlays), F.lit(1).alias("_overlay")))
    schema = f"{image} {texts.schema[image].dataType.simpleString()}, {_FIELDS}, place int"

    def rule(g: Group) -> Group:
        over = g["_overlay"] == 1
        x, y, w, h, angle, lh = (g[c].astype(float) for c in ("x", "y", "w", "h", "angle", "line_height"))
        kind = g["type"].copy()
        keep = ~over
        for i in np.flatnonzero(over.any(axis=0)):
            # Texts come before overlays.
            mine, one = np.flatnonzero(over[:, i]), slice(i, i + 1)
            tx, ty, tw, th = (v[mine, :i] for v in (x, y, w, h))
            ox, oy, ow, oh = (v[mine, one] for v in (x, y, w, h))
            wide = np.maximum(0, np.minimum(tx + tw, ox + ow) - np.maximum(tx, ox))
            tall = np.maximum(0, np.minimum(ty + th, oy + oh) - np.maximum(ty, oy))
            small = np.minimum(tw * th, ow * oh)
            fits = ~over[mine, :i] & (wide * tall / np.where(small == 0, 1.0, small) > OVERLAY_SHARE)
            found = fits.any(axis=1)
            keep[mine[~found], i] = True
            r = mine[found]
            k = np.argmax(fits[found], axis=1) if i else r
            right, bottom = _larger(x[r, k] + w[r, k], x[r, i] + w[r, i]), _larger(y[r, k] + h[r, k], y[r, i] + h[r, i])
            x[r, k], y[r, k] = _lesser(x[r, k], x[r, i]), _lesser(y[r, k], y[r, i])
            w[r, k], h[r, k], kind[r, k], angle[r, k], lh[r, k] = right - x[r, k], bottom - y[r, k], "logo", 0.0, math.inf
        out = {"type": kind, "x": x, "y": y, "w": w, "h": h, "angle": angle, "line_height": lh}
        return {c: {**g, **out}[c][keep] for c in (image, *_COLUMNS, "place")}

    return fold_groups(both, [image], ["_overlay", "place", "region_no"], schema, rule, alike=True)


def location_prior(width: Column, height: Column) -> Column:
    """Marks sit in corners, along the bottom or across the centre; other text sits anywhere."""
    b = box()
    corner = ((b.x / width < 0.22) | (b.right / width > 0.78)) & ((b.y / height < 0.22) | (b.bottom / height > 0.78))
    centre = (F.abs(b.centre_x / width - 0.5) < 0.15) & (F.abs(b.centre_y / height - 0.5) < 0.15)
    return F.when(corner | centre | (b.bottom / height > 0.85), 1.0).otherwise(0.75)


def score_detections(regions: DataFrame, width: Column, height: Column, image: str = "image_id", top: int = TOP) -> DataFrame:
    """Confidence from score, place, shape and angle; the best twelve of an image from 0.4 up, preselected from 0.6.

    Of equals, texts come before overlays, then by ``place``.
    """
    c = F.col("score") * location_prior(width, height)
    kind, angle = F.col("type"), F.abs(F.coalesce("angle", F.lit(0.0)))
    c = F.when(kind.isin("text", "pattern") & (F.coalesce("elongation", F.lit(3.0)) < 1.8), c * 0.6).otherwise(c)
    c = F.when((kind == "text") & (angle > 60), c * 0.8).otherwise(c)
    c = F.when(kind == "pattern", F.least(F.lit(1.0), c + 0.1)).otherwise(c)
    c = F.when(angle > 12, F.least(F.lit(1.0), c + 0.05)).otherwise(c)
    scored = regions.withColumn("_c", c).filter(F.col("_c") >= MIN_CONFIDENCE).withColumn("confidence", F.bround("_c", 3)).drop("_c")
    rank = F.row_number().over(Window.partitionBy(image).orderBy(F.desc("confidence"), (kind == "overlay").cast("int"), _place(regions), "region_no"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= top).withColumn("preselected", F.col("confidence") >= PRESELECT)
