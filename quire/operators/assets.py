"""File collections: real formats, admission, format choice, preset fit, savings, quality gates, names."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import units
from quire.plans.folds import Group, fold_groups
from quire.plans.segments import with_previous

# --- fixed values ---------------------------------------------------------------------------------
IMAGE_TYPES = ("image/jpeg", "image/png", "image/webp", "application/octet-stream")
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp")
PDF_TYPES = ("application/pdf", "application/octet-stream", "application/x-pdf", "")
MEGABYTE = 1024 * 1024
GRAPHIC_COLOURS = 400
CROP_WARNING = 0.25
UPSCALE_WARNING = 1.05
KEEP_BYTES = 400 * MEGABYTE
FACE = {"blurry": 40, "dark": 70, "bright": 215, "small": 90, "pose": 20, "roll": 2, "dominant": 0.4}
# --------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Limits:
    """What a collection accepts."""

    kind: str = "image"
    max_bytes: int = 10 * MEGABYTE
    max_pixels: int = 40_000_000
    max_files: int = 50
    max_total_bytes: int = 250 * MEGABYTE


def sniffed_format(content: Column) -> Column:
    """The format the leading bytes show, whatever the name says; null when none is known."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("89504E470D0A1A0A"), "png")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp")
        # Junk before the mark is tolerated within the first 1024 bytes; hex pairs stay aligned.
        .when(F.hex(F.substring(content, 1, 1024)).rlike("^(?:..)*?255044462D"), "pdf")
    )


def with_format(files: DataFrame, content: str = "content") -> DataFrame:
    """The manifest keeps the format and the length, and lets the bytes go before any shuffle."""
    return files.withColumn("format", sniffed_format(F.col(content))).drop(content)


def admit(manifest: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Each file with its first reason for refusal (null: accepted)."""
    extension = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    if limits.kind == "pdf":
        claimed = (extension == ".pdf") & F.col("claimed_type").isin(*PDF_TYPES)
        real = F.col("format") == "pdf"
        too_large = F.lit(False)
    else:
        claimed = extension.isin(*IMAGE_EXTENSIONS) & F.col("claimed_type").isin(*IMAGE_TYPES)
        real = F.col("format").isin("jpeg", "png", "webp")
        too_large = F.col("width").cast("long") * F.col("height") > limits.max_pixels
    unreadable = F.coalesce(F.col("width") <= 0, F.lit(True)) | F.coalesce(F.col("height") <= 0, F.lit(True))
    reason = (
        F.when(F.col("size") == 0, "FILE_REQUIRED").when(F.col("size") > limits.max_bytes, "FILE_TOO_LARGE")
        .when(~claimed, "UNSUPPORTED_MEDIA_TYPE").when(~F.coalesce(real, F.lit(False)), "UNSUPPORTED_MEDIA_TYPE" if limits.kind == "image" else "INVALID_PDF")
    )
    if limits.kind == "image":
        reason = reason.when(too_large, "IMAGE_TOO_LARGE").when(unreadable, "INVALID_IMAGE")
    return manifest.withColumn("reason", reason)


def gate_requests(manifest: DataFrame, limits: Limits = Limits(), minimum: int = 1) -> DataFrame:
    """Files and bytes per request against the limits."""
    g = manifest.groupBy("request_id").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
    reason = F.when(F.col("files") > limits.max_files, "TOO_MANY_FILES").when(F.col("bytes") > limits.max_total_bytes, "FILE_TOO_LARGE").when(F.col("files") < minimum, "FILE_REQUIRED")
    return g.withColumn("reason", reason)


def choose_format(manifest: DataFrame, requested: str = "auto") -> DataFrame:
    """The output format: the one asked for, else by transparency and number of colours."""
    auto = F.when(F.col("transparent"), "webp").when(F.col("colours") <= GRAPHIC_COLOURS, "png").when(F.col("format") == "webp", "webp").otherwise("jpeg")
    return manifest.withColumn("output", auto if requested == "auto" else F.lit(requested))


def preset_fit(assets: DataFrame, presets: DataFrame, mode: str = "fill") -> DataFrame:
    """Every asset against every preset: scale, share cropped, and warnings.

    The presets are the fixed table of a few dozen rows; the product is the result asked for.
    """
    if mode not in ("fill", "fit"):
        raise ValueError(f"unknown mode: {mode}")
    pairs = assets.crossJoin(F.broadcast(presets))
    sx, sy = F.col("target_w") / F.col("width"), F.col("target_h") / F.col("height")
    pairs = pairs.withColumn("scale", F.greatest(sx, sy) if mode == "fill" else F.least(sx, sy))
    cut = lambda target, side: F.greatest(F.lit(0.0), 1 - F.col(target) / F.col("scale") / F.col(side))
    worst = F.greatest(cut("target_w", "width"), cut("target_h", "height"))
    pairs = pairs.withColumn("cropped", worst)
    return pairs.withColumn("crop_warning", F.when(worst > CROP_WARNING, units.rounded(worst * 100))).withColumn("upscale", F.when(F.col("scale") > UPSCALE_WARNING, units.rounded(F.col("scale") * 10) / 10))


def savings(results: DataFrame, by: list[str]) -> DataFrame:
    """Bytes saved per group. A result not smaller than its original is not used: the original stands."""
    kept = F.least("original_size", "size")
    g = results.filter("status = 'done'").groupBy(*by).agg(
        F.count(F.lit(1)).alias("items"), F.sum("original_size").alias("original"), F.sum(kept).alias("result"), F.count_if(F.col("size") >= F.col("original_size")).alias("already_optimal"))
    saved = F.greatest(F.lit(0), F.col("original") - F.col("result"))
    return g.withColumn("saved", saved).withColumn("percent", units.rounded(saved / F.greatest(F.lit(1), F.col("original")) * 100))


CHECKS = ("aspectRatio", "dimensions", "dpi", "whiteBackground", "headVisible", "headSize", "centered", "notStretched")


def quality_report(photos: DataFrame, presets: DataFrame) -> DataFrame:
    """Finished photos against their preset: the named checks, and whether all hold."""
    p = photos.join(F.broadcast(presets), "preset")
    w, h = units.mm_to_pixels(F.col("width_mm"), F.col("preset_dpi")), units.mm_to_pixels(F.col("height_mm"), F.col("preset_dpi"))
    ratio, share = w / h, (F.col("chin_y") - F.col("crown_y")) / F.col("crop_h")
    tests = {
        "aspectRatio": F.abs(F.col("width") / F.col("height") - ratio) < 0.005,
        "dimensions": (F.col("width") == w) & (F.col("height") == h),
        "dpi": units.rounded(F.col("dpi")) == F.col("preset_dpi"),
        "whiteBackground": F.col("white_share") >= 0.9,
        "headVisible": (F.col("crown_y") - F.col("crop_y") >= F.col("crop_h") * 0.01) & (F.col("chin_y") <= F.col("crop_y") + F.col("crop_h")),
        "headSize": (share >= F.col("head_low")) & (share <= F.col("head_high")),
        "centered": F.abs(F.col("center_x") - (F.col("crop_x") + F.col("crop_w") / 2)) <= F.col("crop_w") * 0.05,
        "notStretched": F.abs(F.col("crop_w") / F.col("crop_h") / ratio - 1) < 0.01,
    }
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in tests.items()]))
    return p.withColumn("failed", failed).withColumn("ready", F.size("failed") == 0)


def head_crop(crown_y: Column, chin_y: Column, center_x: Column, preset: dict[str, Column]) -> Column:
    """The crop that gives the head its share of the preset's frame."""
    height = F.greatest(F.lit(1.0), chin_y - crown_y) / preset["head_height"]
    width = height * (preset["width_mm"] / preset["height_mm"])
    return F.struct((center_x - width / 2).alias("x"), (crown_y - preset["crown_margin"] * height).alias("y"), width.alias("w"), height.alias("h"))


def face_warnings(sharpness: Column, brightness: Column, height: Column, yaw: Column, pitch: Column, roll: Column) -> Column:
    turned = F.coalesce((F.abs(yaw) > FACE["pose"]) | (F.abs(pitch) > FACE["pose"]), F.lit(False))
    return F.array_compact(F.array(
        F.when(sharpness < FACE["blurry"], "BLURRY"), F.when(brightness < FACE["dark"], "TOO_DARK").when(brightness > FACE["bright"], "TOO_BRIGHT"),
        F.when(height < FACE["small"], "SMALL_FACE"), F.when(turned, "NOT_FACING"), F.when(F.abs(roll) > FACE["roll"], "HEAD_TILTED")))


def dominant(images: DataFrame, faces: DataFrame, image: str = "image_id", order: str = "face_no") -> DataFrame:
    """The face a photo is of: its first, refused when the second's area is at least 40 % of it, or without a face."""
    two = faces.filter(F.col(order) <= 1).groupBy(image).agg(
        F.max(F.when(F.col(order) == 0, F.col("w") * F.col("h"))).alias("_first"), F.max(F.when(F.col(order) == 1, F.col("w") * F.col("h"))).alias("_second"))
    verdict = F.when(F.col("_first").isNull(), "NO_FACE").when(F.col("_second") >= F.col("_first") * FACE["dominant"], "MULTIPLE_FACES")
    return images.join(two, image, "left").withColumn("problem", verdict).withColumn("face_no", F.when(verdict.isNull(), 0)).drop("_first", "_second")


def match_detections(expected: DataFrame, found: DataFrame, image: str = "image_id", ident: str = "face_no") -> DataFrame:
    """Each expected object with the first found one whose centre is within half its width.

    Centres meet on cells as wide as the largest reach of their power of two, so one crowded image is not
    compared pair by pair.
    """
    cx, cy = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2
    level = F.ceil(F.log2(F.greatest(F.col("w") * 0.5, F.lit(1.0)))).cast("int")
    e = expected.select(image, ident, "w", cx.alias("cx"), cy.alias("cy"), level.alias("level"))
    levels = e.select(image, "level").distinct()
    side = F.pow(F.lit(2.0), F.col("level"))
    near = F.explode(F.array(*[F.struct((F.floor(F.col("cx") / side) + dx).alias("gx"), (F.floor(F.col("cy") / side) + dy).alias("gy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]))
    wanted = e.withColumn("g", near).select("*", "g.gx", "g.gy").drop("g")
    there = found.select(image, F.col(ident).alias("match"), cx.alias("mx"), cy.alias("my")).join(levels, image).withColumn("gx", F.floor(F.col("mx") / side)).withColumn("gy", F.floor(F.col("my") / side))
    pairs = wanted.join(there, [image, "level", "gx", "gy"]).filter(F.hypot(F.col("mx") - F.col("cx"), F.col("my") - F.col("cy")) < F.col("w") * 0.5)
    first = pairs.groupBy(image, ident).agg(F.min("match").alias("match"))
    return expected.join(first, [image, ident], "left")


def retain(entries: DataFrame, now: Column, budget: int = KEEP_BYTES) -> DataFrame:
    """Entries kept: not expired, and of those the newest while they fit the budget (the newest always).

    The running total goes hour by hour: windows per hour, and one carried total per hour.
    """
    live = entries.filter(F.col("expires_at") > now)
    age = live.withColumn("_age", -F.unix_micros("created_at"))
    held = with_previous(age, [], ["_age", "id"], F.floor(F.col("_age") / 3_600_000_000), {"_before": ("sum", F.col("bytes"))})
    return held.filter((F.col("_before") == 0) | (F.col("_before") + F.col("bytes") <= budget)).drop("_age", "_before")


def unique_names(files: DataFrame, group: str, name: str, order: str) -> DataFrame:
    """Output names of a group without collisions: a name already used gets -2, -3, … before its extension.

    Names can only collide within a family: the stem without its trailing numbers, and the extension. In
    a family with one spelling the nth copy is simply numbered, by carried counts, however many files
    share it. Only families that mix spellings (a.pdf and a-2.pdf) depend on order and are walked.
    """
    ext = F.regexp_extract(name, r"(\.[^.]*)$", 1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    rows = files.withColumn("_stem", stem).withColumn("_ext", ext).withColumn("_root", F.regexp_replace("_stem", r"(?:-\d+)+$", ""))
    family = [group, "_root", "_ext"]
    spellings = rows.groupBy(*family, name).agg(F.lit(1).alias("_one")).groupBy(*family).agg(F.count(F.lit(1)).alias("_spellings"))
    rows = rows.join(spellings, family)
    plain = with_previous(rows.filter("_spellings = 1"), family, [order], F.floor(F.col(order) / 4096), {"_n": ("sum", F.lit(1))})
    numbered = F.when(F.col("_n") == 0, F.col(name)).otherwise(F.concat("_stem", F.lit("-"), (F.col("_n") + 1).cast("string"), "_ext"))
    plain = plain.withColumn("unique_name", numbered).select(*files.columns, "unique_name")
    mixed = rows.filter("_spellings > 1").select(*files.columns, "_stem", "_ext", "_root")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema) + ", unique_name string"
    columns = files.columns

    def rule(g: Group) -> Group:
        used: set[str] = set()
        following: dict[str, int] = {}
        out = []
        for full, s, e in zip(g[name], g["_stem"], g["_ext"]):
            chosen = full
            if full in used:
                n = following.get(full, 2)
                while f"{s}-{n}{e}" in used:
                    n += 1
                chosen, following[full] = f"{s}-{n}{e}", n + 1
            used.add(chosen)
            out.append(chosen)
        return {**{c: g[c] for c in columns}, "unique_name": np.array(out, dtype=object)}

    return plain.unionByName(fold_groups(mixed, family, [order], schema, rule))
