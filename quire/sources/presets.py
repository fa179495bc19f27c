"""Fixed dimension tables: sizes that sites and papers ask for. A few dozen rows, so always broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- fixed values: id, width, height ---------------------------------------------------------------
SOCIAL = (
    ("instagram-square", 1080, 1080), ("instagram-portrait", 1080, 1350), ("instagram-landscape", 1080, 566), ("instagram-story", 1080, 1920),
    ("instagram-reel", 1080, 1920), ("instagram-profile", 320, 320), ("facebook-square", 1080, 1080), ("facebook-portrait", 1080, 1350),
    ("facebook-landscape", 1080, 566), ("facebook-cover", 851, 315), ("facebook-story", 1080, 1920), ("facebook-event", 1920, 1005),
    ("facebook-profile", 320, 320), ("linkedin-shared", 1200, 627), ("linkedin-square", 1080, 1080), ("linkedin-portrait", 1080, 1350),
    ("linkedin-banner", 1584, 396), ("linkedin-company", 1512, 256), ("linkedin-profile", 400, 400), ("youtube-thumbnail", 1280, 720),
    ("youtube-thumbnail-4k", 3840, 2160), ("youtube-banner", 2560, 1440), ("youtube-short", 1080, 1920), ("youtube-profile", 800, 800),
    ("tiktok-video", 1080, 1920), ("tiktok-profile", 200, 200),
)
# id, width mm, height mm, dpi, head share of the height, crown margin, accepted head share
PHOTOS = (
    ("passport", 1.1 * 25.4, 1.322 * 25.4, 300, 0.74, 0.09, 0.66, 0.82),
    ("mrp", 35.0, 45.0, 600, 0.74, 0.09, 0.66, 0.82),
)
# ----------------------------------------------------------------------------------------------------


def social_presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SOCIAL), "preset string, target_w int, target_h int")


def photo_presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PHOTOS), "preset string, width_mm double, height_mm double, preset_dpi int, head_height double, crown_margin double, head_low double, head_high double")
