"""Files, faces, photos and detections derived from pages, line items, orders and customers."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions import units
from quire.operators import assets, detections
from quire.sources import presets
from quire.sources.tables import events, spread, table

EXTENSIONS = (".jpg", ".png", ".webp", ".pdf", ".gif", ".jpeg", ".PNG")
TYPES = ("image/jpeg", "image/png", "image/webp", "application/octet-stream", "text/html")
HEADS = ("FFD8FFE0", "89504E470D0A1A0A", "524946460000000057454250", "255044462D312E34", "47494638", "3C21255044462D")
LIMITS = assets.Limits(max_files=18, max_total_bytes=30 * assets.MEGABYTE)


def _pick(values, n):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


def _manifest(spark, d):
    n = F.col("page_id")
    files = spread(table(spark, d, "pages", "page_id", "html"), "page_id").select(
        "page_id", F.floor(n / 20).alias("request_id"), F.concat(F.lit("uploads/"), n.cast("string"), _pick(EXTENSIONS, n)).alias("path"), _pick(TYPES, n).alias("claimed_type"),
        F.when(n % 17 == 3, 0).when(n % 17 == 4, 11 * assets.MEGABYTE).otherwise(F.octet_length("html")).cast("long").alias("size"),
        F.concat(F.unhex(_pick(HEADS, n)), F.encode("html", "utf-8")).alias("content"),
        F.when(n % 23 == 5, 9000).otherwise(300 + n * 37 % 3000).cast("int").alias("width"), F.when(n % 23 == 5, 6000).otherwise(200 + n * 53 % 2500).cast("int").alias("height"),
        (n % 4 == 1).alias("transparent"), (n * 91 % 1000).alias("colours"))
    return assets.with_format(files)


def asset_manifest(spark, d):
    return _manifest(spark, d).select("page_id", "format", "size")


def admission(spark, d):
    return assets.admit(_manifest(spark, d)).select("page_id", "reason")


def admission_pdf(spark, d):
    return assets.admit(_manifest(spark, d), assets.Limits(kind="pdf", max_bytes=100 * assets.MEGABYTE)).select("page_id", "reason")


def request_gate(spark, d):
    return assets.gate_requests(_manifest(spark, d), LIMITS)


def format_choice(spark, d):
    return assets.choose_format(_manifest(spark, d)).select("page_id", "output")


def preset_fit(spark, d):
    out = assets.preset_fit(_manifest(spark, d).select("page_id", "width", "height"), presets.social_presets(spark))
    return out.select("page_id", "preset", F.round("scale", 6).alias("scale"), F.round("cropped", 6).alias("cropped"), "crop_warning", "upscale")


def preset_contain(spark, d):
    out = assets.preset_fit(_manifest(spark, d).select("page_id", "width", "height"), presets.social_presets(spark), "fit")
    return out.groupBy("preset").agg(F.count("upscale").alias("upscaled"), F.round(F.max("scale"), 6).alias("largest"))


def ratio_labels(spark, d):
    return _manifest(spark, d).select("page_id", units.ratio_label(F.col("width"), F.col("height")).alias("ratio"), units.custom_size_problem(F.col("width"), F.col("height")).alias("problem"))


def page_placement(spark, d):
    p = units.placement(F.col("width"), F.col("height"), F.lit(595.28), F.lit(841.89), 10, "contain")
    out = _manifest(spark, d).select("page_id", p.alias("p"))
    return out.select("page_id", *[F.round(f"p.{c}", 4).alias(c) for c in ("page_w", "page_h", "x", "y", "w", "h")])


def sheet_capacity(spark, d):
    """Copies of a photo as wide as a part's size on an A4 sheet."""
    parts = table(spark, d, "part", "p_partkey", "p_size")
    c = units.sheet_capacity(F.lit(210.0), F.lit(297.0), F.lit(10.0), F.lit(4.0), F.col("p_size") + 10.0, (F.col("p_size") + 10) * 1.25)
    return parts.select("p_partkey", c.alias("c")).select("p_partkey", "c.*")


def _results(spark, d):
    return table(spark, d, "lineitem", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount").select(
        "l_returnflag", (F.col("l_extendedprice") * 10).cast("long").alias("original_size"), (F.col("l_extendedprice") * 10 * (0.4 + F.col("l_discount") * 7)).cast("long").alias("size"),
        F.when(F.col("l_linestatus") == "F", "done").otherwise("error").alias("status"))


def savings(spark, d):
    return assets.savings(_results(spark, d), ["l_returnflag"])


_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


def _faces(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy(*_ORDER)
    li = table(spark, d, "lineitem", "l_orderkey", *_ORDER, "l_discount", "l_tax").withColumn("face_no", (F.row_number().over(w) - 1).cast("int"))
    return li.select(
        F.col("l_orderkey").alias("image_id"), "face_no", (F.col("l_partkey") % 40 * 10.0).alias("x"), (F.col("l_suppkey") % 25 * 12.0).alias("y"), (F.col("l_quantity") * 3 + 20).alias("w"), (F.col("l_quantity") * 4 + 20).alias("h"),
        (F.col("l_discount") * 1000).alias("sharpness"), (F.col("l_quantity") * 5).alias("brightness"), ((F.col("l_tax") * 100 - 4) * 8).alias("yaw"), ((F.col("l_discount") * 100 - 5) * 5).alias("pitch"), (F.col("l_tax") * 100 - 4).alias("roll"))


def face_warnings(spark, d):
    f = _faces(spark, d)
    w = assets.face_warnings(F.col("sharpness"), F.col("brightness"), F.col("h"), F.col("yaw"), F.col("pitch"), F.col("roll"))
    return f.select("image_id", "face_no", F.array_join(w, ",").alias("warnings"))


def dominant_face(spark, d):
    images = table(spark, d, "orders", "o_orderkey").select(F.col("o_orderkey").alias("image_id"))
    return assets.dominant(images, _faces(spark, d))


def match_faces(spark, d):
    f = _faces(spark, d)
    moved = f.withColumn("x", F.col("x") + F.col("roll") * 6).withColumn("y", F.col("y") - F.col("roll") * 5)
    return assets.match_detections(f, moved).select("image_id", "face_no", "match")


def _photos(spark, d):
    n = F.col("c_custkey")
    c = table(spark, d, "customer", "c_custkey", "c_acctbal", "c_nationkey")
    mrp = n % 2 == 1
    w, h = F.when(mrp, 827).otherwise(330), F.when(mrp, 1063).otherwise(397)
    crop_h = 500.0 + n % 7 * 10
    return c.select(
        "c_custkey", F.when(mrp, "mrp").otherwise("passport").alias("preset"), (w + F.when(n % 11 == 0, 1).otherwise(0)).alias("width"), h.alias("height"), F.when(n % 13 == 0, 72.0).when(mrp, 600.0).otherwise(300.0).alias("dpi"),
        (100.0 + n % 5).alias("crown_y"), (100.0 + n % 5 + crop_h * (0.6 + n % 30 / 100)).alias("chin_y"), (250.0 + n % 9 * 5).alias("center_x"), F.lit(50.0).alias("crop_x"), (90.0 - n % 3 * 10).alias("crop_y"),
        (crop_h * w / h).alias("crop_w"), crop_h.alias("crop_h"), (F.abs("c_acctbal") % 1000 / 1000).alias("white_share"))


def quality_report(spark, d):
    out = assets.quality_report(_photos(spark, d), presets.photo_presets(spark))
    return out.select("c_custkey", F.array_join("failed", ",").alias("failed"), "ready")


def head_crops(spark, d):
    p = _photos(spark, d).join(F.broadcast(presets.photo_presets(spark)), "preset")
    crop = assets.head_crop(F.col("crown_y"), F.col("chin_y"), F.col("center_x"), {c: F.col(c) for c in ("head_height", "width_mm", "height_mm", "crown_margin")})
    return p.select("c_custkey", crop.alias("c")).select("c_custkey", *[F.round(f"c.{k}", 4).alias(k) for k in ("x", "y", "w", "h")])


def retained_entries(spark, d):
    e = events(spark, d, "event_id", "ts", "value")
    entries = e.select(F.col("event_id").alias("id"), (F.col("value") * 10000).cast("long").alias("bytes"), F.col("ts").alias("created_at"), (F.col("ts") + F.make_interval(days=(F.col("event_id") % 60).cast("int"))).alias("expires_at"))
    return assets.retain(entries, F.lit("2024-01-20 00:00:00Z").cast("timestamp")).select("id", "bytes")


def unique_names(spark, d):
    docs = table(spark, d, "documents", "doc_id", "lang", "source")
    n = F.col("doc_id")
    files = docs.select("lang", "doc_id", F.concat("source", F.when(n % 9 == 4, "-2").when(n % 9 == 7, "-3").otherwise(""), F.lit(".pdf")).alias("name"))
    return assets.unique_names(files, "lang", "name", "doc_id")


def _regions(spark, d):
    f = table(spark, d, "lineitem", "l_orderkey", *_ORDER, "l_discount", "l_tax", "l_returnflag")
    w = Window.partitionBy("l_orderkey").orderBy(*_ORDER)
    h = 10 + F.round(F.col("l_tax") * 100) * 4
    return f.withColumn("region_no", (F.row_number().over(w) - 1).cast("int")).select(
        F.col("l_orderkey").alias("image_id"), "region_no", F.when(F.col("l_returnflag") == "R", "overlay").otherwise("text").alias("type"), (0.3 + F.round(F.col("l_discount") * 100) * 0.0713).alias("score"),
        (F.col("l_partkey") % 40 * 16.0).alias("x"), (F.col("l_suppkey") % 10 * 50.0).alias("y"), (F.col("l_quantity") * 6).alias("w"), h.alias("h"), ((F.col("l_linenumber") - 4) * 6.0).alias("angle"), h.alias("line_height"), (F.col("l_quantity") * 6 / h).alias("elongation"))


def joined_text_regions(spark, d):
    return detections.join_text_regions(_regions(spark, d).filter("type = 'text'")).select("image_id", "region_no", "x", "y", "w", "h", F.round("score", 6).alias("score"))


def pattern_texts(spark, d):
    return detections.mark_patterns(_regions(spark, d).filter("type = 'text'")).select("image_id", "region_no", "type")


def merged_overlays(spark, d):
    r = _regions(spark, d)
    return detections.merge_overlays(r.filter("type = 'text'"), r.filter("type = 'overlay'")).select("image_id", "region_no", "type", "x", "y", "w", "h")


def scored_detections(spark, d):
    return detections.score_detections(_regions(spark, d), F.lit(800.0), F.lit(600.0)).select("image_id", "region_no", "confidence", "rank", "preselected")


QUERIES = {f.__name__: f for f in (
    asset_manifest, admission, admission_pdf, request_gate, format_choice, preset_fit, preset_contain, ratio_labels, page_placement, sheet_capacity, savings, face_warnings, dominant_face, match_faces,
    quality_report, head_crops, retained_entries, unique_names, joined_text_regions, pattern_texts, merged_overlays, scored_detections)}

_LIST = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
_FILES = f"""f0 AS (SELECT page_id, page_id // 20 AS request_id, '{{}}' AS x, {_LIST(EXTENSIONS)}[page_id % 7 + 1] AS ext, {_LIST(TYPES)}[page_id % 5 + 1] AS claimed,
  CASE WHEN page_id % 17 = 3 THEN 0 WHEN page_id % 17 = 4 THEN {11 * assets.MEGABYTE} ELSE octet_length(encode(html)) END::BIGINT AS size, {_LIST(HEADS)}[page_id % 6 + 1] || hex(encode(html)) AS hx,
  CASE WHEN page_id % 23 = 5 THEN 9000 ELSE 300 + page_id * 37 % 3000 END AS width, CASE WHEN page_id % 23 = 5 THEN 6000 ELSE 200 + page_id * 53 % 2500 END AS height, page_id % 4 = 1 AS transparent, page_id * 91 % 1000 AS colours FROM pages),
fi AS (SELECT *, CASE WHEN starts_with(hx, 'FFD8FF') THEN 'jpeg' WHEN starts_with(hx, '89504E470D0A1A0A') THEN 'png' WHEN starts_with(hx, '52494646') AND substr(hx, 17, 8) = '57454250' THEN 'webp' WHEN regexp_matches(left(hx, 2048), '^(..)*255044462D') THEN 'pdf' END AS format FROM f0)""".replace("'{}' AS x, ", "")
_PRESETS = "ps(preset, tw, th) AS (VALUES " + ", ".join(f"('{i}', {w}, {h})" for i, w, h in presets.SOCIAL) + ")"
_FACES = f"""fc AS (SELECT l_orderkey AS image_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_ORDER)}) - 1)::INT AS face_no, (l_partkey % 40 * 10)::DOUBLE AS x, (l_suppkey % 25 * 12)::DOUBLE AS y, l_quantity * 3 + 20 AS w, l_quantity * 4 + 20 AS h,
  l_discount * 1000 AS sharpness, l_quantity * 5 AS brightness, (l_tax * 100 - 4) * 8 AS yaw, (l_discount * 100 - 5) * 5 AS pitch, l_tax * 100 - 4 AS roll FROM lineitem)"""
_PHOTOS = """ph AS (SELECT c_custkey, c_custkey % 2 = 1 AS mrp, CASE WHEN c_custkey % 2 = 1 THEN 827 ELSE 330 END AS tw, CASE WHEN c_custkey % 2 = 1 THEN 1063 ELSE 397 END AS th, (500 + c_custkey % 7 * 10)::DOUBLE AS crop_h, (100 + c_custkey % 5)::DOUBLE AS crown, (250 + c_custkey % 9 * 5)::DOUBLE AS cx,
  CASE WHEN c_custkey % 13 = 0 THEN 72 WHEN c_custkey % 2 = 1 THEN 600 ELSE 300 END AS dpi, abs(c_acctbal) % 1000 / 1000 AS white FROM customer),
pj AS (SELECT *, tw + (c_custkey % 11 = 0)::INT AS width, CASE WHEN mrp THEN 600 ELSE 300 END AS pdpi, crown + crop_h * (0.6::DOUBLE + c_custkey % 30 / 100) AS chin, crop_h * tw / th AS crop_w, (90 - c_custkey % 3 * 10)::DOUBLE AS crop_y FROM ph)"""
_REG = f"""rg AS (SELECT l_orderkey AS image_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_ORDER)}) - 1)::INT AS region_no, CASE WHEN l_returnflag = 'R' THEN 'overlay' ELSE 'text' END AS type, 0.3::DOUBLE + round(l_discount * 100) * 0.0713::DOUBLE AS score,
  (l_partkey % 40 * 16)::DOUBLE AS x, (l_suppkey % 10 * 50)::DOUBLE AS y, l_quantity * 6 AS w, 10 + round(l_tax * 100) * 4 AS h, ((l_linenumber - 4) * 6)::DOUBLE AS angle FROM lineitem)"""
# An overlay takes its first text; each step of the walk meets the texts as grown so far.
_NAMES = """WITH RECURSIVE fl AS (SELECT lang, doc_id, source || CASE WHEN doc_id % 9 = 4 THEN '-2' WHEN doc_id % 9 = 7 THEN '-3' ELSE '' END || '.pdf' AS name, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents),
w AS (SELECT lang, 0::BIGINT AS k, 0::BIGINT AS doc_id, '' AS name, '' AS un, []::VARCHAR[] AS used FROM fl GROUP BY lang
  UNION ALL SELECT s.lang, s.k, s.doc_id, s.name, s.un, list_append(s.used, s.un) FROM (SELECT fl.lang, fl.k, fl.doc_id, fl.name, w.used, CASE WHEN list_contains(w.used, fl.name) THEN list_filter(list_transform(range(2, len(w.used) + 3), lambda c: regexp_replace(fl.name, '(\\.[^.]*)?$', '-' || c || '.pdf')), lambda v: NOT list_contains(w.used, v))[1] ELSE fl.name END AS un FROM w JOIN fl ON fl.lang = w.lang AND fl.k = w.k + 1) s)
SELECT lang, doc_id, name, un AS unique_name FROM w WHERE k > 0"""

ORACLE = {
    "asset_manifest": f"WITH {_FILES} SELECT page_id, format, size FROM fi",
    "admission": f"WITH {_FILES} SELECT page_id, CASE WHEN size = 0 THEN 'FILE_REQUIRED' WHEN size > 10485760 THEN 'FILE_TOO_LARGE' WHEN lower(ext) NOT IN ('.jpg', '.jpeg', '.png', '.webp') OR claimed = 'text/html' OR coalesce(format, '') NOT IN ('jpeg', 'png', 'webp') THEN 'UNSUPPORTED_MEDIA_TYPE' WHEN width * height > 40000000 THEN 'IMAGE_TOO_LARGE' END AS reason FROM fi",
    "admission_pdf": f"WITH {_FILES} SELECT page_id, CASE WHEN size = 0 THEN 'FILE_REQUIRED' WHEN ext <> '.pdf' OR claimed <> 'application/octet-stream' THEN 'UNSUPPORTED_MEDIA_TYPE' WHEN coalesce(format, '') <> 'pdf' THEN 'INVALID_PDF' END AS reason FROM fi",
    "request_gate": f"WITH {_FILES}, g AS (SELECT request_id, count(*) AS files, sum(size)::BIGINT AS bytes FROM fi GROUP BY ALL) SELECT *, CASE WHEN files > 18 THEN 'TOO_MANY_FILES' WHEN bytes > 31457280 THEN 'FILE_TOO_LARGE' END AS reason FROM g",
    "format_choice": f"WITH {_FILES} SELECT page_id, CASE WHEN transparent THEN 'webp' WHEN colours <= 400 THEN 'png' WHEN format = 'webp' THEN 'webp' ELSE 'jpeg' END AS output FROM fi",
    "preset_fit": f"WITH {_FILES}, {_PRESETS}, s AS (SELECT page_id, preset, width, height, tw, th, greatest(tw / width, th / height) AS scale FROM fi, ps), c AS (SELECT *, greatest(0, 1 - tw / scale / width, 1 - th / scale / height) AS cropped FROM s) SELECT page_id, preset, round(scale, 6) AS scale, round(cropped, 6) AS cropped, CASE WHEN cropped > 0.25 THEN floor(cropped * 100 + 0.5)::BIGINT END AS crop_warning, CASE WHEN scale > 1.05 THEN floor(scale * 10 + 0.5) / 10 END AS upscale FROM c",
    "preset_contain": f"WITH {_FILES}, {_PRESETS}, s AS (SELECT preset, least(tw / width, th / height) AS scale FROM fi, ps) SELECT preset, count(*) FILTER (scale > 1.05) AS upscaled, round(max(scale), 6) AS largest FROM s GROUP BY preset",
    "ratio_labels": f"WITH {_FILES}, r AS (SELECT page_id, width, height, gcd(width, height) AS d FROM fi) SELECT page_id, CASE WHEN width / d <= 32 AND height / d <= 32 THEN (width // d) || ':' || (height // d) WHEN width >= height THEN regexp_replace(printf('%.2f', width / height), '0$', '') || ':1' ELSE '1:' || regexp_replace(printf('%.2f', height / width), '0$', '') END AS ratio, CASE WHEN width > 8192 OR height > 8192 THEN 'tooLarge' WHEN width * height > 40000000 THEN 'tooManyPixels' END AS problem FROM r",
    "page_placement": f"WITH {_FILES}, p AS (SELECT page_id, width * 0.75::DOUBLE AS nw, height * 0.75::DOUBLE AS nh, CASE WHEN width > height THEN 841.89 ELSE 595.28 END::DOUBLE AS pw, CASE WHEN width > height THEN 595.28 ELSE 841.89 END::DOUBLE AS ph, 720 / 25.4::DOUBLE AS m FROM fi), s AS (SELECT *, least((pw - 2 * m) / nw, (ph - 2 * m) / nh) AS k FROM p) SELECT page_id, round(pw, 4) AS page_w, round(ph, 4) AS page_h, round(m + (pw - 2 * m - nw * k) / 2, 4) AS x, round(m + (ph - 2 * m - nh * k) / 2, 4) AS y, round(nw * k, 4) AS w, round(nh * k, 4) AS h FROM s",
    "sheet_capacity": "WITH c AS (SELECT p_partkey, floor(194 / (p_size + 14.0::DOUBLE))::BIGINT AS columns, floor(281 / ((p_size + 10) * 1.25::DOUBLE + 4))::BIGINT AS rows FROM part) SELECT *, columns * rows AS copies FROM c",
    "savings": """WITH r AS (SELECT l_returnflag, trunc(l_extendedprice * 10)::BIGINT AS o, trunc(l_extendedprice * 10 * (0.4::DOUBLE + l_discount * 7))::BIGINT AS s FROM lineitem WHERE l_linestatus = 'F'),
g AS (SELECT l_returnflag, count(*) AS items, sum(o)::BIGINT AS original, sum(least(o, s))::BIGINT AS result, count(*) FILTER (s >= o) AS already_optimal FROM r GROUP BY ALL)
SELECT *, original - result AS saved, floor((original - result) / original * 100 + 0.5)::BIGINT AS percent FROM g""",
    "face_warnings": f"WITH {_FACES} SELECT image_id, face_no, array_to_string(list_filter([CASE WHEN sharpness < 40 THEN 'BLURRY' END, CASE WHEN brightness < 70 THEN 'TOO_DARK' WHEN brightness > 215 THEN 'TOO_BRIGHT' END, CASE WHEN h < 90 THEN 'SMALL_FACE' END, CASE WHEN abs(yaw) > 20 OR abs(pitch) > 20 THEN 'NOT_FACING' END, CASE WHEN abs(roll) > 2 THEN 'HEAD_TILTED' END], lambda v: v IS NOT NULL), ',') AS warnings FROM fc",
    "dominant_face": f"WITH {_FACES}, t AS (SELECT image_id, max(w * h) FILTER (face_no = 0) AS a, max(w * h) FILTER (face_no = 1) AS b FROM fc GROUP BY ALL), v AS (SELECT o_orderkey AS image_id, CASE WHEN a IS NULL THEN 'NO_FACE' WHEN b >= a * 0.4::DOUBLE THEN 'MULTIPLE_FACES' END AS problem FROM orders LEFT JOIN t ON image_id = o_orderkey) SELECT *, CASE WHEN problem IS NULL THEN 0 END AS face_no FROM v",
    "match_faces": f"WITH {_FACES} SELECT e.image_id, e.face_no, min(f.face_no) AS match FROM fc e LEFT JOIN fc f ON f.image_id = e.image_id AND sqrt(power(f.x + f.roll * 6 + f.w / 2 - e.x - e.w / 2, 2) + power(f.y - f.roll * 5 + f.h / 2 - e.y - e.h / 2, 2)) < e.w * 0.5 GROUP BY ALL",
    "quality_report": f"""WITH {_PHOTOS}, q AS (SELECT c_custkey, [CASE WHEN abs(width / th - tw / th) >= 0.005 THEN 'aspectRatio' END, CASE WHEN width <> tw THEN 'dimensions' END, CASE WHEN dpi <> pdpi THEN 'dpi' END, CASE WHEN white < 0.9 THEN 'whiteBackground' END,
  CASE WHEN NOT (crown - crop_y >= crop_h * 0.01::DOUBLE AND chin <= crop_y + crop_h) THEN 'headVisible' END, CASE WHEN NOT ((chin - crown) / crop_h BETWEEN 0.66::DOUBLE AND 0.82::DOUBLE) THEN 'headSize' END, CASE WHEN abs(cx - (50 + crop_w / 2)) > crop_w * 0.05::DOUBLE THEN 'centered' END, CASE WHEN abs(crop_w / crop_h / (tw / th) - 1) >= 0.01 THEN 'notStretched' END] AS l FROM pj)
SELECT c_custkey, array_to_string(list_filter(l, lambda v: v IS NOT NULL), ',') AS failed, len(list_filter(l, lambda v: v IS NOT NULL)) = 0 AS ready FROM q""",
    "head_crops": f"WITH {_PHOTOS}, c AS (SELECT c_custkey, cx, crown, greatest(1, chin - crown) / 0.74::DOUBLE AS h, CASE WHEN mrp THEN 35 / 45 ELSE (1.1::DOUBLE * 25.4::DOUBLE) / (1.322::DOUBLE * 25.4::DOUBLE) END AS r FROM pj) SELECT c_custkey, round(cx - h * r / 2, 4) AS x, round(crown - 0.09::DOUBLE * h, 4) AS y, round(h * r, 4) AS w, round(h, 4) AS h FROM c",
    "retained_entries": f"WITH e AS (SELECT event_id AS id, trunc(value * 10000)::BIGINT AS bytes, ts FROM events WHERE ts + to_days((event_id % 60)::INT) > TIMESTAMP '2024-01-20'), s AS (SELECT *, sum(bytes) OVER (ORDER BY ts DESC, id ROWS UNBOUNDED PRECEDING) AS t, row_number() OVER (ORDER BY ts DESC, id) AS k FROM e) SELECT id, bytes FROM s WHERE k = 1 OR t <= {assets.KEEP_BYTES}",
    "unique_names": _NAMES,
    "pattern_texts": f"WITH {_REG}, t AS (SELECT * FROM rg WHERE type = 'text') SELECT image_id, region_no, CASE WHEN (SELECT count(*) FROM t o WHERE o.image_id = t.image_id AND abs(o.h - t.h) <= t.h * 0.2::DOUBLE) >= 3 THEN 'pattern' ELSE 'text' END AS type FROM t",
    "scored_detections": f"""WITH {_REG}, a AS (SELECT *, score * CASE WHEN ((x / 800 < 0.22 OR (x + w) / 800 > 0.78) AND (y / 600 < 0.22 OR (y + h) / 600 > 0.78)) OR (abs((x + w / 2) / 800 - 0.5) < 0.15 AND abs((y + h / 2) / 600 - 0.5) < 0.15) OR (y + h) / 600 > 0.85 THEN 1.0::DOUBLE ELSE 0.75::DOUBLE END AS c0 FROM rg),
b AS (SELECT *, CASE WHEN type = 'text' AND w / h < 1.8 THEN c0 * 0.6::DOUBLE ELSE c0 END AS c1 FROM a), c AS (SELECT *, CASE WHEN abs(angle) > 12 THEN least(1.0::DOUBLE, c1 + 0.05::DOUBLE) ELSE c1 END AS c2 FROM b),
f AS (SELECT *, round_even(c2, 3) AS confidence FROM c WHERE c2 >= 0.4::DOUBLE), r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY confidence DESC, type = 'overlay', region_no)::INT AS rank FROM f)
SELECT image_id, region_no, confidence, rank, confidence >= 0.6 AS preselected FROM r WHERE rank <= 12""",
}
