"""Page flow over words, characters and rules derived from the documents."""

from pyspark.sql import functions as F

from quire.catalog.layout import LINES_SQL, WORDS_SQL, _REGIONS
from quire.functions import style
from quire.operators import flow
from quire.sources import derive
from quire.sources.tables import table

PAGE = ["doc_id", "page_no"]


def char_runs(spark, d):
    return flow.char_runs(derive.line_chars(spark, d), together=True).drop("italic", "colour", "run_no")


def pdf_lines(spark, d):
    return flow.pdf_lines(derive.pdf_words(spark, d), together=True)


def merge_rules(spark, d):
    return flow.merge_rules(derive.rule_pieces(spark, d), PAGE)


def find_boxes(spark, d):
    return flow.find_boxes(derive.frame_rules(spark, d), PAGE).drop("ordinal")


def _cells(spark, d):
    """Every block as two cells side by side."""
    blocks = derive.page_lines(spark, d).select(*PAGE, "block").distinct()
    return blocks.select(*PAGE, F.explode(F.array(F.lit(0), F.lit(1))).alias("half"), "block").select(
        *PAGE, (F.col("block") * 2 + F.col("half")).alias("cell_no"), (20.0 + 200 * F.col("half")).alias("x0"), (174.0 * F.col("block") - 4).alias("top"), (220.0 + 200 * F.col("half")).alias("x1"), (174.0 * F.col("block") + 159).alias("bottom"))


def cell_sides(spark, d):
    fills = derive.page_regions(spark, d).select(*PAGE, F.col("region_no").alias("ordinal"), F.col("label").alias("fill"), F.col("x").alias("x0"), F.col("y").alias("top"), (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + F.col("h")).alias("bottom"))
    out = flow.cell_sides(_cells(spark, d), derive.frame_rules(spark, d), fills, PAGE)
    return out.select(*PAGE, "cell_no", *[F.col(f"{s}_side.thick").alias(s) for s in ("top", "bottom", "left", "right")], "fill")


def claim_words(spark, d):
    rank = F.when(F.col("label") == "table", 0).when(F.col("label") == "text", 1).otherwise(2)
    owners = derive.page_regions(spark, d).select(
        *PAGE, F.col("region_no").alias("owner"), rank.alias("priority"), F.col("region_no").alias("ordinal"), F.when(rank == 2, 4.0).when(rank == 1, 1.0).otherwise(2.0).alias("pad"),
        F.col("x").alias("x0"), F.col("y").alias("top"), (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + F.col("h")).alias("bottom"))
    return flow.claim_words(derive.pdf_words(spark, d), owners).select(*PAGE, "word_no", "owner")


def repair_lines(spark, d):
    l = F.col("line_no")
    lines = derive.page_lines(spark, d).select(*PAGE, "line_no", F.when(l % 7 == 3, F.concat(F.lit("ा "), "text")).otherwise(F.col("text")).alias("text"), F.col("x").alias("x0"), F.col("y").alias("top"), (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + F.col("h")).alias("bottom"))
    half = (F.col("x1") - F.col("x0")) / 2
    # A second reading of every line; every fourteenth is in Latin letters, which repair nothing.
    readings = derive.page_lines(spark, d).select("line_no", *PAGE, F.explode(F.array(F.lit(0), F.lit(1))).alias("n"), "text", F.col("x").alias("x0"), F.col("y").alias("top"), (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + F.col("h")).alias("bottom"))
    readings = readings.select(*PAGE, F.when(l % 14 == 10, F.col("text")).otherwise(F.concat(F.lit("नेपाल "), F.col("n").cast("string"), F.lit(" "), "text")).alias("text"), (F.col("x0") + F.col("n") * half).alias("x0"), "top", (F.col("x0") + (F.col("n") + 1) * half).alias("x1"), "bottom")
    return flow.repair_lines(lines, readings).select(*PAGE, "line_no", "text", "repaired")


def line_rules(spark, d):
    """A rule at every line: under its words, far too long, too thick, too low, or upright beside it."""
    kind = F.col("line_no") % 5
    upright, bottom = kind == 4, F.col("y") + F.col("h")
    low = F.col("y") + F.col("h") * F.when(kind == 3, 1.6).otherwise(1.05)
    right = F.col("x") + F.col("w") + F.when(kind == 1, 500.0).otherwise(1.0)
    return derive.page_lines(spark, d).select(
        *PAGE, F.col("line_no").alias("ordinal"), F.when(upright, "v").otherwise("h").alias("dir"), F.when(upright, F.col("x") - 3).otherwise(low).alias("pos"),
        F.when(upright, F.col("y")).otherwise(F.col("x") - 1).alias("a"), F.when(upright, bottom).otherwise(right).alias("b"), F.when(kind == 2, 3.0).otherwise(1.0).alias("thick"))


def line_shapes(spark, d):
    """A shape before every line: a bullet, one that isn't drawn, one too far away, one too large."""
    k = F.col("line_no") % 4
    size = F.when(k == 3, 10.0).otherwise(4.0)
    x0, mid = F.col("x") - F.when(k == 2, 60.0).otherwise(12.0), F.col("y") + F.col("h") / 2
    return derive.page_lines(spark, d).select(
        *PAGE, F.col("line_no").alias("shape_no"), x0.alias("x0"), (x0 + size).alias("x1"), (mid - size / 2).alias("top"), (mid + size / 2).alias("bottom"), (k != 0).alias("filled"), F.lit(False).alias("stroked"))


def _underlined(spark, d):
    return flow.mark_underlines(derive.pdf_words(spark, d), line_rules(spark, d))


def underlined_words(spark, d):
    return _underlined(spark, d)[0].select(*PAGE, "word_no", "underline")


def remaining_rules(spark, d):
    return _underlined(spark, d)[1].select(*PAGE, "ordinal", "thick")


def bullets(spark, d):
    return flow.bullets(line_shapes(spark, d), derive.pdf_words(spark, d))


def page_class(spark, d):
    pages = derive.page_lines(spark, d).select(*PAGE).distinct().select(*PAGE, F.lit(450.0).alias("width"), F.lit(1200.0).alias("height"))
    # Two documents in three have upright rules too short to count.
    short = (F.col("doc_id") % 3 != 0) & (F.col("dir") == "v")
    rules = derive.frame_rules(spark, d).withColumn("b", F.when(short, F.col("a") + 8).otherwise(F.col("b")))
    pictures = derive.page_regions(spark, d).filter("label IN ('image', 'table')").select(
        *PAGE, F.col("region_no").alias("ordinal"), F.when(F.col("label") == "image", "image").otherwise("drawing").alias("kind"), F.col("x").alias("x0"), F.col("y").alias("top"), (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + F.col("h")).alias("bottom"))
    return flow.page_class(pages, derive.pdf_words(spark, d), rules, pictures)


def _flow_lines(spark, d):
    return flow.pdf_lines(derive.pdf_words(spark, d), together=True)


def text_blocks(spark, d):
    return flow.text_blocks(_flow_lines(spark, d), together=True)


def xy_cut_order(spark, d):
    """Lines of a page in two columns: the second half of its blocks moves beside the first."""
    l = derive.page_lines(spark, d)
    second = F.col("block") >= 3
    elements = l.select(*PAGE, F.col("line_no").alias("element_no"), F.lit("text").alias("kind"), F.when(second, F.col("x") + 500).otherwise(F.col("x")).alias("x0"), F.when(second, F.col("y") - 522).otherwise(F.col("y")).alias("top"),
                        F.when(second, F.col("x") + 500 + F.least("w", F.lit(400.0))).otherwise(F.col("x") + F.least("w", F.lit(400.0))).alias("x1"), (F.when(second, F.col("y") - 522).otherwise(F.col("y")) + F.col("h")).alias("bottom"), F.lit(1).alias("lines"))
    return flow.xy_cut_order(elements)


FONTS = ("AAAAAA+Helvetica-Bold", "NimbusRomNo9L-ReguItal", "CMBX10", "KohinoorDevanagari-Regular", "ABCDEF+Courier-BoldOblique", "Georgia", "MinionPro-It", "Arial,BoldItalic", "CMTI12", "SegoeUI-SemiBold")


def font_styles(spark, d):
    docs = table(spark, d, "documents", "doc_id")
    name = F.element_at(F.array(*[F.lit(f) for f in FONTS]), (F.col("doc_id") % len(FONTS) + 1).cast("int"))
    return docs.select("doc_id", name.alias("font"), style.font_style(name).alias("s")).select("doc_id", "font", "s.family", "s.bold", "s.italic")


def colours(spark, d):
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    q = F.col("l_quantity") / 50
    parts = F.when(F.col("l_linenumber") % 3 == 0, F.array(q)).when(F.col("l_linenumber") % 3 == 1, F.array(q, F.col("l_discount") * 10, F.col("l_tax") * 10)).otherwise(F.array(q, F.col("l_discount") * 8, F.col("l_tax") * 8, q / 2))
    hexed = li.select("l_orderkey", "l_linenumber", style.colour_hex(parts).alias("hex"))
    colour = F.concat(F.lit("#"), "hex")
    return hexed.select("l_orderkey", "l_linenumber", "hex", style.text_colour(colour).alias("ink"), F.round(style.colour_distance(colour, F.lit("#808080")), 4).alias("from_grey"))


QUERIES = {f.__name__: f for f in (char_runs, pdf_lines, merge_rules, find_boxes, cell_sides, claim_words, repair_lines, underlined_words, remaining_rules, bullets, page_class, text_blocks, xy_cut_order, font_styles, colours)}

_FRAMES = LINES_SQL + """, bl AS (SELECT DISTINCT doc_id, page_no, block FROM pl), fb AS (SELECT bl.*, n AS inn FROM bl, range(2) t(n) WHERE n = 0 OR block % 4 = 0),
fe AS (SELECT *, (20 + 10 * inn)::DOUBLE AS x0, (420 - 30 * inn)::DOUBLE AS x1, (174 * block - 5 + 10 * inn)::DOUBLE AS y0, (174 * block + 160 - 30 * inn)::DOUBLE AS y1 FROM fb),
fr AS (SELECT doc_id, page_no, block, (block * 8 + inn * 4)::INT AS ordinal, 'h' AS dir, y0 AS pos, x0 AS a, x1 AS b FROM fe UNION ALL SELECT doc_id, page_no, block, block * 8 + inn * 4 + 1, 'h', y1, x0 + 1, x1 + 1 FROM fe
  UNION ALL SELECT doc_id, page_no, block, block * 8 + inn * 4 + 2, 'v', x1, y0, y1 FROM fe UNION ALL SELECT doc_id, page_no, block, block * 8 + inn * 4 + 3, 'v', x0, y0, y1 FROM fe WHERE block % 3 <> 1)"""
_PDF = WORDS_SQL + ", pd AS (SELECT doc_id, page_no, (line * 10000 + word_no)::INT AS word_no, text, x AS x0, x + w AS x1, y AS top, y + h AS bottom, h AS size FROM pw)"
_UNDER = _PDF + """, ur AS (SELECT doc_id, page_no, line_no AS ordinal, line_no % 5 = 4 AS upright, y + h * CASE WHEN line_no % 5 = 3 THEN 1.6::DOUBLE ELSE 1.05::DOUBLE END AS pos, x - 1 AS a, x + w + CASE WHEN line_no % 5 = 1 THEN 500 ELSE 1 END AS b, CASE WHEN line_no % 5 = 2 THEN 3.0 ELSE 1.0 END::DOUBLE AS thick FROM pl),
pb AS (SELECT *, unnest(range(floor((bottom - 0.3 * size) / 20)::BIGINT, floor((bottom + 0.3 * size) / 20)::BIGINT + 1)) AS band FROM pd),
up AS (SELECT ur.doc_id, ur.page_no, ordinal, a, b, word_no, x1 - x0 AS wide FROM ur JOIN pb ON ur.doc_id = pb.doc_id AND ur.page_no = pb.page_no AND floor(pos / 20)::BIGINT = band AND x0 >= a - 2 AND x1 <= b + 2 AND pos - bottom + 0.2::DOUBLE * size BETWEEN 0 AND 0.35::DOUBLE * size WHERE NOT upright AND thick <= 1.6),
uo AS (SELECT doc_id, page_no, ordinal FROM up GROUP BY ALL HAVING max(b - a) <= sum(wide) + 6 * count(*) + 4)"""
_FAMILY = "CASE " + " ".join(f"WHEN regexp_matches(low, '{p}') THEN {'own' if f is None else repr(f)}" for p, f in style.FAMILIES) + " ELSE own END"

ORACLE = {
    "char_runs": f"""WITH {LINES_SQL}, ch AS (SELECT doc_id, page_no, line_no, x, y, h, text, unnest(range(length(text))) AS p FROM pl),
ink AS (SELECT *, (line_no + p // 15) % 3 = 0 AS bold FROM ch WHERE NOT regexp_matches(text[p + 1], '\\s')),
s AS (SELECT *, CASE WHEN lag(bold) OVER w IS DISTINCT FROM bold OR x + 6 * p - lag(x + 6 * p + 6) OVER w >= greatest(2, h * 1.5) THEN 1 ELSE 0 END AS st FROM ink WINDOW w AS (PARTITION BY doc_id, page_no, line_no ORDER BY p)),
r AS (SELECT *, sum(st) OVER (PARTITION BY doc_id, page_no, line_no ORDER BY p) AS g FROM s),
q AS (SELECT doc_id, page_no, line_no, g, min(p) AS a, max(p) AS z, any_value(text) AS text, any_value(bold) AS bold, any_value(x) AS x, any_value(y) AS y, any_value(h) AS h FROM r GROUP BY ALL),
n AS (SELECT *, coalesce(lead(a) OVER (PARTITION BY doc_id, page_no, line_no ORDER BY a), length(text)) AS nxt FROM q)
SELECT doc_id, page_no, regexp_replace(substr(text, a + 1, nxt - a), '\\s', ' ', 'g') AS text, x + 6 * a AS l, x + 6 * z + 6 AS r, 1200 - y - h AS b, 1200 - y AS t, h AS size, bold FROM n""",
    "merge_rules": f"""WITH {LINES_SQL} SELECT doc_id, page_no, 'h' AS dir, y + h + 1 AS pos, x AS a, CASE WHEN line_no % 6 = 0 THEN x + 46 ELSE x + 80 END AS b, CASE WHEN line_no % 6 = 0 THEN 2.5 ELSE 1.5 END::DOUBLE AS thick, '000000' AS colour,
  CASE WHEN line_no % 6 = 0 THEN 8 ELSE 2 END AS pieces, CASE WHEN line_no % 6 = 0 THEN 7 ELSE 0 END AS gaps, line_no % 6 = 0 AS dashed FROM pl""",
    "find_boxes": f"""WITH {_FRAMES}, ab AS (SELECT a.doc_id, a.page_no, a.ordinal, least(a.a, b.a) AS x0, a.pos AS top, greatest(a.b, b.b) AS x1, b.pos AS bottom, row_number() OVER (PARTITION BY a.doc_id, a.page_no, a.ordinal ORDER BY b.ordinal) AS k
  FROM fr a JOIN fr b ON a.doc_id = b.doc_id AND a.page_no = b.page_no AND a.dir = 'h' AND b.dir = 'h' AND a.b - a.a > 12 AND b.b - b.a > 12 AND b.pos - a.pos >= 8 AND abs(a.a - b.a) <= 2.5 AND abs(a.b - b.b) <= 2.5
  WHERE EXISTS (SELECT 1 FROM fr v WHERE v.dir = 'v' AND v.doc_id = a.doc_id AND v.page_no = a.page_no AND v.b - v.a > 8 AND abs(v.pos - a.a) < 2.5 AND least(v.b, b.pos) - greatest(v.a, a.pos) > 0.8 * (b.pos - a.pos))
    AND EXISTS (SELECT 1 FROM fr v WHERE v.dir = 'v' AND v.doc_id = a.doc_id AND v.page_no = a.page_no AND v.b - v.a > 8 AND abs(v.pos - a.b) < 2.5 AND least(v.b, b.pos) - greatest(v.a, a.pos) > 0.8 * (b.pos - a.pos))),
f AS (SELECT * FROM ab WHERE k = 1)
SELECT doc_id, page_no, x0, top, x1, bottom FROM f WHERE NOT EXISTS (SELECT 1 FROM f o WHERE o.doc_id = f.doc_id AND o.page_no = f.page_no AND o.ordinal <> f.ordinal AND o.x0 >= f.x0 - 0.5 AND o.top >= f.top - 0.5 AND o.x1 <= f.x1 + 0.5 AND o.bottom <= f.bottom + 0.5)""",
    "cell_sides": f"""WITH {_FRAMES}{_REGIONS[len(LINES_SQL):].replace('bl AS (SELECT DISTINCT doc_id, page_no, block FROM pl),', '')}, ce AS (SELECT doc_id, page_no, (block * 2 + n)::INT AS cell_no, (20 + 200 * n)::DOUBLE AS x0, (174 * block - 4)::DOUBLE AS top, (220 + 200 * n)::DOUBLE AS x1, (174 * block + 159)::DOUBLE AS bottom FROM bl, range(2) t(n)),
p AS (SELECT ce.*, fr.ordinal, dir, pos, (0.5 + fr.block % 3)::DOUBLE AS thick, CASE WHEN dir = 'h' THEN least(b, x1) - greatest(a, x0) > 0.6 * (x1 - x0) ELSE least(b, bottom) - greatest(a, top) > 0.6 * (bottom - top) END AS cov FROM ce LEFT JOIN fr USING (doc_id, page_no)),
s AS (SELECT doc_id, page_no, cell_no, arg_max(thick, ordinal) FILTER (cov AND dir = 'h' AND abs(pos - top) < 2.5) AS top, arg_max(thick, ordinal) FILTER (cov AND dir = 'h' AND abs(pos - bottom) < 2.5) AS bottom, arg_max(thick, ordinal) FILTER (cov AND dir = 'v' AND abs(pos - x0) < 2.5) AS "left", arg_max(thick, ordinal) FILTER (cov AND dir = 'v' AND abs(pos - x1) < 2.5) AS "right" FROM p GROUP BY ALL),
f AS (SELECT ce.doc_id, ce.page_no, ce.cell_no, arg_min(label, region_no) AS fill FROM ce JOIN rg ON ce.doc_id = rg.doc_id AND ce.page_no = rg.page_no AND ((x0 >= x - 2.5 AND top >= y - 2.5 AND x1 <= x + w + 2.5 AND bottom <= y + h + 2.5) OR (x0 < x + w - 1 AND x < x1 - 1 AND top < y + h - 1 AND y < bottom - 1 AND greatest(0, least(x1, x + w) - greatest(x0, x)) * greatest(0, least(bottom, y + h) - greatest(top, y)) > 0.8 * (x1 - x0) * (bottom - top))) GROUP BY ALL)
SELECT s.*, fill FROM s LEFT JOIN f USING (doc_id, page_no, cell_no)""",
    "claim_words": f"""WITH {_PDF}{_REGIONS[len(LINES_SQL):]}, ow AS (SELECT *, CASE label WHEN 'table' THEN 0 WHEN 'text' THEN 1 ELSE 2 END AS pr, CASE label WHEN 'table' THEN 2 WHEN 'text' THEN 1 ELSE 4 END AS pad FROM rg),
m AS (SELECT pd.doc_id, pd.page_no, word_no, region_no, row_number() OVER (PARTITION BY pd.doc_id, pd.page_no, word_no ORDER BY pr, region_no) AS k FROM pd JOIN ow ON pd.doc_id = ow.doc_id AND pd.page_no = ow.page_no AND x0 >= x - pad AND top >= y - pad AND x1 <= x + ow.w + pad AND bottom <= y + ow.h + pad)
SELECT pd.doc_id, pd.page_no, pd.word_no, m.region_no AS owner FROM pd LEFT JOIN m ON m.doc_id = pd.doc_id AND m.page_no = pd.page_no AND m.word_no = pd.word_no AND k = 1""",
    "repair_lines": f"WITH {LINES_SQL} SELECT doc_id, page_no, line_no, CASE WHEN line_no % 14 = 3 THEN 'नेपाल 0 ' || text || ' नेपाल 1 ' || text WHEN line_no % 7 = 3 THEN 'ा ' || text ELSE text END AS text, line_no % 14 = 3 AS repaired FROM pl",
    "underlined_words": f"WITH {_UNDER} SELECT doc_id, page_no, word_no, EXISTS (SELECT 1 FROM up JOIN uo USING (doc_id, page_no, ordinal) WHERE up.doc_id = pd.doc_id AND up.page_no = pd.page_no AND up.word_no = pd.word_no) AS underline FROM pd",
    "remaining_rules": f"WITH {_UNDER} SELECT doc_id, page_no, ordinal, thick FROM ur WHERE NOT EXISTS (SELECT 1 FROM uo WHERE uo.doc_id = ur.doc_id AND uo.page_no = ur.page_no AND uo.ordinal = ur.ordinal)",
    "bullets": f"""WITH {_PDF}, sh AS (SELECT doc_id, page_no, line_no AS shape_no, x - 12 AS sx, y + h / 2 AS mid FROM pl WHERE line_no % 4 = 1)
SELECT doc_id, page_no, shape_no, '•' AS text, sx AS x0, sx + 4.5 AS x1, mid - 4 AS top, mid + 4 AS bottom, greatest(6.0::DOUBLE, 4 * 2.6::DOUBLE) AS size FROM sh WHERE EXISTS (SELECT 1 FROM pd WHERE pd.doc_id = sh.doc_id AND pd.page_no = sh.page_no AND x0 - sx - 4 > 0 AND x0 - sx - 4 < 22 AND mid BETWEEN pd.top AND pd.bottom)""",
    "page_class": f"""WITH {_PDF}{_REGIONS[len(LINES_SQL):]}, pc AS (SELECT doc_id, page_no, region_no, label, x, y, w, h FROM rg WHERE label IN ('image', 'table')),
hl AS (SELECT pc.doc_id, pc.page_no, region_no, label, any_value(pc.w * pc.h) AS area, count(*) FILTER (x0 < x + pc.w - 1 AND x < x1 - 1 AND top < y + pc.h - 1 AND y < bottom - 1) AS covered, count(*) FILTER (x0 >= x - 1 AND top >= y - 1 AND x1 <= x + pc.w + 1 AND bottom <= y + pc.h + 1) AS ins FROM pc JOIN pd USING (doc_id, page_no) GROUP BY ALL),
pp AS (SELECT doc_id, page_no, count(*) FILTER (label = 'image' AND (area > 270000 OR covered > 3)) AS backgrounds, max(ins) FILTER (label = 'table') AS fig FROM hl GROUP BY ALL),
vv AS (SELECT doc_id, page_no, sum(n) AS v FROM (SELECT doc_id, page_no, block, (1 + (block % 3 <> 1)::INT) * (1 + (block % 4 = 0)::INT) AS n FROM (SELECT DISTINCT doc_id, page_no, block FROM pl) WHERE doc_id % 3 = 0) GROUP BY ALL),
wn AS (SELECT doc_id, page_no, count(*) AS n FROM pd GROUP BY ALL), pg AS (SELECT DISTINCT doc_id, page_no FROM pl)
SELECT doc_id, page_no, CASE WHEN coalesce(v, 0) >= 4 OR coalesce(fig, 0) > 0.3 * greatest(1, coalesce(n, 0)) THEN 'form' ELSE 'flow' END AS page_class, coalesce(backgrounds, 0) AS backgrounds FROM pg LEFT JOIN wn USING (doc_id, page_no) LEFT JOIN vv USING (doc_id, page_no) LEFT JOIN pp USING (doc_id, page_no)""",
    "font_styles": f"""WITH f AS (SELECT doc_id, [{', '.join(repr(n) for n in FONTS)}][doc_id % {len(FONTS)} + 1] AS font FROM documents),
n AS (SELECT *, regexp_replace(font, '^[^+]*\\+', '') AS name FROM f), w AS (SELECT *, lower(replace(name, ' ', '')) AS low, list_transform(regexp_extract_all(coalesce(nullif(regexp_extract(name, '^[^-]*-(.*)$', 1), ''), regexp_extract(name, '^[^,]*,(.*)$', 1)), '[A-Z][a-z]*|[a-z]+'), lambda t: lower(t)) AS ts,
  coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_extract(name, '^([^-]*)', 1), '(?:PSMT|PS|MT|Std|Pro|LT)$', ''), '([a-z])([A-Z])', '\\1 \\2', 'g')), ''), 'Arial') AS own FROM n)
SELECT doc_id, font, {_FAMILY} AS family, list_has_any(ts, {list(style.STYLE_BOLD)}) OR regexp_matches(low, 'bold|black|heavy|semibold|demi|^(cm|lm)bx') AS bold, list_has_any(ts, {list(style.STYLE_ITALIC)}) OR regexp_matches(low, 'italic|oblique|^(cm|lm)(ti|sl|mi)') AS italic FROM w""",
    "colours": """WITH p AS (SELECT l_orderkey, l_linenumber, l_quantity / 50 AS q, l_linenumber % 3 AS k, l_discount AS d, l_tax AS t FROM lineitem),
c AS (SELECT *, CASE k WHEN 0 THEN [q, q, q] WHEN 1 THEN [q, d * 10, t * 10] ELSE [(1 - q) * (1 - q / 2), (1 - d * 8) * (1 - q / 2), (1 - t * 8) * (1 - q / 2)] END AS rgb FROM p),
b AS (SELECT l_orderkey, l_linenumber, list_transform(rgb, lambda v: greatest(0, least(255, round_even(v * 255, 0)))::INT) AS v FROM c)
SELECT l_orderkey, l_linenumber, printf('%02X%02X%02X', v[1], v[2], v[3]) AS hex, CASE WHEN greatest(v[1], v[2], v[3]) - least(v[1], v[2], v[3]) < 30 AND (v[1] + v[2] + v[3]) / 3 < 90 THEN '#1A1A1A' ELSE printf('#%02X%02X%02X', v[1], v[2], v[3]) END AS ink,
  round(sqrt((v[1] - 128) * (v[1] - 128) + (v[2] - 128) * (v[2] - 128) + (v[3] - 128) * (v[3] - 128)), 4) AS from_grey FROM b""",
}
