"""Whole jobs over derived pages, and the expressions that only they use."""

from pyspark.sql import functions as F

from quire.catalog import assets as asset_queries
from quire.catalog import flow as flow_queries
from quire.catalog import page_plans as plan_queries
from quire.catalog.layout import WORDS_SQL, _REGIONS, LINES_SQL, _overlap
from quire.catalog.readings import _LOWER
from quire.functions import text as tx
from quire.functions.geometry import box
from quire.operators import flow
from quire.plans import composed
from quire.sources import derive
from quire.sources.tables import events, table

PAGE = ["doc_id", "page_no"]


def _segments(spark, d):
    l = F.col("line_no")
    return derive.page_lines(spark, d).select(
        *PAGE, "line_no", "x", "y", "w", "h", F.col("h").alias("text_height"), ((F.col("doc_id") * 3 + l * 7) % 97 / 97).alias("confidence"),
        F.concat(F.when(l % 8 == 5, F.concat(l.cast("string"), F.lit(") "))).when(l % 8 == 6, F.lit("• ")).otherwise(F.lit("")), "text").alias("text"))


def reconstructed_pages(spark, d):
    return composed.reconstruct_pages(_segments(spark, d), derive.page_regions(spark, d), F.lit(1100.0))


def nested_pages(spark, d):
    return composed.nested_pages(reconstructed_pages(spark, d)).select(*PAGE, F.size("blocks").alias("blocks"), F.col("blocks")[0]["kind"].alias("first_kind"))


def pdf_page_flow(spark, d):
    owners = derive.page_regions(spark, d).filter("label = 'table'").select(
        *PAGE, F.col("region_no").alias("owner"), F.lit(0).alias("priority"), F.col("region_no").alias("ordinal"), F.lit(2.0).alias("pad"), F.col("x").alias("x0"), F.col("y").alias("top"), (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + F.col("h")).alias("bottom"))
    return composed.pdf_page_flow(derive.pdf_words(spark, d), owners, flow_queries.line_shapes(spark, d), flow_queries.line_rules(spark, d))


def scan_page_flow(spark, d):
    return composed.scan_page_flow(_segments(spark, d), derive.page_regions(spark, d).filter("label = 'image'"))


def detection_review(spark, d):
    r = asset_queries._regions(spark, d)
    out = composed.detection_review(r.filter("type = 'text'"), r.filter("type = 'overlay'"), F.lit(800.0), F.lit(600.0))
    return out.select("image_id", "region_no", "type", "confidence", "rank", "preselected")


def asset_audit(spark, d):
    m = asset_queries._manifest(spark, d)
    results = m.select("request_id", F.col("size").alias("original_size"), (F.col("size") * (40 + F.col("colours") % 70) / 100).cast("long").alias("size"), F.when(F.col("page_id") % 6 == 5, "error").otherwise("done").alias("status"))
    return composed.asset_audit(m, results, asset_queries.LIMITS)


#: How a bundle's pages are cut into parts, by bundle.
CUTS = ("1-2; 3-", "2-", "1, 1-3")


def page_plans(spark, d):
    """Chosen pages of ten conversations each, arranged, bundled, numbered and cut."""
    pages = plan_queries._pages(spark, d)
    order = pages.select("conv_id").distinct().select("conv_id", F.floor(F.col("conv_id") / 10).alias("bundle"), (F.col("conv_id") % 10).alias("position"))
    options = F.array(*[F.lit(c) for c in CUTS])
    cuts = order.select("bundle").distinct().select("bundle", F.element_at(options, (F.col("bundle") % len(CUTS) + 1).cast("int")).alias("spec"))
    return composed.page_plans(pages, plan_queries._specs(spark, d), plan_queries._plan(spark, d), order, cuts, "conv_id", "page", "bundle", "Page {n} of {total}")


def profile_corpus(spark, d):
    docs = table(spark, d, "documents", "doc_id", "lang", "source", "text")
    return composed.profile_corpus(docs, table(spark, d, "labels", "doc_id", "quality"), ["lang", "source"])


def search_corpus(spark, d):
    return composed.search_corpus(table(spark, d, "documents", "doc_id", "text"), "the th", "the he en", "[$1]")


def numeric_profile(spark, d):
    return composed.numeric_profile(events(spark, d, "event_type", "value"), ["event_type"], "value", 0, 100, k=2.0, minimum=10.0)


def page_scorecard(spark, d):
    words = derive.page_words(spark, d).withColumn("word_id", F.col("line") * 10000 + F.col("word_no"))
    rules, regions = derive.frame_rules(spark, d), derive.page_regions(spark, d)
    before = {"words": words, "rules": rules, "pictures": regions.filter("label = 'image'")}
    after = {"words": words.filter("conf >= 0.1"), "rules": rules.filter("ordinal % 16 < 8"), "pictures": regions.filter("label = 'image' AND score >= 0.4")}
    return composed.page_scorecard(before, after, F.lit(380.0), F.lit(1090.0), together=True)


def turned_boxes(spark, d):
    """Regions found on turned pages, back on the page as printed and in points."""
    r = derive.page_regions(spark, d).withColumn("rotation", (F.col("doc_id") % 4 * 90).cast("int"))
    b = box().scaled(2.0).turned_back(F.col("rotation"), F.lit(250.0), F.lit(600.0))
    return r.select(*PAGE, "region_no", b.x.alias("x"), b.y.alias("y"), b.w.alias("w"), b.h.alias("h"))


STYLES = ("devanagari", "lower-alpha", "upper-alpha", "lower-roman", "upper-roman", "decimal")


def list_markers(spark, d):
    p = table(spark, d, "part", "p_partkey", "p_size")
    style = F.element_at(F.array(*[F.lit(s) for s in STYLES]), (F.col("p_partkey") % len(STYLES) + 1).cast("int"))
    marker = tx.list_marker(style, F.lit(True), F.col("p_size"), F.lit(2))
    return p.select("p_partkey", style.alias("style"), marker.alias("marker"), tx.list_style(marker, F.lit(True)).alias("detected"), tx.list_start(marker).alias("start"))


QUERIES = {f.__name__: f for f in (reconstructed_pages, nested_pages, pdf_page_flow, scan_page_flow, detection_review, asset_audit, page_plans, profile_corpus, search_corpus, numeric_profile, page_scorecard, turned_boxes, list_markers)}

from quire.catalog.assets import _FILES  # noqa: E402
from quire.catalog.flow import _FRAMES  # noqa: E402
from quire.catalog.page_plans import _PAGES, _PARTS, _PLAN  # noqa: E402
from quire.catalog.numeric import ORACLE as _NUMERIC, _otsu, _tonal  # noqa: E402
from quire.catalog.searching import ORACLE as _SEARCH  # noqa: E402
from quire.catalog.text_profile import ORACLE as _TEXT  # noqa: E402

ORACLE = {
    "asset_audit": f"""WITH {_FILES}, j AS (SELECT *, size = 0 OR size > 10485760 OR lower(ext) NOT IN ('.jpg', '.jpeg', '.png', '.webp') OR claimed = 'text/html' OR coalesce(format, '') NOT IN ('jpeg', 'png', 'webp') OR width * height > 40000000 AS bad, trunc(size * (40 + colours % 70) / 100)::BIGINT AS small FROM fi),
g AS (SELECT request_id, count(*) AS files, sum(size)::BIGINT AS bytes, count(*) FILTER (NOT bad) AS accepted, count(*) FILTER (bad) AS refused, sum(size) FILTER (page_id % 6 <> 5) AS o, sum(least(size, small)) FILTER (page_id % 6 <> 5) AS s FROM j GROUP BY ALL)
SELECT request_id, files, bytes, CASE WHEN files > 18 THEN 'TOO_MANY_FILES' WHEN bytes > 31457280 THEN 'FILE_TOO_LARGE' END AS reason, accepted, refused, (o - s)::BIGINT AS saved, floor((o - s) / greatest(1, o) * 100 + 0.5)::BIGINT AS percent FROM g""",
    "page_plans": f"""WITH {_PARTS}{_PLAN[len(_PAGES):]},
sel AS (SELECT DISTINCT pg.conv_id, pg.page FROM pg JOIN good ON pg.conv_id = good.conv_id AND pg.page BETWEEN good.start AND good."end"),
arr AS (SELECT conv_id, page, ordinal AS place, (rotation + rotate) % 360 AS rotation FROM plan JOIN pg USING (conv_id, page) JOIN sel USING (conv_id, page) WHERE conv_id NOT IN (SELECT conv_id FROM bad WHERE problem IS NOT NULL)),
me AS (SELECT conv_id // 10 AS bundle, *, row_number() OVER w AS new_page, count(*) OVER (PARTITION BY conv_id // 10) AS total FROM arr WINDOW w AS (PARTITION BY conv_id // 10 ORDER BY conv_id % 10, place)),
bu AS (SELECT DISTINCT bundle, total FROM me),
cu AS (SELECT bundle, unnest(CASE bundle % 3 WHEN 0 THEN [[0, 1, 2], [1, 3, total]] WHEN 1 THEN [[0, 2, total]] ELSE [[0, 1, 1], [1, 1, 3]] END) AS c FROM bu WHERE total >= CASE WHEN bundle % 3 = 1 THEN 2 ELSE 3 END),
di AS (SELECT DISTINCT conv_id, page FROM arr), ru AS (SELECT conv_id, page, page - row_number() OVER (PARTITION BY conv_id ORDER BY page) AS g FROM di),
sp2 AS (SELECT conv_id, min(page) AS s, max(page) AS e FROM ru GROUP BY conv_id, g), fo AS (SELECT conv_id, string_agg(CASE WHEN s = e THEN s::VARCHAR ELSE s || '-' || e END, ', ' ORDER BY s) AS taken FROM sp2 GROUP BY conv_id)
SELECT me.bundle, conv_id, page, rotation, new_page, 'Page ' || new_page || ' of ' || total AS label, taken, c[1]::INT AS part_no, CASE WHEN c[2] = c[3] THEN 'page-' || c[2] ELSE 'pages-' || c[2] || '-' || c[3] END AS part, (new_page - c[2] + 1)::INT AS part_page
FROM me JOIN fo USING (conv_id) LEFT JOIN cu ON me.bundle = cu.bundle AND new_page BETWEEN c[2] AND c[3]""",
    "numeric_profile": f"""SELECT event_type, n, upper_median, threshold, lo, hi, low_contrast, few, coalesce(outliers, 0)::BIGINT AS outliers FROM (SELECT event_type, count(*) AS n, list_sort(list(value))[(count(*) // 2 + 1)::INT] AS upper_median, count(DISTINCT value) <= 400 AS few FROM events GROUP BY event_type)
JOIN (SELECT event_type, threshold FROM ({_otsu('events', 'event_type', 'value', 100)})) USING (event_type) JOIN (SELECT event_type, lo, hi, hi - lo < 110 AS low_contrast FROM (WITH {_tonal('events', 'event_type', 'value', 100)} SELECT * FROM tones)) USING (event_type)
LEFT JOIN (SELECT event_type, count(*) AS outliers FROM ({_NUMERIC["mad_outliers"]}) GROUP BY event_type) USING (event_type)""",
    "profile_corpus": f"""SELECT * FROM ({_TEXT["text_profile"].replace("ROLLUP (lang, source)", "lang, source")}) JOIN ({_TEXT["script_language"]}) USING (lang, source)
JOIN ({_TEXT["label_share"].replace("SELECT d.lang, l.quality", "SELECT d.lang, d.source, l.quality").replace("SELECT lang, count", "SELECT lang, source, count").replace("GROUP BY lang", "GROUP BY lang, source")}) USING (lang, source)""",
    "search_corpus": f"""WITH h AS (SELECT doc_id, count(*) AS hits, min(start) AS first_hit FROM ({_SEARCH["phrase_search"]}) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS highlights, sum("end" - start)::BIGINT AS highlighted FROM ({_SEARCH["merge_ranges"]}) GROUP BY doc_id),
r AS (SELECT doc_id, len(regexp_extract_all(text, '(?i)the th'))::BIGINT AS replaced, length(regexp_replace(text, '(?i)the th', '[$1]', 'g')) AS new_length FROM documents WHERE regexp_matches(text, '(?i)the th'))
SELECT doc_id, coalesce(hits, 0)::BIGINT AS hits, first_hit, coalesce(highlights, 0)::BIGINT AS highlights, coalesce(highlighted, 0)::BIGINT AS highlighted, coalesce(replaced, 0)::BIGINT AS replaced, new_length::INT AS new_length FROM h FULL JOIN m USING (doc_id) FULL JOIN r USING (doc_id)""",
    "page_scorecard": f"""WITH {WORDS_SQL}{_REGIONS[len(LINES_SQL):]}, {_FRAMES[len(LINES_SQL) + 2:].replace('bl AS (SELECT DISTINCT doc_id, page_no, block FROM pl), ', '')},
ta AS (SELECT doc_id, page_no, unnest({_LOWER.format(t='text')}) AS t FROM pw), tc AS (SELECT doc_id, page_no, unnest({_LOWER.format(t='text')}) AS t FROM pw WHERE conf >= 0.1),
na AS (SELECT doc_id, page_no, t, count(*) AS n FROM ta GROUP BY ALL), nb AS (SELECT doc_id, page_no, t, count(*) AS n FROM tc GROUP BY ALL),
di AS (SELECT p.doc_id, p.page_no, coalesce((SELECT sum(n) FROM na WHERE na.doc_id = p.doc_id AND na.page_no = p.page_no), 0) AS a, coalesce((SELECT sum(n) FROM nb WHERE nb.doc_id = p.doc_id AND nb.page_no = p.page_no), 0) AS b, coalesce((SELECT sum(least(na.n, nb.n)) FROM na JOIN nb USING (doc_id, page_no, t) WHERE doc_id = p.doc_id AND page_no = p.page_no), 0) AS s FROM (SELECT DISTINCT doc_id, page_no FROM pw) p),
bx AS (SELECT *, line * 10000 + word_no AS id FROM pw WHERE conf >= 0.1),
ov AS (SELECT a.doc_id, a.page_no, count(*) AS n FROM bx a JOIN bx b ON a.doc_id = b.doc_id AND a.page_no = b.page_no AND a.id < b.id WHERE abs(a.y - b.y) >= 0.5 * least(a.h, b.h) AND {_overlap('a', 'b')} > 0.3 * least(a.w * a.h, b.w * b.h) GROUP BY ALL),
cl AS (SELECT doc_id, page_no, count(*) FILTER (x < -1 OR x + w > 381 OR y < -1 OR y + h > 1091) AS n FROM bx GROUP BY ALL),
ru AS (SELECT doc_id, page_no, count(*) AS ra, count(*) FILTER (ordinal % 16 < 8) AS rb FROM fr GROUP BY ALL), pi AS (SELECT doc_id, page_no, count(*) AS pa, count(*) FILTER (score >= 0.4) AS pb FROM rg WHERE label = 'image' GROUP BY ALL)
SELECT doc_id, page_no, CASE WHEN a + b = 0 THEN 1.0::DOUBLE ELSE floor(2 * s / (a + b) * 1000 + 0.5) / 1000 END AS text, coalesce(ov.n, 0) AS overlap, coalesce(cl.n, 0) AS clipped, coalesce(ra, 0) AS rules_before, coalesce(rb, 0) AS rules_after, coalesce(pa, 0) AS pictures_before, coalesce(pb, 0) AS pictures_after
FROM di LEFT JOIN ov USING (doc_id, page_no) LEFT JOIN cl USING (doc_id, page_no) LEFT JOIN ru USING (doc_id, page_no) LEFT JOIN pi USING (doc_id, page_no)""",
    "turned_boxes": f"""WITH {_REGIONS}, s AS (SELECT doc_id, page_no, region_no, doc_id % 4 * 90 AS r, x / 2 AS x0, y / 2 AS y0, (x + w) / 2 AS x1, (y + h) / 2 AS y1, w / 2 AS w, h / 2 AS h FROM rg)
SELECT doc_id, page_no, region_no, CASE r WHEN 90 THEN y0 WHEN 180 THEN 250 - x1 WHEN 270 THEN 600 - y1 ELSE x0 END AS x, CASE r WHEN 90 THEN 250 - x1 WHEN 180 THEN 600 - y1 WHEN 270 THEN x0 ELSE y0 END AS y, CASE WHEN r IN (90, 270) THEN h ELSE w END AS w, CASE WHEN r IN (90, 270) THEN w ELSE h END AS h FROM s""",
    "list_markers": """WITH b AS (SELECT p_partkey, ['devanagari', 'lower-alpha', 'upper-alpha', 'lower-roman', 'upper-roman', 'decimal'][p_partkey % 6 + 1] AS style, p_size + 2 AS v FROM part),
r AS (SELECT *, ['', 'x', 'xx', 'xxx', 'xl', 'l'][v // 10 + 1] || ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][v % 10 + 1] AS rom FROM b),
m AS (SELECT *, CASE style WHEN 'devanagari' THEN translate(v::VARCHAR, '0123456789', '०१२३४५६७८९') WHEN 'lower-alpha' THEN chr((96 + (v - 1) % 26 + 1)::INT) WHEN 'upper-alpha' THEN chr((64 + (v - 1) % 26 + 1)::INT) WHEN 'lower-roman' THEN rom WHEN 'upper-roman' THEN upper(rom) ELSE v::VARCHAR END AS body FROM r)
SELECT p_partkey, style, body || '.' AS marker, CASE WHEN regexp_matches(body, '^[०-९]+$') THEN 'devanagari' WHEN regexp_matches(body, '^\\d+$') THEN NULL WHEN regexp_matches(body, '^[ivxlc]+$') AND body <> 'c' THEN 'lower-roman' WHEN regexp_matches(body, '^[IVXLC]+$') AND body <> 'C' THEN 'upper-roman' WHEN regexp_matches(body, '^[a-z]$') THEN 'lower-alpha' WHEN regexp_matches(body, '^[A-Z]$') THEN 'upper-alpha' END AS detected,
  CASE WHEN style IN ('devanagari', 'decimal') THEN v WHEN length(body) = 1 THEN ascii(lower(body)) - 96 ELSE 1 END::INT AS start FROM m""",
}
