"""Page lists and plans; the turns of a conversation stand for the pages of a document."""

from pyspark.sql import functions as F

from quire.operators import page_plans
from quire.sources.tables import table

SPECS = ("1-3, 5", "2-", "3-1", "12", "x", " ", "1;2;2-3", "1 – 2", "0")


def _pages(spark, d):
    return table(spark, d, "conversations", "conv_id", "turn").select("conv_id", (F.col("turn") + 1).cast("int").alias("page"), (F.col("turn") % 4 * 90).cast("int").alias("rotation"))


def _specs(spark, d):
    options = F.array(*[F.lit(s) for s in SPECS])
    return table(spark, d, "conversations", "conv_id").distinct().select("conv_id", F.element_at(options, (F.col("conv_id") % len(SPECS) + 1).cast("int")).alias("spec"))


def select_pages(spark, d):
    return page_plans.select_pages(_pages(spark, d), _specs(spark, d), "conv_id", "page").select("conv_id", "page")


def page_list_problems(spark, d):
    counts = _pages(spark, d).groupBy("conv_id").agg(F.count(F.lit(1)).cast("int").alias("pages"))
    return page_plans.spec_problems(page_plans.parse_specs(_specs(spark, d), counts, "conv_id"), "conv_id")


def _plan(spark, d):
    """Pages from last to first, the first one twice; every seventh document asks for one too many, every ninth turns oddly."""
    p = _pages(spark, d)
    back = p.select("conv_id", (100 - F.col("page")).alias("ordinal"), F.when((F.col("conv_id") % 7 == 3) & (F.col("page") == 1), 99).otherwise(F.col("page")).alias("page"),
                    F.when((F.col("conv_id") % 9 == 4), 45).otherwise(F.col("page") % 4 * 90).alias("rotate"))
    again = p.filter("page = 1").select("conv_id", F.lit(200).alias("ordinal"), "page", F.lit(180).alias("rotate"))
    return back.unionByName(again)


def organize(spark, d):
    return page_plans.organize(_pages(spark, d), _plan(spark, d), "conv_id", "page").select("conv_id", "page", "new_page", "rotation")


def plan_problems(spark, d):
    return page_plans.plan_problems(_pages(spark, d), _plan(spark, d), "conv_id", "page")


def split_documents(spark, d):
    pages = _pages(spark, d)
    counts = pages.groupBy("conv_id").agg(F.count(F.lit(1)).cast("int").alias("pages"))
    ranges = page_plans.accepted_ranges(page_plans.parse_specs(_specs(spark, d), counts, "conv_id"), "conv_id")
    return page_plans.split_pages(pages, "conv_id", "page", ranges).select("conv_id", "page", "part_no", "label", "new_page")


def split_every_page(spark, d):
    return page_plans.split_pages(_pages(spark, d), "conv_id", "page").select("conv_id", "page", "part_no", "label", "new_page")


def merge_documents(spark, d):
    pages = _pages(spark, d)
    order = pages.select("conv_id").distinct().select("conv_id", F.floor(F.col("conv_id") / 10).alias("bundle"), (F.col("conv_id") % 10).alias("position"))
    return page_plans.merge_documents(pages, order, "conv_id", "page", "bundle", 40).select("bundle", "conv_id", "page", "new_page", "total", "too_long")


def number_pages(spark, d):
    return page_plans.number_rows(_pages(spark, d), "Page {n} of {total}", 5, "conv_id", "page").select("conv_id", "page", "label")


def format_pages(spark, d):
    return page_plans.format_pages(_pages(spark, d).filter("(conv_id + page) % 4 <> 0"), "conv_id", "page")


def number_documents(spark, d):
    docs = table(spark, d, "documents", "doc_id", "source")
    return page_plans.number_rows(docs, "{n}/{total}", 1, "source", "doc_id")


def _settings():
    return F.struct(F.lit("webp").alias("format"), F.lit(80).alias("quality"))


def pending_items(spark, d):
    docs = table(spark, d, "documents", "doc_id")
    items = docs.select("doc_id", F.when(F.col("doc_id") % 10 == 9, "processing").otherwise("ready").alias("status"))
    old = F.struct(F.lit("jpeg").alias("format"), F.lit(80).alias("quality"))
    made = F.when(F.col("doc_id") % 3 == 0, F.to_json(old)).otherwise(F.to_json(_settings()))
    results = docs.filter("doc_id % 2 = 0").select("doc_id", F.sha2(made, 256).alias("settings_key"), F.when(F.col("doc_id") % 5 == 1, "error").otherwise("done").alias("status"))
    return page_plans.pending(items, results, _settings(), "doc_id").select("doc_id", "settings_key")


QUERIES = {f.__name__: f for f in (select_pages, page_list_problems, organize, plan_problems, split_documents, split_every_page, merge_documents, number_pages, number_documents, format_pages, pending_items)}

_PAGES = "pg AS (SELECT conv_id, (turn + 1)::INT AS page, (turn % 4 * 90)::INT AS rotation FROM conversations), cnt AS (SELECT conv_id, count(*) AS pages FROM pg GROUP BY ALL)"
_PARTS = _PAGES + r""", sp AS (SELECT conv_id, pages, [""" + ", ".join(f"'{s}'" for s in SPECS) + rf"""][conv_id % {len(SPECS)} + 1] AS spec FROM cnt),
ls AS (SELECT conv_id, pages, list_filter(list_transform(string_split_regex(spec, '[,;]'), lambda x: trim(x)), lambda x: x <> '') AS ps FROM sp),
pt AS (SELECT conv_id, pages, generate_subscripts(CASE WHEN len(ps) = 0 THEN [NULL] ELSE ps END, 1) - 1 AS ordinal, unnest(CASE WHEN len(ps) = 0 THEN [NULL] ELSE ps END) AS part FROM ls),
se AS (SELECT *, try_cast(regexp_extract(part, '^(\d{{1,5}})\s*(?:[-–]\s*(\d{{1,5}})?)?$', 1) AS INT) AS start, try_cast(regexp_extract(part, '^(\d{{1,5}})\s*(?:[-–]\s*(\d{{1,5}})?)?$', 2) AS INT) AS e FROM pt),
ee AS (SELECT *, CASE WHEN start IS NULL THEN NULL WHEN e IS NOT NULL THEN e WHEN regexp_matches(part, '[-–]') THEN pages ELSE start END::INT AS "end" FROM se),
pr AS (SELECT *, CASE WHEN part IS NULL THEN 'empty' WHEN start IS NULL OR start < 1 OR "end" < 1 THEN 'syntax' WHEN start > "end" THEN 'backwards' WHEN "end" > pages THEN 'outside' END AS problem FROM ee),
good AS (SELECT * FROM pr WHERE conv_id NOT IN (SELECT conv_id FROM pr WHERE problem IS NOT NULL))"""
_PLAN = _PAGES + """, plan AS (SELECT conv_id, 100 - page AS ordinal, CASE WHEN conv_id % 7 = 3 AND page = 1 THEN 99 ELSE page END AS page, CASE WHEN conv_id % 9 = 4 THEN 45 ELSE page % 4 * 90 END AS rotate FROM pg UNION ALL SELECT conv_id, 200, page, 180 FROM pg WHERE page = 1),
bad AS (SELECT conv_id, CASE WHEN bool_or(rotate NOT IN (0, 90, 180, 270)) THEN 'not a quarter turn' WHEN bool_or(plan.page > cnt.pages) THEN 'outside' END AS problem FROM plan JOIN cnt USING (conv_id) GROUP BY conv_id)"""

ORACLE = {
    "select_pages": f"WITH {_PARTS} SELECT DISTINCT pg.conv_id, pg.page FROM pg JOIN good ON pg.conv_id = good.conv_id AND pg.page BETWEEN good.start AND good.\"end\"",
    "page_list_problems": f"WITH {_PARTS}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY ordinal) AS k FROM pr WHERE problem IS NOT NULL) SELECT conv_id, problem, part FROM r WHERE k = 1",
    "organize": f"WITH {_PLAN} SELECT pg.conv_id, pg.page, ordinal AS new_page, (rotation + rotate) % 360 AS rotation FROM plan JOIN pg USING (conv_id, page) WHERE conv_id NOT IN (SELECT conv_id FROM bad WHERE problem IS NOT NULL)",
    "plan_problems": f"WITH {_PLAN} SELECT * FROM bad WHERE problem IS NOT NULL",
    "split_documents": f"""WITH {_PARTS} SELECT pg.conv_id, pg.page, ordinal::INT AS part_no, CASE WHEN start = "end" THEN 'page-' || start ELSE 'pages-' || start || '-' || "end" END AS label, page - start + 1 AS new_page FROM pg JOIN good ON pg.conv_id = good.conv_id AND pg.page BETWEEN start AND "end\"""",
    "split_every_page": f"WITH {_PAGES} SELECT conv_id, page, page AS part_no, 'page-' || page AS label, 1 AS new_page FROM pg",
    "merge_documents": f"WITH {_PAGES} SELECT conv_id // 10 AS bundle, conv_id, page, row_number() OVER (PARTITION BY conv_id // 10 ORDER BY conv_id % 10, page) AS new_page, count(*) OVER (PARTITION BY conv_id // 10) AS total, count(*) OVER (PARTITION BY conv_id // 10) > 40 AS too_long FROM pg",
    "number_pages": f"WITH {_PAGES} SELECT conv_id, page, 'Page ' || (row_number() OVER (PARTITION BY conv_id ORDER BY page) + 4) || ' of ' || (count(*) OVER (PARTITION BY conv_id) + 4) AS label FROM pg",
    "number_documents": "SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) || '/' || count(*) OVER (PARTITION BY source) AS label FROM documents",
    "format_pages": f"""WITH {_PAGES}, r AS (SELECT conv_id, page, page - row_number() OVER (PARTITION BY conv_id ORDER BY page) AS g FROM pg WHERE (conv_id + page) % 4 <> 0),
s AS (SELECT conv_id, min(page) AS s, max(page) AS e FROM r GROUP BY conv_id, g) SELECT conv_id, string_agg(CASE WHEN s = e THEN s::VARCHAR ELSE s || '-' || e END, ', ' ORDER BY s) AS pages FROM s GROUP BY conv_id""",
    "pending_items": """WITH k AS (SELECT sha256('{"format":"webp","quality":80}') AS k, sha256('{"format":"jpeg","quality":80}') AS old),
r AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN old ELSE k END AS key FROM documents, k WHERE doc_id % 2 = 0 AND doc_id % 5 <> 1)
SELECT doc_id, k AS settings_key FROM documents, k WHERE doc_id % 10 <> 9 AND NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = documents.doc_id AND r.key = k.k)""",
}
