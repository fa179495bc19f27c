"""Pages as rows: choose, arrange, merge, split, number them, and write page lists as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.plans.segments import with_previous

# --- fixed values ---
RANGE = r"^(\d{1,9})[" + tx.SPACE + r"]*(?:[-–][" + tx.SPACE + r"]*(\d{1,9})?)?\z"
TURNS = (0, 90, 180, 270)
# --------------------


def parse_specs(specs: DataFrame, counts: DataFrame, doc: str, spec: str = "spec", pages: str = "pages", max_ranges: int | None = None) -> DataFrame:
    """One row per part of a page list: (doc, ordinal, part, start, end, problem).

    ``problem`` is null for a good part; a list without parts has one row saying ``empty``;
    with ``max_ranges`` a longer list is refused.
    """
    parts = F.filter(F.transform(F.split(spec, "[,;]"), tx.strip), lambda p: p != "")
    rows = specs.join(counts.select(doc, F.col(pages).alias("_pages")), doc).withColumn("_parts", parts)
    out = rows.select(doc, "_pages", F.size("_parts").alias("_n"), F.posexplode_outer("_parts").alias("ordinal", "part"))
    first, second = F.regexp_extract("part", RANGE, 1), F.regexp_extract("part", RANGE, 2)
    start = F.when(first != "", first.cast("int"))
    end = F.when(second != "", second.cast("int")).when(F.col("part").rlike("[-–]"), F.col("_pages")).otherwise(start)
    out = out.withColumn("start", start).withColumn("end", F.when(F.col("start").isNotNull(), end.cast("int")))
    problem = (
        F.when(F.col("part").isNull(), "empty").when(F.lit(False) if max_ranges is None else F.col("_n") > max_ranges, "too many")
        .when(F.col("start").isNull() | (F.col("start") < 1) | (F.col("end") < 1), "syntax")
        .when(F.col("start") > F.col("end"), "backwards").when(F.col("end") > F.col("_pages"), "outside")
    )
    return out.withColumn("ordinal", F.coalesce("ordinal", F.lit(0))).withColumn("problem", problem).drop("_pages", "_n")


def spec_problems(parts: DataFrame, doc: str) -> DataFrame:
    """Refused lists with their first problem."""
    bad = parts.filter("problem IS NOT NULL")
    return bad.groupBy(doc).agg(F.min_by(F.struct("problem", "part"), "ordinal").alias("p")).select(doc, "p.problem", "p.part")


def accepted_ranges(parts: DataFrame, doc: str) -> DataFrame:
    """Ranges of the lists that are good as a whole."""
    return parts.filter("problem IS NULL").join(parts.filter("problem IS NOT NULL").select(doc).distinct(), doc, "left_anti").drop("problem")


def select_pages(pages: DataFrame, specs: DataFrame, doc: str, page: str, spec: str = "spec") -> DataFrame:
    """Pages a list names, each once, in order. Refused lists select nothing (see ``spec_problems``).

    A semi join on the ranges: no range is unrolled, and a page named twice still comes once.
    """
    counts = pages.groupBy(doc).agg(F.count(F.lit(1)).cast("int").alias("pages"))
    ranges = accepted_ranges(parse_specs(specs, counts, doc, spec), doc)
    hit = (F.col("p." + doc) == F.col("r." + doc)) & F.col("p." + page).between(F.col("r.start"), F.col("r.end"))
    return pages.alias("p").join(ranges.alias("r"), hit, "left_semi")


def plan_problems(pages: DataFrame, plan: DataFrame, doc: str, page: str, max_pages: int | None = None) -> DataFrame:
    """Plans refused as a whole: a page the document lacks, a turn that is not a quarter, or more than ``max_pages`` rows."""
    counts = pages.groupBy(doc).agg(F.count(F.lit(1)).alias("_pages"))
    checked = plan.join(counts, doc, "left").groupBy(doc).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if((F.col(page) < 1) | (F.col(page) > F.coalesce("_pages", F.lit(0)))).alias("outside"),
        F.count_if(~F.col("rotate").isin(*TURNS)).alias("turned"))
    reason = F.when(F.lit(False) if max_pages is None else F.col("rows") > max_pages, "too many pages").when(F.col("turned") > 0, "not a quarter turn").when(F.col("outside") > 0, "outside")
    return checked.select(doc, reason.alias("problem")).filter("problem IS NOT NULL")


def organize(pages: DataFrame, plan: DataFrame, doc: str, page: str, rotation: str = "rotation") -> DataFrame:
    """Reorders, repeats, drops and turns pages: a plan (doc, ordinal, page, rotate) joined with them."""
    good = plan.join(plan_problems(pages, plan, doc, page).select(doc), doc, "left_anti")
    out = pages.join(good, [doc, page])
    return out.withColumn(rotation, (F.col(rotation) + F.col("rotate")) % 360).drop("rotate").withColumnRenamed("ordinal", "new_page")


def split_pages(pages: DataFrame, doc: str, page: str, ranges: DataFrame | None = None) -> DataFrame:
    """Pages with the part they go to: one part per range (or per page), with its label and new number."""
    if ranges is None:
        return pages.withColumn("part_no", F.col(page)).withColumn("label", F.concat(F.lit("page-"), F.col(page).cast("string"))).withColumn("new_page", F.lit(1))
    inside = (F.col("p." + doc) == F.col("r." + doc)) & F.col("p." + page).between(F.col("r.start"), F.col("r.end"))
    out = pages.alias("p").join(ranges.alias("r"), inside).select("p.*", F.col("r.ordinal").alias("part_no"), "r.start", "r.end")
    one = F.concat(F.lit("page-"), F.col("start").cast("string"))
    many = F.concat(F.lit("pages-"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"))
    return out.withColumn("label", F.when(F.col("start") == F.col("end"), one).otherwise(many)).withColumn("new_page", (F.col(page) - F.col("start") + 1).cast("int")).drop("start", "end")


def merge_documents(pages: DataFrame, order: DataFrame, doc: str, page: str, group: str, max_pages: int | None = None) -> DataFrame:
    """Documents of a group one after another: new page numbers, and whether the result is longer than ``max_pages``.

    ``order`` holds (group, doc, position). Offsets come from page counts, one row per document.
    """
    sizes = pages.groupBy(doc).agg(F.count(F.lit(1)).alias("_size"))
    placed = with_previous(order.join(sizes, doc), [group], ["position"], F.floor(F.col("position") / 256), {"_offset": ("sum", F.col("_size"))})
    totals = placed.groupBy(group).agg(F.sum("_size").alias("total"))
    numbered = with_previous(pages, [doc], [page], F.floor(F.col(page) / 4096), {"_earlier": ("sum", F.lit(1))}).withColumn("_n", F.col("_earlier") + 1).drop("_earlier")
    out = numbered.join(placed.select(doc, group, "_offset"), doc).join(totals, group)
    return out.withColumn("new_page", F.col("_offset") + F.col("_n")).withColumn("too_long", F.lit(False) if max_pages is None else F.col("total") > max_pages).drop("_offset", "_n")


def number_rows(pages: DataFrame, template: str, start: int, doc: str, page: str) -> DataFrame:
    """Labels from a template with ``{n}`` and ``{total}``, counting from ``start`` on a document's first row."""
    rows = with_previous(pages, [doc], [page], F.floor(F.col(page) / 4096), {"_before": ("sum", F.lit(1))})
    totals = pages.groupBy(doc).agg((F.count(F.lit(1)) + (start - 1)).alias("_total"))
    label = F.replace(F.replace(F.lit(template), F.lit("{n}"), (F.col("_before") + start).cast("string")), F.lit("{total}"), F.col("_total").cast("string"))
    return rows.join(totals, doc).withColumn("label", label).drop("_before", "_total")


def format_pages(pages: DataFrame, doc: str, page: str) -> DataFrame:
    """The shortest text for a document's pages: 1-3, 5, 7-8."""
    distinct = pages.select(doc, page).distinct()
    ranked = with_previous(distinct, [doc], [page], F.floor(F.col(page) / 4096), {"_rank": ("sum", F.lit(1))})
    runs = ranked.withColumn("_run", F.col(page) - F.col("_rank")).groupBy(doc, "_run").agg(F.min(page).alias("s"), F.max(page).alias("e"))
    text = F.when(F.col("s") == F.col("e"), F.col("s").cast("string")).otherwise(F.concat(F.col("s").cast("string"), F.lit("-"), F.col("e").cast("string")))
    parts = F.array_sort(F.collect_list(F.struct("s", text.alias("t"))))
    return runs.groupBy(doc).agg(F.array_join(F.transform(parts, lambda p: p["t"]), ", ").alias("pages"))


def pending(items: DataFrame, results: DataFrame, settings: Column, item: str) -> DataFrame:
    """Items to process: not in flight, and without a finished result made with these very settings."""
    key = F.sha2(F.to_json(settings), 256)
    wanted = items.filter("status <> 'processing'").withColumn("settings_key", key)
    done = results.filter("status = 'done'").select(item, "settings_key")
    return wanted.join(done, [item, "settings_key"], "left_anti")
