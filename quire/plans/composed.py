"""Jobs that chain the operators: what a caller runs over a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.functions.geometry import box
from quire.operators import assets, detections, flow, layout, numeric, profile, readings, searching
from quire.operators import page_plans as plans
from quire.operators.layout import PAGE
from quire.plans import ranks
from quire.plans.folds import gathered
from quire.plans.spatial import held
from quire.session import checkpoint


def reconstruct_pages(segments: DataFrame, regions: DataFrame, page_height: Column, keys: list[str] = PAGE) -> DataFrame:
    """Recognised lines and layout regions to blocks in reading order.

    ``segments`` holds line_no, a box, text_height, confidence and text. Out come kind, text, box, number of
    lines, confidence (3 decimals), language and position per block.
    """
    kept = layout.suppress_regions(layout.usable_regions(regions), keys)
    # Tables, bucket facts and lines all start from the placed lines: written once, read three times.
    placed = checkpoint(layout.assign_regions(segments, kept, keys).withColumn("bucket", F.coalesce("region_no", F.lit(-1))))
    bucket = [*keys, "bucket"]
    cells = placed.filter("region_kind = 'table'").select(*bucket, "line_no", "x", "y", "w", "h", "text")
    tables = layout.built_texts(cells, bucket).select(*bucket, F.col("text").alias("table_text"))
    info = placed.groupBy(*bucket).agg(F.first("region_kind").alias("region_kind"), F.min("line_no").alias("first_segment"))
    lines = layout.visual_lines(placed.select(*bucket, "line_no", "x", "y", "w", "h", "text_height", "confidence", "text"), bucket).join(held(info.join(tables, bucket, "left")), bucket)
    whole = F.col("table_text").isNotNull() | (F.coalesce("region_kind", F.lit("paragraph")).isin("paragraph", "table") == F.lit(False))
    split = layout.list_items(layout.paragraphs(lines.filter(~whole), bucket), [*bucket, "paragraph"], ["y", "line_no"])
    one = lines.filter(whole).withColumns({"paragraph": F.lit(0), "item": F.lit(0), "marker": F.lit(None).cast("string"), "item_text": F.col("text"), "ordered": F.lit(None).cast("boolean")})
    parts = split.unionByName(one).withColumn("part", F.when(F.col("item") > 0, 1).otherwise(0))
    shown = F.when(F.col("marker").isNotNull(), F.concat("marker", F.lit(" "), tx.strip(F.col("item_text")))).otherwise(tx.strip(F.col("item_text")))
    b = box()
    blocks = parts.groupBy(*bucket, "paragraph", "part").agg(
        F.min("x").alias("x"), F.min("y").alias("y"), F.max(b.right).alias("_r"), F.max(b.bottom).alias("_b"), F.count(F.lit(1)).alias("lines"), F.collect_list("text_height").alias("heights"),
        F.avg("confidence").alias("confidence"), F.first("region_kind").alias("region_kind"), F.first("table_text").alias("table_text"), F.min("first_segment").alias("first_segment"), F.first("ordered").alias("ordered"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "line_no", shown.alias("t")))), lambda l: l["t"]), "\n").alias("text"))
    kind = F.when(F.col("table_text").isNotNull(), "table").when(F.col("part") == 1, "list").when(F.coalesce("region_kind", F.lit("table")).isin("paragraph", "table"), "paragraph").otherwise(F.col("region_kind"))
    # Regions in the order their first line came, lines outside every region last.
    order = Window.partitionBy(*keys).orderBy((F.col("bucket") == -1).cast("int"), "first_segment", "paragraph", "part")
    blocks = blocks.select(
        *keys, (F.row_number().over(order) - 1).cast("int").alias("block_no"), kind.alias("kind"), F.coalesce("table_text", "text").alias("text"), "x", "y", (F.col("_r") - F.col("x")).alias("w"), (F.col("_b") - F.col("y")).alias("h"),
        "lines", "heights", (F.floor(F.col("confidence") * 1000 + 0.5) / 1000).alias("confidence"), "ordered")
    named = checkpoint(layout.one_title(layout.promote(blocks, page_height, keys), keys))
    return named.join(layout.reading_order(named, keys), [*keys, "block_no"]).withColumn("language", profile.block_language(F.col("text"))).drop("heights")


def nested_pages(blocks: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """One row per page with its blocks as an array in reading order. A page is one value."""
    fields = ["position", *[c for c in blocks.columns if c not in (*keys, "position")]]
    return blocks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("blocks"))


def pdf_page_flow(words: DataFrame, owners: DataFrame, shapes: DataFrame, rules: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """Free words to lines, blocks and column order; underlines and drawn bullets resolved on the way."""
    # Words are read three times (under rules, behind shapes, as lines) rather than written: they take far more room than the texts.
    free = flow.claim_words(words, owners, keys).filter("owner IS NULL").drop("owner")
    dividers = flow.dividers(free, rules, keys)
    dots = flow.bullets(shapes, free, keys).withColumn("word_no", F.col("shape_no") + 100_000_000)
    named = [*keys, "word_no", "text", "x0", "x1", "top", "bottom", "size"]
    # Free words lie by page already: they are sorted with the dots where they are.
    words = gathered(free.select(*named).unionByName(dots.select(*named)), keys, ["word_no"], "word_no")
    boxes = flow.block_boxes(flow.pdf_lines(words, keys, together=True), keys, together=True)
    flat = dividers.filter((F.col("dir") == "h") & (F.col("b") - F.col("a") >= 8)).select(
        *keys, (F.col("ordinal") + 1_000_000).cast("int").alias("element_no"), F.lit("rule").alias("kind"), F.col("a").alias("x0"), (F.col("pos") - F.col("thick") / 2).alias("top"), F.col("b").alias("x1"), (F.col("pos") + F.col("thick") / 2).alias("bottom"), F.lit(0).alias("lines"), F.lit("").alias("text"))
    elements = boxes.select(*keys, F.col("block_no").alias("element_no"), F.lit("text").alias("kind"), "x0", "top", "x1", "bottom", "lines", "text").unionByName(flat)
    return flow.xy_cut_order(elements, keys, keep=True)


def scan_page_flow(lines: DataFrame, pictures: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """Read lines to blocks in column order: noise dropped, sizes snapped to the page's few real ones."""
    kept = checkpoint(layout.drop_noise(lines, pictures, keys))
    share = F.when(F.col("text").rlike(tx.DEVANAGARI), layout.FONT_SHARE[1]).otherwise(0.74)
    kept = kept.withColumn("raw_size", F.col("h") * share)
    sizes = numeric.snap_sizes(kept, keys, "raw_size").select(*keys, "raw_size", F.greatest(F.lit(5.0), F.bround(F.col("size") * 2) / 2).alias("size"))
    words = kept.join(sizes, [*keys, "raw_size"]).select(*keys, F.col("line_no").alias("word_no"), "text", F.col("x").alias("x0"), (F.col("x") + F.col("w")).alias("x1"), F.col("y").alias("top"), (F.col("y") + F.col("h")).alias("bottom"), "size")
    made = checkpoint(flow.pdf_lines(words, keys))
    placed = made.join(flow.text_blocks(made, keys), [*keys, "line_no"])
    boxes = placed.groupBy(*keys, "block_no").agg(F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"), F.count(F.lit(1)).cast("int").alias("lines"))
    elements = checkpoint(boxes.select(*keys, F.col("block_no").alias("element_no"), F.lit("text").alias("kind"), "x0", "top", "x1", "bottom", "lines"))
    return elements.join(flow.xy_cut_order(elements, keys), [*keys, "element_no"])


def detection_review(texts: DataFrame, overlays: DataFrame, width: Column, height: Column, image: str = "image_id") -> DataFrame:
    """Text pieces and overlays of an image to its scored detections."""
    joined = detections.mark_patterns(detections.join_text_regions(texts, image), image, together=True)
    return detections.score_detections(detections.merge_overlays(joined, overlays, image), width, height, image)


def asset_audit(manifest: DataFrame, results: DataFrame, limits: assets.Limits = assets.Limits()) -> DataFrame:
    """Per request: the gate's verdict, files accepted and refused, and what compressing saved."""
    judged = assets.choose_format(assets.admit(manifest, limits))
    files = judged.groupBy("request_id").agg(F.count_if(F.col("reason").isNull()).alias("accepted"), F.count_if(F.col("reason").isNotNull()).alias("refused"))
    saved = assets.savings(results, ["request_id"]).select("request_id", "saved", "percent")
    return assets.gate_requests(manifest, limits).join(files, "request_id").join(saved, "request_id", "left")


def page_plans(pages: DataFrame, specs: DataFrame, plan: DataFrame, order: DataFrame, cuts: DataFrame, doc: str, page: str, group: str, template: str, start: int = 1) -> DataFrame:
    """Page lists and plans to bundles: one row per page of a bundle and part it goes to.

    ``specs`` names the pages a document gives, ``plan`` arranges and turns them, ``order`` puts documents into
    groups, ``cuts`` (group, spec) names the parts of a group. Documents whose list or plan is refused give nothing;
    a group whose cuts are refused, and pages outside all parts, have null parts. ``label`` numbers a group's pages
    from ``start``; ``taken`` is the text of the pages that a document gave.
    """
    chosen = plans.select_pages(pages, specs, doc, page).select(doc, page)
    arranged = plans.organize(pages, plan, doc, page).withColumnRenamed("new_page", "_place")
    arranged = checkpoint(arranged.join(chosen, [doc, page], "left_semi"))  # read for the order, the totals and the texts
    bundled = checkpoint(plans.merge_documents(arranged, order, doc, "_place", group).drop("_place", "total", "too_long"))
    labelled = plans.number_rows(bundled, template, start, group, "new_page")
    totals = bundled.groupBy(group).agg(F.count(F.lit(1)).cast("int").alias("pages"))
    ranges = plans.accepted_ranges(plans.parse_specs(cuts, totals, group), group)
    numbers = bundled.select(group, F.col("new_page").alias("_n"))
    parts = plans.split_pages(numbers, group, "_n", ranges).select(group, F.col("_n").alias("new_page"), "part_no", F.col("label").alias("part"), F.col("new_page").alias("part_page"))
    taken = plans.format_pages(arranged, doc, page).withColumnRenamed("pages", "taken")
    return labelled.join(taken, doc).join(parts, [group, "new_page"], "left")


def profile_corpus(docs: DataFrame, labels: DataFrame, by: list[str], text: str = "text", ident: str = "doc_id", words: int = 50) -> DataFrame:
    """One row per group: text measures and reading time, script letters and language, and the share of good documents.

    Only labelled documents of at least ``words`` words count for the share. The measures are taken once per document.
    """
    measured = profile.text_profile(docs, by, text, rollup=False)
    letters = profile.detect_language(docs, by, text)
    marked = docs.select(ident, *by, tx.words(F.col(text)).alias("_words")).join(labels.select(ident, "quality"), ident, "left")
    share = profile.share_where(marked, by, F.col("quality") == 1, F.col("quality").isNotNull() & (F.col("_words") >= words))
    return ranks.with_keys(ranks.with_keys(measured, letters, by), share, by)


def search_corpus(docs: DataFrame, phrase: str, words: str, replacement: str, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document with any of them: hits of a phrase, merged highlights of words and their length, replacements of the phrase."""
    docs = docs.select(ident, text)
    hits = searching.phrase_search(docs, phrase, ident, None, text).groupBy(ident).agg(F.count(F.lit(1)).alias("hits"), F.min("start").alias("first_hit"))
    marks = searching.highlights(docs, words, ident, text).groupBy(ident).agg(F.count(F.lit(1)).alias("highlights"), F.sum(F.col("end") - F.col("start")).alias("highlighted"))
    changed = searching.find_replace(docs, phrase, replacement, text).filter("hits > 0").select(ident, F.col("hits").cast("long").alias("replaced"), F.length(text).alias("new_length"))
    return hits.join(marks, ident, "full").join(changed, ident, "full").na.fill(0, ["hits", "highlights", "highlighted", "replaced"])


def numeric_profile(df: DataFrame, by: list[str], value: str, low: float, high: float, cap: int = 400, k: float = 10.0, minimum: float = 40.0) -> DataFrame:
    """One row per group: count, middle value, two-class threshold, tonal range, few or many values, outliers above a robust ceiling."""
    outliers = numeric.mad_outliers(df, by, value, k, minimum).groupBy(*by).agg(F.count(F.lit(1)).alias("outliers"))
    out = ranks.upper_median(df, by, value)
    for side in (numeric.otsu_split(df, by, value, low, high).select(*by, "threshold"), numeric.tonal_range(df, by, value, low, high).select(*by, "lo", "hi", "low_contrast"), profile.few_values(df, by, value, cap).select(*by, "few")):
        out = ranks.with_keys(out, side, by)
    return ranks.with_keys(out, outliers, by, "left").na.fill(0, ["outliers"])


def page_scorecard(before: dict[str, DataFrame], after: dict[str, DataFrame], width: Column, height: Column, keys: list[str] = PAGE, together: bool = False) -> DataFrame:
    """How well pages survived: words kept, glyphs overlapping or off the page, rules and pictures kept.

    Both sides hold ``words`` (with an id ``word_id``), ``rules`` and ``pictures``. ``together``: the words of a page lie
    side by side in one partition.
    """
    # No token holds a blank, so a page's words are counted from one text; the boxes off the page are counted on the way.
    text = F.array_join(F.collect_list("text"), " ").alias("text")
    spaced = before["words"].groupBy(*keys).agg(text)
    clipped = after["words"].groupBy(*keys).agg(text, F.count_if(layout.outside(width, height)).alias("clipped"))
    out = readings.agreement(spaced, clipped, keys, tokenizer="lower", whole=True, carry=("clipped",))
    out = out.select(*keys, (F.floor(F.col("agreement") * 1000 + 0.5) / 1000).alias("text"), "clipped")
    overlaps = layout.all_overlaps(after["words"], keys, "word_id", together=together).groupBy(*keys).agg(F.count(F.lit(1)).alias("overlap"))
    out = out.join(overlaps, keys, "left")
    for name in ("rules", "pictures"):
        count = lambda side, alias: side[name].groupBy(*keys).agg(F.count(F.lit(1)).alias(alias))  # noqa: E731,B023
        out = out.join(count(before, f"{name}_before"), keys, "left").join(count(after, f"{name}_after"), keys, "left")
    return out.na.fill(0, ["overlap", "clipped", "rules_before", "rules_after", "pictures_before", "pictures_after"])
