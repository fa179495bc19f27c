"""Page layout: words to lines, lines to paragraphs, lists and tables, blocks to kinds and reading order."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.functions.geometry import Box, box
from quire.operators.searching import match_positions
from quire.plans.folds import Columns, Group, fold_groups, fold_many, joined, ranges, stripped
from quire.plans.spatial import band_join, held

# --- fixed values ---------------------------------------------------------------------------------
KINDS = {
    "doc_title": "title", "paragraph_title": "heading", "header": "header", "header_image": "header", "footer": "footer",
    "footer_image": "footer", "number": "footer", "footnote": "footer", "table": "table", "figure_title": "caption",
    "table_title": "caption", "chart_title": "caption", "text": "paragraph", "content": "paragraph", "abstract": "paragraph",
    "reference": "paragraph", "reference_content": "paragraph", "aside_text": "paragraph", "algorithm": "paragraph",
}
PRIORITY = ("title", "table", "heading", "header", "footer", "caption", "paragraph")
MIN_REGION_SCORE = 0.4
DUPLICATE_REGION = 0.6
REGION_SHARE = 0.5
LOW_CONFIDENCE = 0.8
# Longest line whose words are placed by counting blanks.
SHORT_LINE = 256
# Blocks of a page up to which all its pairs are compared at once.
SMALL_PAGE = 64
# Strips of a stack of pieces up to which all of them are compared at once; larger stacks are placed piece by piece.
MANY_STRIPS = 64
# Pairs of boxes tested at once.
PAIRS = 1_000_000
# Type size as a share of the height of its line: Latin, Devanagari, capitals and figures only.
FONT_SHARE = (0.72, 0.62, 0.9)
# --------------------------------------------------------------------------------------------------

PAGE = ["doc_id", "page_no"]


def upper_median_of(values: Column) -> Column:
    """Of a small array (a line, a page): the middle element, of two the larger; 0 when empty."""
    present = F.array_sort(F.filter(values, lambda v: v.isNotNull()))
    return F.element_at(F.transform(F.array(present), lambda s: F.when(F.size(s) == 0, F.lit(0.0)).otherwise(F.get(s, F.floor(F.size(s) / 2).cast("int")))), 1)


def _upper_median(values: np.ndarray) -> float:
    return float(np.sort(values)[len(values) // 2]) if len(values) else 0.0


def word_boxes(lines: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Words of a line, each with its share of the line's box by character offset.

    Where single blanks part the words of a short line, a word's place follows from the blanks before it; only other
    lines have the positions of their words located.
    """
    t = F.col(text)
    marked = lines.select(*keep, "x", "y", "w", "h", t.alias("_t"), F.greatest(F.length(t), F.lit(1)).alias("_n"), _uneven(t).alias("_uneven"))
    t, w = F.col("_t"), F.col("w")
    found = F.when(F.col("_uneven"), tx.by_width(t, lambda n: F.regexp_extract_all(t, F.lit(n(tx.NON_SPACE) + "+"), F.lit(0)))).otherwise(F.split(t, " "))
    places = F.when(F.col("_uneven"), F.transform(tx.by_width(t, lambda n: match_positions(t, n(tx.NON_SPACE) + "+")), lambda m: m["start"]))
    # Outer: an inner explode makes the optimizer test the array first, computing it twice.
    words = marked.withColumn("_places", places).select("*", F.posexplode_outer(found).alias("word_no", "_word")).filter("_word <> ''")
    before = F.when(F.col("word_no") == 0, 0).otherwise(F.length(F.call_function("substring_index", "_t", F.lit(" "), F.col("word_no"))) + 1)
    start = F.when(F.col("_places").isNull(), before).otherwise(F.get("_places", F.col("word_no")))
    # Known not to be null, the place is not computed again to test that.
    shift = F.when(w.isNull(), F.lit(None)).otherwise(F.coalesce(w * start / F.col("_n"), F.lit(0.0)))
    return words.select(*keep, "word_no", (F.col("x") + shift).alias("x"), "y", (w * F.length("_word") / F.col("_n")).alias("w"), "h", F.col("_word").alias("text"))


def _uneven(t: Column) -> Column:
    """A line that is long, or holds white space other than single blanks between words."""
    wide = (F.octet_length(t) != F.length(t)) & t.rlike("[" + tx.SPACE + "&&[^\\x{0}-\\x{7F}]]")
    out = t.startswith(" ") | t.endswith(" ") | t.contains("  ") | (F.length(t) > SHORT_LINE)
    for c in tx.SPACE_CHARS:
        if c < "\x80" and c != " ":
            out = out | t.contains(c)
    return out | wide


def bounds(df: DataFrame, by: list[str]) -> DataFrame:
    """The box around a group's boxes: a plain min/max aggregation."""
    b = box()
    return df.groupBy(*by).agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(b.right).alias("_r"), F.max(b.bottom).alias("_b"), F.count(F.lit(1)).alias("boxes")).select(
        *by, "x", "y", (F.col("_r") - F.col("x")).alias("w"), (F.col("_b") - F.col("y")).alias("h"), "boxes")


def engine_lines(words: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """Words to the engine's own lines: text in word order, mean confidence, union box."""
    b = box()
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_no", "text"))), lambda w: w["text"]), " ")
    g = words.groupBy(*keys, "block", "par", "line").agg(
        F.min("x").alias("x"), F.min("y").alias("y"), F.max(b.right).alias("_r"), F.max(b.bottom).alias("_b"),
        F.avg("conf").alias("confidence"), text.alias("text"), F.count(F.lit(1)).alias("words"))
    h = F.col("_b") - F.col("y")
    return g.select(*keys, "block", "par", "line", "x", "y", (F.col("_r") - F.col("x")).alias("w"), h.alias("h"), h.alias("text_height"), "confidence", "text", "words")


def _parted(group: np.ndarray, order: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Where, in ``order``, a new stack of boxes begins: all from there on lie below all of their group before it.

    A group with a box that has no height, or a value that is no number, is one stack.
    """
    group, top, bottom = group[order], pd.Series(y[order]), pd.Series((y + h)[order])
    begins = np.ones(len(order), bool)
    begins[1:] = group[1:] != group[:-1]
    reach, least = bottom.groupby(group).cummax().to_numpy(), top[::-1].groupby(group[::-1]).cummin().to_numpy()[::-1]
    plain = np.isfinite(x) & np.isfinite(w) & np.isfinite(y + h) & ((y + h) - y > 0)
    odd = np.bincount(group, ~plain[order]) > 0
    begins[1:] |= (least[1:] >= reach[:-1]) & ~odd[group[1:]]
    return begins


def visual_lines(pieces: DataFrame, keys: list[str] = PAGE, ordinal: str = "line_no", together: bool = False) -> DataFrame:
    """Pieces of one printed line become one line again.

    A piece joins the first row holding any member it shares 60 % of its height with, less than 1.6
    heights away. The first row wins, so pieces are placed one by one, top to bottom.
    """
    schema = _key_schema(pieces, keys) + ", line_no int, x double, y double, w double, h double, text_height double, confidence double, text string, pieces int"

    def rows_of(order: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray) -> list[list[int]]:
        """The members of each row, of pieces given from top to bottom."""
        members_of: list[list[int]] = []
        tallest = float(h[order].max())
        placed: list[tuple[float, float, float, float, float, float, int]] = []
        for i, c, x0, x1, y0, y1 in zip(order.tolist(), (y + h / 2)[order].tolist(), x[order].tolist(), (x + w)[order].tolist(), y[order].tolist(), (y + h)[order].tolist()):
            height = y1 - y0
            best = -1
            # Centres only grow: past half of both heights nothing earlier can share a row.
            for n in range(len(placed) - 1, -1, -1):
                oc, ox0, ox1, oy0, oy1, oh, r = placed[n]
                if c - oc > (height + tallest) / 2:
                    break
                if best in (-1, r) or r < best:
                    shared = min(oy1, y1) - max(oy0, y0)
                    if shared >= 0.6 * min(oh, height) and max(ox0, x0) - min(ox1, x1) < 1.6 * max(oh, height):
                        best = r
            if best < 0:
                best = len(members_of)
                members_of.append([])
            members_of[best].append(i)
            placed.append((c, x0, x1, y0, y1, height, best))
        return members_of

    def rule(g: Columns, starts: np.ndarray) -> Columns:
        x, y, w, h = (g[c].astype(float) for c in ("x", "y", "w", "h"))
        size, sure = g["text_height"].astype(float), g["confidence"].astype(float)
        right = x + w
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
        order = np.lexsort((y + h / 2, group))
        begins = np.flatnonzero(_parted(group, order, x, y, w, h))
        stack = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(order))))
        strips, cut, simple = _strips(stack, *(v[order] for v in (x, y, right, y + h)))
        # Rows of simple stacks are known; the pieces of the others are placed one by one.
        easy = simple[stack[strips]]
        members, first = [order[strips[easy]]], [strips[easy][cut[easy]]]
        sizes = [np.diff(np.append(np.flatnonzero(cut[easy]), int(easy.sum())))]
        place = np.empty(len(order), int)
        place[order] = np.arange(len(order))
        ends = np.append(begins[1:], len(order))
        for lo, hi in zip(begins[~simple].tolist(), ends[~simple].tolist()):
            for found in rows_of(order[lo:hi], x, y, w, h):
                row = np.array(found)
                members.append(row[np.argsort(x[row], kind="stable")])
                first.append(place[found[:1]])
                sizes.append([len(found)])
        m, first, n = np.concatenate(members), np.concatenate(first), np.concatenate(sizes).astype(int)
        at = np.cumsum(n) - n
        row = np.repeat(np.arange(len(n)), n)
        near = np.zeros(len(m), bool)
        near[1:] = x[m][1:] - right[m][:-1] < np.minimum(h[m][1:], h[m][:-1]) * 0.25
        near[at] = True
        text = pc.binary_join_element_wise(pc.if_else(pa.array(near), "", " "), stripped(g["text"].take(pa.array(m))), "")
        letters = pc.fill_null(pc.utf8_length(g["text"]), 0).to_numpy(zero_copy_only=False)[m]
        left, top = np.minimum.reduceat(x[m], at), np.minimum.reduceat(y[m], at)
        weight, total = np.bincount(row, sure[m] * letters), np.bincount(row, letters)
        middle = size[m][np.lexsort((size[m], row))][at + n // 2]
        named = {
            "x": left, "y": top, "w": np.maximum.reduceat(right[m], at) - left, "h": np.maximum.reduceat((y + h)[m], at) - top, "text_height": middle,
            "confidence": weight / np.maximum(1, total), "pieces": n}
        ranked = np.lexsort((first, left, top, group[order[first]]))
        of = group[order[first]][ranked]
        return {
            "row": order[first][ranked], "line_no": np.arange(len(ranked)) - np.searchsorted(of, of), **{c: v[ranked] for c, v in named.items()},
            "text": joined(text, n, "").take(pa.array(ranked))}

    columns = [*keys, ordinal, "x", "y", "w", "h", "text_height", "confidence", "text"]
    return fold_groups(pieces.select(*dict.fromkeys(columns)), keys, [ordinal], schema, rule, together, all_at_once=True)


def _strips(stack: np.ndarray, x: np.ndarray, y: np.ndarray, right: np.ndarray, bottom: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces by strips of one top and one bottom, where in that order rows begin, and for which stacks this holds.

    It holds where no two strips of a stack share enough of their height and every strip's pieces come from left to
    right: a piece then shares a row with the one before or with none.
    """
    place = np.lexsort((bottom, y, stack))
    s, x0, x1, y0, y1 = (v[place] for v in (stack, x, right, y, bottom))
    tall = y1 - y0
    new = np.ones(len(place), bool)
    new[1:] = (s[1:] != s[:-1]) | (y0[1:] != y0[:-1]) | (y1[1:] != y1[:-1])
    bad = ~(np.isfinite(x0) & np.isfinite(x1) & np.isfinite(tall) & (tall > 0))
    bad[1:] |= ~new[1:] & ((x0[1:] < x0[:-1]) | (x1[1:] < x1[:-1]))
    cut = new.copy()
    cut[1:] |= ~(np.maximum(x0[1:], x0[:-1]) - np.minimum(x1[1:], x1[:-1]) < 1.6 * tall[1:])
    at = np.flatnonzero(new)
    of, top, low, high = s[at], y0[at], y1[at], tall[at]
    simple = np.bincount(s, bad, minlength=int(s[-1]) + 1) == 0
    count = np.bincount(of, minlength=len(simple))
    simple &= count <= MANY_STRIPS
    for d in range(1, int(count[simple].max(initial=1))):
        same = of[d:] == of[:-d]
        met = same & (np.minimum(low[d:], low[:-d]) - np.maximum(top[d:], top[:-d]) >= 0.6 * np.minimum(high[d:], high[:-d]))
        simple[of[d:][met]] = False
    return place, cut, simple


def _key_schema(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)


def paragraphs(lines: DataFrame, keys: list[str] = PAGE, ordinal: str = "line_no") -> DataFrame:
    """Lines with the paragraph they belong to (from 1): a new one after a gap clearly above the usual one."""
    by = Window.partitionBy(*keys)
    down = by.orderBy("y", ordinal)
    df = lines.withColumn("_gap", F.col("y") - F.lag(F.col("y") + F.col("h")).over(down))
    df = df.withColumn("_height", upper_median_of(F.collect_list("h").over(by)))
    small = F.when(F.col("_gap") < F.col("_height") * 1.5, F.col("_gap"))
    df = df.withColumn("_usual", upper_median_of(F.collect_list(small).over(by)))
    starts = F.col("_gap").isNull() | (F.col("_gap") > F.greatest(F.col("_usual") * 1.8, F.col("_height") * 0.7))
    return df.withColumn("_starts", starts.cast("int")).withColumn("paragraph", F.sum("_starts").over(down.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_gap", "_height", "_usual", "_starts")


def list_items(lines: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Lines of a paragraph (``keys``) with their list item (0: not in a list), marker and remaining text.

    A marked line begins an item and the lines after it belong to it; lines before the first marker stay
    a paragraph. A single line with a single number is no list, with a bullet it is.
    """
    down = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    marked = F.col("text").rlike(tx.LIST_MARKER)
    df = lines.withColumn("_m", marked.cast("int")).withColumn("_markers", F.sum("_m").over(whole)).withColumn("_lines", F.count(F.lit(1)).over(whole))
    lonely = (F.col("_markers") == 1) & (F.col("_lines") == 1) & ~F.col("text").rlike(tx.BULLET_START)
    df = df.withColumn("item", F.when(lonely, 0).otherwise(F.sum("_m").over(down)).cast("int"))
    opens = (F.col("_m") == 1) & (F.col("item") > 0)
    df = df.withColumn("marker", F.when(opens, F.regexp_extract("text", tx.LIST_MARKER, 1)))
    df = df.withColumn("item_text", F.when(opens, F.regexp_replace("text", tx.LIST_MARKER, "")).otherwise(F.col("text")))
    first = F.first("marker", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumn("ordered", F.when(F.col("item") > 0, first.rlike(tx.ORDERED_START))).drop("_m", "_markers", "_lines")


def usable_regions(regions: DataFrame) -> DataFrame:
    """Regions scored at least 0.4 whose label makes a block, with that block's kind and its priority."""
    kind = F.create_map(*[F.lit(v) for pair in KINDS.items() for v in pair])[F.col("label")]
    rank = F.create_map(*[v for i, k in enumerate(PRIORITY) for v in (F.lit(k), F.lit(i))])
    return regions.filter(F.col("score") >= MIN_REGION_SCORE).withColumn("kind", kind).filter("kind IS NOT NULL").withColumn("priority", rank[F.col("kind")])


def suppress_regions(regions: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """Keeps the clearest of heavily overlapping regions: by priority, then score, dropping what overlaps a kept one."""
    schema = _key_schema(regions, keys) + ", region_no int, kind string, rank int, score double, x double, y double, w double, h double"

    def rule(g: Group) -> Group:
        order = np.lexsort((-g["score"].astype(float), g["priority"]), axis=1)
        g = {c: np.take_along_axis(v, order, axis=1) for c, v in g.items()}
        x, y, w, h = (g[c].astype(float) for c in ("x", "y", "w", "h"))
        kept = np.zeros(x.shape, bool)
        for i in range(x.shape[1]):
            k, one = slice(0, i), slice(i, i + 1)
            wide = np.minimum(x[:, k] + w[:, k], x[:, one] + w[:, one]) - np.maximum(x[:, k], x[:, one])
            tall = np.minimum(y[:, k] + h[:, k], y[:, one] + h[:, one]) - np.maximum(y[:, k], y[:, one])
            covered = kept[:, k] & (np.maximum(wide, 0) * np.maximum(tall, 0) > DUPLICATE_REGION * np.minimum(w[:, k] * h[:, k], w[:, one] * h[:, one]))
            kept[:, i] = ~covered.any(axis=1)
        out = {**g, "rank": np.cumsum(kept, axis=1) - 1, "x": x, "y": y, "w": w, "h": h}
        return {c: out[c][kept] for c in (*keys, "region_no", "kind", "rank", "score", "x", "y", "w", "h")}

    return fold_groups(regions.select(*keys, "region_no", "kind", "priority", "score", "x", "y", "w", "h"), keys, ["region_no"], schema, rule, alike=True)


def assign_regions(lines: DataFrame, regions: DataFrame, keys: list[str] = PAGE, line: str = "line_no") -> DataFrame:
    """Lines with the region covering most of their area, if over half (null: loose). Earlier regions win ties."""
    mine, theirs = box(), box("r_")
    share = mine.overlap(theirs) / F.greatest(F.lit(1.0), mine.area)
    pairs = band_join(
        lines.select(*keys, line, "x", "y", "w", "h"), regions.select(*keys, "region_no", "kind", "rank", "x", "y", "w", "h"), keys,
        (F.col("y"), F.col("y") + F.col("h")), (F.col("y"), F.col("y") + F.col("h")), share > REGION_SHARE, few="right")
    best = pairs.groupBy(*keys, line).agg(F.max_by(F.struct("r_region_no", "r_kind"), F.struct(share, -F.col("r_rank"))).alias("b"))
    return lines.join(held(best.select(*keys, line, F.col("b.r_region_no").alias("region_no"), F.col("b.r_kind").alias("region_kind"))), [*keys, line], "left")


def loose_lines(lines: DataFrame, regions: DataFrame, keys: list[str] = PAGE, line: str = "line_no") -> DataFrame:
    return assign_regions(lines, regions, keys, line).filter("region_no IS NULL").drop("region_no", "region_kind")


def promote(blocks: DataFrame, page_height: Column, keys: list[str] = PAGE) -> DataFrame:
    """Short large paragraphs become headings or the title, short small ones at the edges headers and footers.

    ``blocks`` holds kind, lines, y, h and ``heights`` (the text heights of its lines).
    """
    by = Window.partitionBy(*keys)
    body_kind = F.col("kind").isin("paragraph", "list")
    bodies = F.count_if(body_kind).over(by)
    pool = F.when(bodies > 1, body_kind).otherwise(~F.col("kind").isin("title", "heading"))
    df = blocks.withColumn("_pool", pool)
    df = df.withColumn("_body", upper_median_of(F.flatten(F.collect_list(F.when(F.col("_pool"), F.col("heights"))).over(by)))).withColumn("_size", upper_median_of(F.col("heights")))
    short = (F.col("kind") == "paragraph") & (F.col("lines") <= 2)
    large = short & (F.col("_body") > 0) & (F.col("_size") >= F.col("_body") * 1.3)
    edge = short & ((F.col("_body") == 0) | (F.col("_size") <= F.col("_body") * 1.05))
    kind = (
        F.when(large & (F.col("_size") >= F.col("_body") * 1.7), "title").when(large, "heading")
        .when(edge & (F.col("y") + F.col("h") < page_height * 0.07), "header").when(edge & (F.col("y") > page_height * 0.93), "footer").otherwise(F.col("kind"))
    )
    return df.withColumn("kind", kind).drop("_pool", "_body", "_size")


def one_title(blocks: DataFrame, keys: list[str] = PAGE, ordinal: str = "block_no") -> DataFrame:
    """Only the topmost title stays a title."""
    first = F.min(F.when(F.col("kind") == "title", F.struct("y", ordinal))).over(Window.partitionBy(*keys))
    extra = (F.col("kind") == "title") & (F.struct("y", ordinal) != first)
    return blocks.withColumn("kind", F.when(extra, "heading").otherwise(F.col("kind")))


def reading_order(blocks: DataFrame, keys: list[str] = PAGE, ordinal: str = "block_no") -> DataFrame:
    """(keys, block, position): blocks side by side go left to right, others top to bottom.

    The comparison is not transitive, so a page is sorted with it as a whole, from its given order.
    """
    schema = _key_schema(blocks, keys) + f", {ordinal} int, position int"

    def sort(x: list[float], y: list[float], w: list[float], h: list[float]) -> list[int]:
        def compare(a: int, b: int) -> float:
            beside = min(y[a] + h[a], y[b] + h[b]) - max(y[a], y[b]) > 0 and (x[a] + w[a] <= x[b] or x[b] + w[b] <= x[a])
            return x[a] - x[b] if beside else y[a] - y[b]

        return sorted(range(len(x)), key=functools.cmp_to_key(compare))

    def rule(g: Group) -> Group:
        x, y, w, h = (g[c].astype(float) for c in ("x", "y", "w", "h"))
        n = x.shape[1]
        beside = ~np.isfinite(y).all(axis=1) | (n > SMALL_PAGE)
        for d in range(1, n if n <= SMALL_PAGE else 1):
            a, b = slice(0, n - d), slice(d, n)
            tall = np.minimum(y[:, a] + h[:, a], y[:, b] + h[:, b]) - np.maximum(y[:, a], y[:, b])
            beside |= ((tall > 0) & ((x[:, a] + w[:, a] <= x[:, b]) | (x[:, b] + w[:, b] <= x[:, a]))).any(axis=1)
        # Without blocks side by side, the comparison is that of the tops.
        order = np.argsort(y, axis=1, kind="stable")
        for i in np.flatnonzero(beside):
            order[i] = sort(*(v[i].tolist() for v in (x, y, w, h)))
        out = {**{k: g[k] for k in keys}, ordinal: np.take_along_axis(g[ordinal], order, axis=1), "position": np.broadcast_to(np.arange(n), x.shape)}
        return {c: v.ravel() for c, v in out.items()}

    return fold_groups(blocks.select(*keys, ordinal, "x", "y", "w", "h"), keys, [ordinal], schema, rule, alike=True)


def _table(x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """Row and column of each cell, and the limits of columns and rows; none if the cells make no table."""
    height, centre = _upper_median(h), y + h / 2
    rows: list[list[int]] = []
    for i in np.argsort(centre, kind="stable"):
        if rows and abs(centre[i] - _upper_median(centre[rows[-1]])) < height * 0.6:
            rows[-1].append(int(i))
        else:
            rows.append([int(i)])
    spans: list[list[float]] = []
    for i in np.argsort(x, kind="stable"):
        if spans and x[i] <= spans[-1][1] + height * 0.5:
            spans[-1][1] = max(spans[-1][1], x[i] + w[i])
        else:
            spans.append([x[i], x[i] + w[i]])
    if len(x) < 4 or len(spans) < 2 or len(rows) < 2:
        return None
    slack, middle = height * 0.5, x + w / 2
    column = np.array([next((c for c, (a, b) in enumerate(spans) if a - slack <= m <= b + slack), 0) for m in middle])
    row = np.empty(len(x), int)
    for r, members in enumerate(rows):
        row[members] = r
    middles = np.array([_upper_median(centre[r]) for r in rows])
    return row, column, np.array([x.min(), *[s[0] for s in spans[1:]], (x + w).max()]), np.array([y.min(), *((middles[1:] + middles[:-1]) / 2), (y + h).max()])


def _running(values: np.ndarray, group: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The greatest value of a group so far, groups lying one after another."""
    return pd.Series(values).groupby(group).cummax().to_numpy() if len(starts) > 1 else np.maximum.accumulate(values)


def _tables(g: Columns, starts: np.ndarray) -> Columns:
    """Cells of many tables: ``row`` (a row of the table), row_no, col_no, text and shares, table by table, row by row.

    Where cells of a row have one centre, rows far enough apart, and no width is negative, rows are the centres and a
    cell lies in the span that it is a part of. Other tables are worked out one by one.
    """
    x, y, w, h = (g[c].astype(float) for c in ("x", "y", "w", "h"))
    size = np.diff(np.append(starts, len(x)))
    t = np.repeat(np.arange(len(starts)), size)
    centre, right = y + h / 2, x + w
    height = h[np.lexsort((h, t))][starts + size // 2]
    plain = np.bincount(t, ~(np.isfinite(x + w) & np.isfinite(centre) & (w >= 0)), minlength=len(starts)) == 0
    plain &= height > 0
    row, col = np.zeros(len(x), int), np.zeros(len(x), int)
    # Rows: distinct centres.
    down = np.lexsort((centre, t))
    c, of = centre[down], t[down]
    new = np.ones(len(x), bool)
    new[1:] = (of[1:] != of[:-1]) | (c[1:] != c[:-1])
    close = np.zeros(len(x), bool)
    close[1:] = new[1:] & (of[1:] == of[:-1]) & (np.abs(c[1:] - c[:-1]) < height[of[1:]] * 0.6)
    plain[of[close]] = False
    row[down] = np.cumsum(new) - 1
    row_of, middles = of[new], c[new]
    # Columns: merged extents.
    across = np.lexsort((x, t))
    reach = _running(right[across], of, starts)
    open_ = np.ones(len(x), bool)
    open_[1:] = (of[1:] != of[:-1]) | ~(x[across][1:] <= reach[:-1] + height[of[1:]] * 0.5)
    col[across] = np.cumsum(open_) - 1
    col_of, left = of[open_], x[across][open_]
    rows, cols = np.bincount(row_of, minlength=len(starts)), np.bincount(col_of, minlength=len(starts))
    row -= (np.cumsum(rows) - rows)[t]
    col -= (np.cumsum(cols) - cols)[t]

    def limits(of: np.ndarray, count: np.ndarray, begin: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Extents of a table's rows or columns, from where each begins."""
        begin = begin.copy()
        at = np.cumsum(count) - count
        begin[at] = first
        stop = np.append(begin[1:], 0.0)
        stop[at + count - 1] = last
        return stop - begin

    wide = limits(col_of, cols, left, np.minimum.reduceat(x, starts), np.maximum.reduceat(right, starts))
    edge = np.append(0.0, (middles[1:] + middles[:-1]) / 2)
    tall = limits(row_of, rows, edge, np.minimum.reduceat(y, starts), np.maximum.reduceat(y + h, starts))
    good = (size >= 4) & (rows >= 2) & (cols >= 2)
    parts_wide, parts_tall = [wide], [tall]
    wide_at, tall_at = np.cumsum(cols) - cols, np.cumsum(rows) - rows
    for k in np.flatnonzero(~plain):
        lo, hi = starts[k], starts[k] + size[k]
        found = _table(x[lo:hi], y[lo:hi], w[lo:hi], h[lo:hi])
        good[k] = found is not None
        if found:
            row[lo:hi], col[lo:hi], across_, down_ = found
            wide_at[k], tall_at[k] = sum(map(len, parts_wide)), sum(map(len, parts_tall))
            cols[k], rows[k] = len(across_) - 1, len(down_) - 1
            parts_wide.append(np.diff(across_))
            parts_tall.append(np.diff(down_))
    wide, tall = np.concatenate(parts_wide), np.concatenate(parts_tall)

    def shares(at: np.ndarray, count: np.ndarray, extents: np.ndarray) -> np.ndarray:
        """Of tables that are good, one after another."""
        sizes = np.maximum(1.0, extents[np.repeat(at[good], count[good]) + ranges(count[good])])
        begin = np.cumsum(count[good]) - count[good]
        whole = np.add.reduceat(sizes, begin) if len(begin) else sizes
        return np.floor(sizes / np.repeat(whole, count[good]) * 1000 + 0.5) / 1000

    col_share, row_share = shares(wide_at, cols, wide), shares(tall_at, rows, tall)
    # One place per row and column, whether it holds cells or not.
    places = np.where(good, rows * cols, 0)
    base = np.cumsum(places) - places
    place = ranges(places)
    table = np.repeat(np.arange(len(starts)), places)
    row_no, col_no = place // cols[table], place % cols[table]
    inside = np.flatnonzero(good[t])
    cell = base[t[inside]] + row[inside] * cols[t[inside]] + col[inside]
    # In a row by x, of one x in order of centres, as they came.
    arrived = np.empty(len(x), int)
    arrived[down] = np.arange(len(x))
    text = stripped(g["text"].take(pa.array(inside[np.lexsort((arrived[inside], x[inside], cell))])))
    count = np.bincount(cell, minlength=int(places.sum()))
    rank = np.cumsum(good) - 1
    begin_col, begin_row = (np.cumsum(n[good]) - n[good] for n in (cols, rows))
    return {
        "row": starts[table], "table": table, "row_no": row_no, "col_no": col_no, "text": joined(text, count, " "),
        "col_share": col_share[begin_col[rank[table]] + col_no], "row_share": row_share[begin_row[rank[table]] + row_no]}


def build_table(cells: DataFrame, keys: list[str], ordinal: str = "line_no", together: bool = False) -> DataFrame:
    """Cells of a table region in long form: row, column, text, and the shares of width and height.

    Rows gather around the running median of their centres; columns are merged horizontal extents.
    Fewer than four cells, two rows or two columns make no table.
    """
    schema = _key_schema(cells, keys) + ", row_no int, col_no int, text string, col_share double, row_share double"
    return fold_many(cells.select(*keys, ordinal, "x", "y", "w", "h", "text"), keys, [ordinal], schema, _tables, together)


def table_texts(cells: DataFrame, keys: list[str]) -> DataFrame:
    """A table as text: cells of a row by tabs, rows by line feeds."""
    rows = cells.groupBy(*keys, "row_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_no", "text"))), lambda c: c["text"]), "\t").alias("t"))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "t"))), lambda r: r["t"]), "\n").alias("text"), F.count(F.lit(1)).alias("rows"))


def built_texts(cells: DataFrame, keys: list[str], ordinal: str = "line_no", together: bool = False) -> DataFrame:
    """``table_texts`` of ``build_table``, joined where the table is built: its cells go nowhere."""
    schema = _key_schema(cells, keys) + ", text string, rows long"

    def rule(g: Columns, starts: np.ndarray) -> Columns:
        made = _tables(g, starts)
        if not len(made["table"]):
            return {"row": made["row"], "text": made["text"], "rows": made["row_no"]}
        new_row = np.flatnonzero(np.append(True, (np.diff(made["table"]) != 0) | (np.diff(made["row_no"]) != 0)))
        lines = joined(made["text"], np.diff(np.append(new_row, len(made["table"]))), "\t")
        new = np.flatnonzero(np.append(True, np.diff(made["table"][new_row]) != 0))
        rows = np.diff(np.append(new, len(new_row)))
        return {"row": made["row"][new_row[new]], "text": joined(lines, rows, "\n"), "rows": rows}

    return fold_many(cells.select(*keys, ordinal, "x", "y", "w", "h", "text"), keys, [ordinal], schema, rule, together)


def document_text(blocks: DataFrame, doc: str, order: list[str]) -> DataFrame:
    """One text per document: blocks in order, a blank line between them. One document's text is one value."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col("text").alias("t")))), lambda b: b["t"])
    return blocks.groupBy(doc).agg(F.array_join(parts, "\n\n").alias("text"))


def ocr_stats(words: DataFrame, by: list[str], line: list[str]) -> DataFrame:
    """Lines, words, mean of the lines' confidences (3 decimals) and words below 0.8 per group.

    Words fold into lines and lines into groups, both combined before their shuffle.
    """
    per_line = words.groupBy(*by, *line).agg(F.avg("conf").alias("_c"), F.count(F.lit(1)).alias("_w"), F.count_if(F.col("conf") < LOW_CONFIDENCE).alias("_l"))
    return per_line.groupBy(*by).agg(
        F.count(F.lit(1)).alias("lines"), F.sum("_w").alias("words"), (F.floor(F.avg("_c") * 1000 + 0.5) / 1000).alias("confidence"), F.sum("_l").alias("low_confidence_words"))


def block_kinds(blocks: DataFrame, by: list[str]) -> DataFrame:
    """Blocks of each kind per group, one column per kind."""
    kinds = ["title", "heading", "header", "footer", "caption", "paragraph", "list", "table"]
    return blocks.groupBy(*by).pivot("kind", kinds).agg(F.count(F.lit(1))).na.fill(0, kinds)


def uncertain_words(words: DataFrame, keys: list[str], ordinal: str = "word_no") -> DataFrame:
    """Runs of neighbouring words below 0.8 confidence in a line (``keys``): first, last and text."""
    low = words.filter(F.col("conf") < LOW_CONFIDENCE)
    run = F.col(ordinal) - F.row_number().over(Window.partitionBy(*keys).orderBy(ordinal))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(ordinal, "text"))), lambda w: w["text"]), " ")
    return low.withColumn("_run", run).groupBy(*keys, "_run").agg(F.min(ordinal).alias("first"), F.max(ordinal).alias("last"), text.alias("text")).drop("_run")


def clipped(words: DataFrame, width: Column, height: Column, by: list[str], slack: float = 1.0) -> DataFrame:
    """Boxes lying more than ``slack`` outside the page, per group."""
    return words.groupBy(*by).agg(F.count_if(outside(width, height, slack)).alias("clipped"), F.count(F.lit(1)).alias("boxes"))


def outside(width: Column, height: Column, slack: float = 1.0) -> Column:
    """Whether a box lies more than ``slack`` outside the page."""
    b = box()
    return (b.x < -slack) | (b.right > width + slack) | (b.y < -slack) | (b.bottom > height + slack)


def overlap_pairs(boxes: DataFrame, keys: list[str], ident: str, cell: float = 20.0, share: float = 0.3) -> DataFrame:
    """Pairs of boxes of different lines that overlap by over 30 % of the smaller and whose corners lie near, each pair once.

    Boxes are hashed to cells by their top left corner and meet only boxes of their own and the neighbouring cells:
    an equi join on (page, cell), not a product. Each pair of cells meets once, from the left or upper one. Both sides
    read the boxes: dealt out by a part of their keys, they meet where they lie, and nothing is written. For all pairs,
    however far apart their corners, see ``all_overlaps``.
    """
    cells = boxes.select(*keys, ident, "x", "y", "w", "h", F.floor(F.col("x") / cell).alias("_cx"), F.floor(F.col("y") / cell).alias("_cy"))
    near = F.explode(F.array(*[F.struct((F.col("_cx") + dx).alias("cx"), (F.col("_cy") + dy).alias("cy"), F.lit((dx, dy) == (0, 0)).alias("own")) for dx, dy in ((0, 0), (1, 0), (-1, 1), (0, 1), (1, 1))]))
    around = cells.withColumn("n", near).withColumn("_cx", F.col("n.cx")).withColumn("_cy", F.col("n.cy")).withColumn("_own", F.col("n.own")).drop("n")
    other = cells.select(*[F.col(c).alias(f"r_{c}") for c in cells.columns])
    on = (F.col("_cx") == F.col("r__cx")) & (F.col("_cy") == F.col("r__cy"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"r_{k}"))
    a, b = box(), box("r_")
    smaller = F.least(a.area, b.area)
    on = on & (~F.col("_own") | (F.col(ident) < F.col(f"r_{ident}"))) & (F.abs(a.y - b.y) >= 0.5 * F.least(a.h, b.h)) & (smaller > 0) & (a.overlap(b) > share * smaller)
    return around.join(other, on).select(*keys, F.least(ident, f"r_{ident}").alias("first"), F.greatest(ident, f"r_{ident}").alias("second"), a.overlap(b).alias("overlap"))


def all_overlaps(boxes: DataFrame, keys: list[str], ident: str, share: float = 0.3, together: bool = False) -> DataFrame:
    """All pairs of boxes of different lines that overlap by over 30 % of the smaller, each pair once.

    Down a page, a box meets those that begin below half of the lower height of its page and above its bottom: a range of
    the boxes in order of their tops. Boxes without an extent, or with a value that is no number, overlap none.
    ``together``: every page's boxes already lie side by side in one partition.
    """
    kind = boxes.schema[ident].dataType.simpleString()
    schema = _key_schema(boxes, keys) + f", first {kind}, second {kind}, overlap double"

    def rule(g: Columns, starts: np.ndarray) -> Columns:
        page = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(g["x"]))))
        x, y, w, h = (g[c].astype(float) for c in ("x", "y", "w", "h"))
        real = np.flatnonzero((w > 0) & (h > 0) & ~np.isnan(x) & ~np.isnan(y))
        order = real[np.lexsort((y[real], page[real]))]
        page, x, y, w, h, ident_of = page[order], x[order], y[order], w[order], h[order], g[ident][order]
        right, bottom, area = x + w, y + h, w * h
        # Tops by their rank, so that page and top are one whole number.
        tops, rank = np.unique(y, return_inverse=True)
        key, base = page * (len(tops) + 1) + rank, page * (len(tops) + 1)
        lowest = np.full(len(starts), np.inf)
        np.minimum.at(lowest, page, h)
        half = y + 0.5 * np.minimum(h, lowest[page])
        # A hair less, as the sum is rounded; the pairs are tested as they are below.
        begin = np.searchsorted(key, base + np.searchsorted(tops, half - 1e-9 * np.maximum(1.0, np.abs(half)), "left"), "left")
        begin = np.maximum(begin, np.arange(len(order)) + 1)
        end = np.searchsorted(key, base + np.searchsorted(tops, bottom, "left"), "left")
        count = np.maximum(0, end - begin)
        found = []
        for part in np.split(np.arange(len(order)), np.flatnonzero(np.diff(np.cumsum(count) // PAIRS)) + 1):
            a = np.repeat(part, count[part])
            b = np.repeat(begin[part], count[part]) + ranges(count[part])
            wide = np.minimum(right[a], right[b]) - np.maximum(x[a], x[b])
            tall = np.minimum(bottom[a], bottom[b]) - np.maximum(y[a], y[b])
            over = np.maximum(0.0, wide) * np.maximum(0.0, tall)
            smaller = np.minimum(area[a], area[b])
            keep = (np.abs(y[a] - y[b]) >= 0.5 * np.minimum(h[a], h[b])) & (smaller > 0) & (over > share * smaller)
            found.append((a[keep], b[keep], over[keep]))
        a, b, over = (np.concatenate(v) for v in zip(*found))
        return {"row": order[a], "first": np.minimum(ident_of[a], ident_of[b]), "second": np.maximum(ident_of[a], ident_of[b]), "overlap": over}

    return fold_many(boxes.select(*keys, ident, "x", "y", "w", "h").na.drop(), keys, [], schema, rule, together)


def runs_in_blocks(runs: DataFrame, blocks: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """Runs with every block that holds their centre."""
    middle = box().centre_y
    inside = box("r_").holds(box().centre_x, middle)
    return band_join(runs, blocks, keys, (middle, middle), (F.col("y"), F.col("y") + F.col("h")), inside, few="right")


def block_style(paired: DataFrame, by: list[str]) -> DataFrame:
    """Weight and slant by the majority of characters, size by the upper median of the runs."""
    n = F.length("text")
    major = lambda flag: F.sum(F.when(F.col(flag), n).otherwise(0)) / F.greatest(F.lit(1), F.sum(n)) > 0.5
    return paired.groupBy(*by).agg(F.count(F.lit(1)).alias("runs"), major("bold").alias("bold"), major("italic").alias("italic"), upper_median_of(F.collect_list("size")).alias("size"))


def drop_noise(lines: DataFrame, pictures: DataFrame, keys: list[str] = PAGE, line: str = "line_no") -> DataFrame:
    """Lines read with confidence of at least 0.5 whose centre lies in no picture."""
    sure = lines.filter(F.col("confidence") >= 0.5)
    middle = box().centre_y
    covered = band_join(sure.select(*keys, line, "x", "y", "w", "h"), pictures.select(*keys, "x", "y", "w", "h"), keys, (middle, middle), (F.col("y"), F.col("y") + F.col("h")), box("r_").holds(box().centre_x, middle))
    return sure.join(covered.select(*keys, line).distinct(), [*keys, line], "left_anti")


def cover_share(boxes: DataFrame, lines: DataFrame, keys: list[str] = PAGE, ident: str = "region_no") -> DataFrame:
    """Share of a box's area its lines cover, overlaps counted as often as they occur."""
    span = (F.col("y"), F.col("y") + F.col("h"))
    pairs = band_join(boxes.select(*keys, ident, "x", "y", "w", "h"), lines.select(*keys, "x", "y", "w", "h"), keys, span, span, box().overlap(box("r_")) > 0)
    sums = pairs.groupBy(*keys, ident).agg(F.sum(box().overlap(box("r_"))).alias("_covered"))
    return boxes.join(sums, [*keys, ident], "left").withColumn("covered", F.coalesce("_covered", F.lit(0.0)) / F.greatest(F.lit(1.0), box().area)).drop("_covered")


def budgeted_top(regions: DataFrame, keys: list[str], doc: list[str], order: list[str], size: str, most: int = 12, budget: int = 8 * 1024 * 1024) -> DataFrame:
    """The first ``most`` per page, in a page's order while the document's budget lasts.

    A picture that would overflow the budget costs nothing and ends its page; later pages use what is left. A document
    is walked as one group, in batches.
    """
    top = regions.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= most).drop("_n")
    page = [k for k in keys if k not in doc]
    columns = regions.columns

    def rule(g: Group) -> Group | None:
        left, closed, kept = budget, None, []
        pages = list(zip(*(g[k] for k in page))) if page else [()] * len(g[size])
        for i, cost in enumerate(g[size]):
            if pages[i] == closed:
                continue
            if cost > left:
                closed = pages[i]
                continue
            left -= cost
            kept.append(i)
        return {c: g[c][kept] for c in columns} if kept else None

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in regions.schema.fields)
    return fold_groups(top.select(*columns), doc, [*page, *order], schema, rule)


def block_layout(lines: DataFrame, keys: list[str], page_width: Column, ordinal: str = "line_no") -> DataFrame:
    """Line height and alignment of each block, from the pitch of its lines and the spread of their edges.

    ``page_width`` is an expression over ``lines``, the same for all lines of a block.
    """
    b = box()
    down = Window.partitionBy(*keys).orderBy("y", ordinal)
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(ordinal))) == 1
    df = lines.withColumn("_pitch", F.col("y") - F.lag("y").over(down)).withColumn("_last", last).withColumn("_page", page_width)
    spread = lambda e: F.max(e) - F.min(e)
    g = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("lines"), upper_median_of(F.collect_list("_pitch")).alias("_pitch"), upper_median_of(F.collect_list("h")).alias("_h"),
        upper_median_of(F.collect_list("w")).alias("_w"), spread(b.x).alias("_left"), spread(b.right).alias("_right"), spread(b.centre_x).alias("_centre"),
        spread(F.when(~F.col("_last"), b.right)).alias("_body"), F.min("x").alias("_x0"), F.max(b.right).alias("_x1"), F.max("_page").alias("_page"), F.max(F.col("text").rlike(tx.DEVANAGARI)).alias("_dev"),
        F.max(F.col("text").rlike("[A-Z0-9]")).alias("_upper"), F.max(F.col("text").rlike("[a-z]")).alias("_lower"))
    page, tolerance = F.col("_page"), F.col("_page") * 0.015
    centred = (F.abs((F.col("_x0") + F.col("_x1")) / 2 - page / 2) < page * 0.04) & (F.col("_x0") > page * 0.12)
    left = F.col("_left") <= tolerance
    align = (
        F.when(F.col("lines") == 1, F.when(centred, "center").when((F.col("_x1") > page * 0.85) & (F.col("_x0") > page * 0.5), "right").otherwise("left"))
        .when(left & (F.col("_body") <= tolerance) & (F.col("lines") >= 3) & (F.col("_w") > page * 0.45), "justify")
        .when(left, "left").when(F.col("_right") <= tolerance, "right").when(F.col("_centre") <= tolerance * 1.5, "center").otherwise("left")
    )
    font = F.col("_h") * F.when(F.col("_dev"), FONT_SHARE[1]).when(F.col("_upper") & ~F.col("_lower"), FONT_SHARE[2]).otherwise(FONT_SHARE[0])
    measured = F.greatest(F.lit(1.0), F.least(F.lit(2.5), F.floor(F.col("_pitch") / font * 10 + 0.5) / 10))
    height = F.when(F.col("lines") > 1, measured).otherwise(F.when(F.col("_dev"), 1.6).otherwise(1.4))
    return g.select(*keys, "lines", height.alias("line_height"), align.alias("align"))
