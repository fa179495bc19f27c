"""Page flow from a PDF's own words and rules: runs, lines, rules, boxes, blocks and column order."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.functions.geometry import Box, edges
from quire.operators.layout import PAGE, _key_schema
from quire.session import checkpoint
from quire.plans.folds import Columns, Group, fold_groups, fold_many, joined, ranges
from quire.plans.spatial import BAND, band_join, held

# --- fixed values ---------------------------------------------------------------------------------
# Signs of a broken Devanagari text layer: a lost character, or a vowel sign beginning a word.
BROKEN_TEXT = r"[\x{0}\x{FFFD}]|(?:^|[" + tx.SPACE + r"])[\x{93E}-\x{94D}\x{901}-\x{903}]"
FLOW_MARKER = r"^(?:[•▪◦‣·○■□●–—-]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)]|\(?[ivxIVX]{1,4}[.)])\s"
GUTTER = 6.0
MAX_DEPTH = 12
RECENT_BLOCKS = 12
# --------------------------------------------------------------------------------------------------


def char_runs(chars: DataFrame, keys: list[str] = PAGE, together: bool = False) -> DataFrame:
    """Characters to runs of one style on one line.

    A character is compared with the run grown so far, so a page is walked; style changes and line feeds
    cut the walk into pieces that are tested as a whole. White space adds a space and no extent.

    A row holds one character, or several one after another: ``ch`` is then an array, and the other columns are arrays
    of its length or one value for them all.
    """
    schema = _key_schema(chars, keys) + ", run_no int, text string, l double, r double, b double, t double, size double, bold boolean, italic boolean, colour string"

    def rule(g: Columns, starts: np.ndarray) -> Columns:
        page, source = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(g["char_no"])))), np.arange(len(g["char_no"]))
        if pa.types.is_list(g["ch"].type):
            source = np.repeat(source, pc.fill_null(pc.list_value_length(g["ch"]), 0).to_numpy(zero_copy_only=False))
            page = page[source]
            g = {c: _each(v, source) for c, v in g.items()}
        l, r, b, t, size = (g[c].astype(float) for c in ("l", "r", "b", "t", "size"))
        named = g["ch"].dictionary_encode()
        which, chars = named.indices.to_numpy(), named.dictionary.to_pylist()
        feed = np.array([c in ("\r", "\n", "\x02", "") for c in chars], bool)[which]
        blank = np.array([c.isspace() for c in chars], bool)[which]
        feeds = np.cumsum(feed)
        ink = np.flatnonzero(~blank & ~feed)
        hard = np.ones(len(ink), bool)
        hard[1:] = False
        for mark in (page, _codes(g["bold"]), _codes(g["italic"]), _codes(g["colour"]), feeds):
            hard[1:] |= mark[ink][1:] != mark[ink][:-1]
        L, R, B, T, S = l[ink], r[ink], b[ink], t[ink], size[ink]
        new = _grown(hard, L, R, B, T, S)
        at = np.flatnonzero(new)
        if not len(at):
            return {"row": at, "run_no": at, "text": g["ch"].slice(0, 0), **{c: at.astype(float) for c in ("l", "r", "b", "t", "size")}, **{c: _at(g[c], at) for c in ("bold", "italic", "colour")}}
        # Trailing white space belongs to the run until something closes it.
        latest = np.full(len(l), -1)
        latest[ink] = np.arange(len(ink))
        latest = np.maximum.accumulate(latest)
        mine = ink[np.maximum(latest, 0)]
        inside = np.flatnonzero(~feed & (latest >= 0) & (page[mine] == page) & (feeds[mine] == feeds))
        run = np.cumsum(new) - 1
        shown = pa.array([" " if c.isspace() else c for c in chars], pa.string()).take(pa.array(which[inside]))
        first = ink[at]
        of = page[first]
        return {
            "row": source[first], "run_no": np.arange(len(at)) - np.searchsorted(of, of), "text": joined(shown, np.bincount(run[latest[inside]], minlength=len(at)), ""),
            "l": np.minimum.reduceat(L, at), "r": np.maximum.reduceat(R, at), "b": np.minimum.reduceat(B, at), "t": np.maximum.reduceat(T, at), "size": S[at],
            **{c: _at(g[c], first) for c in ("bold", "italic", "colour")}}

    return fold_many(chars.select(*keys, "char_no", "ch", "l", "r", "b", "t", "size", "bold", "italic", "colour"), keys, ["char_no"], schema, rule, together)


def _each(values: np.ndarray | pa.Array, source: np.ndarray) -> np.ndarray | pa.Array:
    """A column by characters: its arrays' elements, or its value for each character of a row."""
    if not isinstance(values, pa.Array):
        return values[source]
    if not pa.types.is_list(values.type):
        return values.dictionary_encode().take(pa.array(source))
    flat = values.flatten()
    return flat if pa.types.is_string(flat.type) else flat.to_numpy(zero_copy_only=False)


def _codes(values: np.ndarray | pa.Array) -> np.ndarray:
    """Numbers that are equal where the values are."""
    if isinstance(values, pa.Array):
        values = values if pa.types.is_dictionary(values.type) else values.dictionary_encode()
        return pc.fill_null(values.indices, -1).to_numpy(zero_copy_only=False)
    return values if values.dtype != object else pd.factorize(values)[0]


def _at(values: np.ndarray | pa.Array, rows: np.ndarray) -> np.ndarray | pa.Array:
    if not isinstance(values, pa.Array):
        return values[rows]
    values = values.take(pa.array(rows))
    return values.dictionary_decode() if pa.types.is_dictionary(values.type) else values


def _grown(new: np.ndarray, L: np.ndarray, R: np.ndarray, B: np.ndarray, T: np.ndarray, S: np.ndarray) -> np.ndarray:
    """Where runs begin, within pieces that begin at ``new``: each piece is tested as a whole against the run it begins with, and cut at the first that doesn't fit."""
    new = new.copy()
    left, of = np.arange(len(L)), np.cumsum(new) - 1  # what is still to be tested, and its piece
    while len(left):
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        piece = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(left))))
        reach, low, high = pd.Series(R[left]).groupby(piece).cummax().to_numpy(), pd.Series(B[left]).groupby(piece).cummin().to_numpy(), pd.Series(T[left]).groupby(piece).cummax().to_numpy()
        nl, nb, nt, ns = L[left][1:], B[left][1:], T[left][1:], S[left][1:]
        reach, low, high = reach[:-1], low[:-1], high[:-1]
        beside = np.minimum(high, nt) - np.maximum(low, nb) > 0.4 * np.minimum(high - low, nt - nb)
        ok = np.append(True, (np.abs(S[left[first]][piece][1:] - ns) < 0.6) & (beside | (nt <= nb)) & (nl - reach < np.maximum(2.0, ns * 1.5)))
        ok[first] = True
        misfits = np.flatnonzero(~ok)
        if not len(misfits):
            break
        # A piece goes on from its first misfit; pieces without one are done.
        cut, begin = np.unique(piece[misfits], return_index=True)
        new[left[misfits[begin]]] = True
        start = np.full(len(first), len(left))
        start[cut] = misfits[begin]
        rest = np.arange(len(left)) >= start[piece]
        left, of = left[rest], piece[rest]
    return new


def _rows(page: np.ndarray, low: np.ndarray, middle: np.ndarray, height: np.ndarray) -> np.ndarray:
    """The row, in its page, of every word, given page by page in the order of their bottoms: of the first row whose first word's centre is near.

    Words of one centre and height come to one row, so that only the first of them looks for it.
    """
    n = len(page)
    by = np.lexsort((height, middle, page))
    new = np.ones(n, bool)
    # A word without height is near to nothing, not even to its like.
    new[1:] = (page[by][1:] != page[by][:-1]) | (middle[by][1:] != middle[by][:-1]) | (height[by][1:] != height[by][:-1]) | ~(height[by][1:] > 0)
    kind = np.empty(n, int)
    kind[by] = np.cumsum(new) - 1
    first = by[new]
    tallest = np.full(int(page[-1]) + 1, -np.inf)
    np.maximum.at(tallest, page, height)
    row_of = np.empty(len(first), int)
    turn = np.argsort(first, kind="stable")
    at = first[turn]
    rows: list[tuple[float, float, float]] = []  # bottom, middle and height of each row's first word
    current = -1
    for k, p, down, mid, tall, most in zip(turn.tolist(), page[at].tolist(), low[at].tolist(), middle[at].tolist(), height[at].tolist(), tallest[page[at]].tolist()):
        if p != current:
            rows, current = [], p
        hit = -1
        # Rows begin in order of their bottoms (to a unit): far enough up, none can match.
        for r in range(len(rows) - 1, -1, -1):
            row_low, row_mid, row_tall = rows[r]
            if row_low < mid - 0.45 * most - 2:
                break
            if abs(row_mid - mid) < 0.45 * max(row_tall, tall):
                hit = r  # going backwards, the last hit is the first row
        if hit < 0:
            hit = len(rows)
            rows.append((down, mid, tall))
        row_of[k] = hit
    return row_of[kind]


def pdf_lines(words: DataFrame, keys: list[str] = PAGE, split: float = 1.6, together: bool = False) -> DataFrame:
    """Words to lines: text, box, median size and number of words.

    Rows are gathered by their first word's centre and split where the gap is no space.
    """
    schema = _key_schema(words, keys) + ", line_no int, x0 double, top double, x1 double, bottom double, size double, text string, words int"

    def rule(g: Columns, starts: np.ndarray) -> Columns:
        x0, x1, top, bottom, size = (g[c].astype(float) for c in ("x0", "x1", "top", "bottom", "size"))
        page = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x0))))
        order = np.lexsort((x0, np.round(bottom), page))
        row = np.empty(len(x0), int)
        row[order] = _rows(page[order], bottom[order], ((top + bottom) / 2)[order], (bottom - top)[order])
        # Stable by x within a row, in the order words came to it.
        arrived = np.empty(len(x0), int)
        arrived[order] = np.arange(len(x0))
        seq = np.lexsort((arrived, x0, row, page))
        before, here = seq[:-1], seq[1:]
        wide = x0[here] - x1[before] > np.maximum(split * np.maximum(size[here], size[before]), 14.0 if split >= 1 else 3.0)
        at = np.flatnonzero(np.append(True, (page[here] != page[before]) | (row[here] != row[before]) | wide))
        n = np.diff(np.append(at, len(seq)))
        line = np.repeat(np.arange(len(n)), n)
        sizes = size[seq][np.lexsort((size[seq], line))]
        middle = np.where(np.isnan(sizes[at + n - 1]), np.nan, (sizes[at + (n - 1) // 2] + sizes[at + n // 2]) / 2)
        of = page[seq[at]]
        return {
            "row": seq[at], "line_no": np.arange(len(n)) - np.searchsorted(of, of), "x0": np.minimum.reduceat(x0[seq], at), "top": np.minimum.reduceat(top[seq], at), "x1": np.maximum.reduceat(x1[seq], at),
            "bottom": np.maximum.reduceat(bottom[seq], at), "size": middle, "text": joined(g["text"].take(pa.array(seq)), n, " "), "words": n}

    return fold_many(words.select(*keys, "word_no", "text", "x0", "x1", "top", "bottom", "size"), keys, ["word_no"], schema, rule, together)


def merge_rules(rules: DataFrame, keys: list[str]) -> DataFrame:
    """Collinear pieces become one rule; six or more pieces with gaps between half of them a dashed one.

    ``rules`` holds dir, pos (across), a and b (along), thick and colour. A piece is compared with the
    rule it would extend: within 1 across its first piece and 6 along.
    """
    schema = _key_schema(rules, keys) + ", dir string, pos double, a double, b double, thick double, colour string, pieces int, gaps int, dashed boolean"
    keyed = rules.select(*keys, "dir", "pos", "a", "b", "thick", "colour").withColumn("_slot", F.bround(F.col("pos") * 2))

    def rule(g: Group) -> Group:
        pos, a, b = g["pos"].astype(float), g["a"].astype(float), g["b"].astype(float)
        first = 0
        reach = b[0]
        lead = np.zeros(len(a), bool)
        gaps = np.zeros(len(a), int)
        lead[0] = True
        for i in range(1, len(a)):
            gap = a[i] - reach
            if abs(pos[first] - pos[i]) <= 1.0 and gap <= 6:
                gaps[i] = gap > 0.5
                reach = max(reach, b[i])
            else:
                first, reach, lead[i] = i, b[i], True
        s = np.flatnonzero(lead)
        pieces, gap_count = np.diff(np.append(s, len(a))), np.add.reduceat(gaps, s)
        return {
            **{k: g[k][s] for k in keys}, "dir": g["dir"][s], "pos": pos[s], "a": a[s], "b": np.maximum.reduceat(b, s), "thick": np.maximum.reduceat(g["thick"].astype(float), s),
            "colour": g["colour"][s], "pieces": pieces, "gaps": gap_count, "dashed": (pieces >= 6) & (gap_count >= pieces // 2)}

    return fold_groups(keyed, [*keys, "dir"], ["_slot", "a"], schema, rule)


def find_boxes(rules: DataFrame, keys: list[str]) -> DataFrame:
    """Rectangles outlined by rules: equal top and bottom edges joined by left and right ones, innermost kept.

    Edges meet on rounded positions of their left ends, sides on rounded positions across: equi joins with
    a tolerance of 2.5, never a page's product. ``rules`` holds ordinal, dir, pos, a and b.
    """
    cell = 2.5
    rules = checkpoint(rules.select(*keys, "ordinal", "dir", "pos", "a", "b"))  # read four times
    near = lambda c: F.explode(F.array(*[F.floor(c / cell) + d for d in (-1, 0, 1)]))
    h = rules.filter((F.col("dir") == "h") & (F.col("b") - F.col("a") > 12)).select(*keys, "ordinal", F.col("pos").alias("y"), F.col("a").alias("x0"), F.col("b").alias("x1"))
    v = rules.filter((F.col("dir") == "v") & (F.col("b") - F.col("a") > 8)).select(*[F.col(k).alias(f"v_{k}") for k in keys], F.col("pos").alias("vx"), F.col("a").alias("vy0"), F.col("b").alias("vy1"))
    top = h.withColumn("_cell", near(F.col("x0")))
    low = h.select(*[F.col(k).alias(f"r_{k}") for k in keys], F.col("ordinal").alias("r_ordinal"), F.col("y").alias("r_y"), F.col("x0").alias("r_x0"), F.col("x1").alias("r_x1"), F.floor(F.col("x0") / cell).alias("_rcell"))
    same = (F.col("_cell") == F.col("_rcell")) & (F.col("r_y") - F.col("y") >= 8) & (F.abs(F.col("x0") - F.col("r_x0")) <= cell) & (F.abs(F.col("x1") - F.col("r_x1")) <= cell)
    for k in keys:
        same = same & (F.col(k) == F.col(f"r_{k}"))
    pairs = top.join(low, same).drop("_cell", "_rcell", *[f"r_{k}" for k in keys])
    sides = v.withColumn("_vcell", near(F.col("vx")))
    for x in ("x0", "x1"):
        joined = (F.floor(F.col(x) / cell) == F.col("_vcell")) & (F.abs(F.col("vx") - F.col(x)) < cell) & (F.least("vy1", "r_y") - F.greatest("vy0", "y") > 0.8 * (F.col("r_y") - F.col("y")))
        for k in keys:
            joined = joined & (F.col(k) == F.col(f"v_{k}"))
        pairs = pairs.join(sides, joined, "left_semi")
    first = pairs.groupBy(*keys, "ordinal").agg(F.min_by(F.struct(F.least("x0", "r_x0").alias("x0"), F.col("y").alias("top"), F.greatest("x1", "r_x1").alias("x1"), F.col("r_y").alias("bottom")), "r_ordinal").alias("b"))
    found = checkpoint(first.select(*keys, "ordinal", "b.*"))  # read three times
    mine, other = edges(), edges("r_")
    differs = ~((F.col("x0") == F.col("r_x0")) & (F.col("top") == F.col("r_top")) & (F.col("x1") == F.col("r_x1")) & (F.col("bottom") == F.col("r_bottom")))
    frames = band_join(found, found, keys, (F.col("top") - 1, F.col("bottom") + 1), (F.col("top"), F.col("bottom")), differs & other.within(mine, 0.5))
    return found.join(frames.select(*keys, "ordinal").distinct(), [*keys, "ordinal"], "left_anti")


def cell_sides(cells: DataFrame, rules: DataFrame, fills: DataFrame, keys: list[str], cell: str = "cell_no") -> DataFrame:
    """Which sides of a cell are drawn (thickness and colour of the last fitting rule) and the first fill over it."""
    c = edges()
    spans = {"h": ("r_pos", "r_pos", F.least("r_b", "x1") - F.greatest("r_a", "x0") > 0.6 * c.w), "v": ("r_a", "r_b", F.least("r_b", "bottom") - F.greatest("r_a", "top") > 0.6 * c.h)}
    look = F.struct(F.col("r_thick").alias("thick"), F.col("r_colour").alias("colour"))
    out = cells
    for direction, sides in (("h", ("top", "bottom")), ("v", ("x0", "x1"))):
        lo, hi, covers = spans[direction]
        touches = [F.abs(F.col("r_pos") - F.col(side)) < 2.5 for side in sides]
        pairs = band_join(cells, rules.filter(F.col("dir") == direction), keys, (F.col("top") - 2.5, F.col("bottom") + 2.5), (F.col(lo[2:]), F.col(hi[2:])), covers & (touches[0] | touches[1]))
        names = ("top_side", "bottom_side") if direction == "h" else ("left_side", "right_side")
        last = [F.max_by(F.when(t, look), F.when(t, F.col("r_ordinal"))).alias(n) for t, n in zip(touches, names)]
        out = out.join(pairs.groupBy(*keys, cell).agg(*last), [*keys, cell], "left")
    f = edges("r_")
    covered = c.within(f, 2.5) | (c.touches(f, -1) & (c.overlap(f) > 0.8 * c.area))
    shaded = band_join(cells, fills, keys, (F.col("top"), F.col("bottom")), (F.col("top") - 2.5, F.col("bottom") + 2.5), covered)
    first = shaded.groupBy(*keys, cell).agg(F.min_by("r_fill", "r_ordinal").alias("fill"))
    return out.join(first, [*keys, cell], "left")


def claim_words(words: DataFrame, owners: DataFrame, keys: list[str] = PAGE, word: str = "word_no") -> DataFrame:
    """Words with the owner that claims them (null: free).

    Tables claim first, then boxes, then drawings, each in its order: the least (priority, ordinal) of all
    owners holding the word. ``owners`` holds owner, priority, ordinal, pad and its edges.
    """
    # An owner holds a word's top edge, so that a word looks into one band only, at a list of its owners in their order.
    low, high = F.floor((F.col("top") - F.col("pad")) / BAND), F.floor(F.greatest(F.col("top") - F.col("pad"), F.col("bottom") + F.col("pad")) / BAND)
    order = F.struct("priority", "ordinal", "x0", "top", "x1", "bottom", "pad", "owner")
    lists = owners.withColumn("_band", F.explode(F.sequence(low, high))).groupBy(*keys, "_band").agg(F.array_sort(F.collect_list(order)).alias("_owners"))
    first = F.get(F.filter("_owners", lambda o: edges().within(Box(o["x0"], o["top"], o["x1"] - o["x0"], o["bottom"] - o["top"]), o["pad"])), F.lit(0))
    words = words.withColumn("_band", F.floor(F.col("top") / BAND)).join(held(lists), [*keys, "_band"], "left")
    return words.withColumn("owner", first["owner"]).drop("_band", "_owners")


def repair_lines(lines: DataFrame, readings: DataFrame, broken: str = BROKEN_TEXT, keys: list[str] = PAGE, line: str = "line_no") -> DataFrame:
    """Text of broken Devanagari lines from the second reading's lines over them, left to right.

    A broken line without such a reading loses its words that hold NUL; other lines stay.
    """
    suspect = F.col("text").rlike(tx.DEVANAGARI) & F.col("text").rlike(broken)
    bad = lines.filter(suspect)
    over = band_join(bad.select(*keys, line, "x0", "top", "x1", "bottom"), readings.filter(F.col("text").rlike(tx.DEVANAGARI)), keys, (F.col("top"), F.col("bottom")), (F.col("top"), F.col("bottom")), edges().touches(edges("r_")))
    ordered = F.array_sort(F.collect_list(F.struct("r_x0", "r_text")))
    hits = over.groupBy(*keys, line).agg(F.array_join(F.transform(ordered, lambda o: o["r_text"]), " ").alias("_read"))
    kept = F.array_join(F.filter(F.split("text", " "), lambda w: ~w.contains("\x00")), " ")
    text = F.when(F.col("_read").isNotNull(), F.col("_read")).when(suspect, kept).otherwise(F.col("text"))
    return lines.join(hits, [*keys, line], "left").withColumn("repaired", F.col("_read").isNotNull()).withColumn("text", text).drop("_read")


def _rule_pairs(words: DataFrame, rules: DataFrame, keys: list[str], word: str) -> DataFrame:
    """Words with every thin horizontal rule that hugs their bottom."""
    thin = rules.filter((F.col("dir") == "h") & (F.col("thick") <= 1.6)).select(*keys, "ordinal", "pos", "a", "b")
    drop = F.col("r_pos") - F.col("bottom") + 0.2 * F.col("size")
    fits = (F.col("x0") >= F.col("r_a") - 2) & (F.col("x1") <= F.col("r_b") + 2) & (drop >= 0) & (drop <= 0.35 * F.col("size"))
    pairs = band_join(words.select(*keys, word, "x0", "x1", "bottom", "size"), thin, keys, (F.col("bottom") - F.col("size"), F.col("bottom") + F.col("size")), (F.col("pos"), F.col("pos")), fits, few="right")
    return pairs.select(*keys, word, "r_ordinal", (F.col("r_b") - F.col("r_a")).alias("_long"), (F.col("x1") - F.col("x0")).alias("_wide"))


def _underlines(over) -> Column:
    """Whether a rule is hardly longer than its words; ``over`` says how an aggregate sees the rule's pairs."""
    return over(F.max("_long")) <= over(F.sum("_wide")) + 6 * over(F.count(F.lit(1))) + 4


def dividers(words: DataFrame, rules: DataFrame, keys: list[str] = PAGE, word: str = "word_no") -> DataFrame:
    """The rules that underline no words."""
    real = _rule_pairs(words, rules, keys, word).groupBy(*keys, "r_ordinal").agg(_underlines(lambda a: a).alias("_real")).filter("_real")
    return rules.join(held(real.select(*keys, F.col("r_ordinal").alias("ordinal"))), [*keys, "ordinal"], "left_anti")


def mark_underlines(words: DataFrame, rules: DataFrame, keys: list[str] = PAGE, word: str = "word_no") -> tuple[DataFrame, DataFrame]:
    """Words with an ``underline`` flag, and the rules that are no underline.

    A thin horizontal rule hugging the bottom of words underlines them if it is hardly longer than they are.
    """
    rule = Window.partitionBy(*keys, "r_ordinal")
    under = _rule_pairs(words, rules, keys, word).withColumn("_real", _underlines(lambda a: a.over(rule))).filter("_real").select(*keys, word).distinct().withColumn("underline", F.lit(True))
    marked = words.join(under, [*keys, word], "left").withColumn("underline", F.coalesce("underline", F.lit(False)))
    return marked, dividers(words, rules, keys, word)


def bullets(shapes: DataFrame, words: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """Small near-square shapes just left of a word, as words holding a bullet."""
    w, h = F.col("x1") - F.col("x0"), F.col("bottom") - F.col("top")
    small = shapes.filter((F.col("filled") | F.col("stroked")) & w.between(1.8, 8) & h.between(1.8, 8) & (w / h).between(0.6, 1.7))
    middle = (F.col("top") + F.col("bottom")) / 2
    gap = F.col("r_x0") - F.col("x1")
    leads = (gap > 0) & (gap < 22) & (F.col("r_top") <= middle) & (middle <= F.col("r_bottom"))
    dots = band_join(small.select(*keys, "shape_no", "x0", "top", "x1", "bottom"), words.select(*keys, "x0", "top", "bottom"), keys, (middle, middle), (F.col("top"), F.col("bottom")), leads, few="left")
    dots = dots.select(*keys, "shape_no", "x0", "top", "x1", "bottom").distinct()
    return dots.select(*keys, "shape_no", F.lit("•").alias("text"), "x0", (F.col("x1") + 0.5).alias("x1"), (F.col("top") - 2).alias("top"), (F.col("bottom") + 2).alias("bottom"), F.greatest(F.lit(6.0), h * 2.6).alias("size"))


def page_class(pages: DataFrame, words: DataFrame, rules: DataFrame, pictures: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """Form or flow, per page: stray vertical rules, and the share of words inside one drawing.

    ``pages`` holds width and height; ``pictures`` holds ordinal, kind (image or drawing) and its edges.
    A picture is background if it covers over half of the page or more than three words.
    """
    touching = band_join(words.select(*keys, "word_no", "x0", "top", "x1", "bottom"), pictures, keys, (F.col("top"), F.col("bottom")), (F.col("top"), F.col("bottom")), edges().touches(edges("r_"), -1) | edges().within(edges("r_"), 1), few="right")
    counted = touching.groupBy(*keys, F.col("r_ordinal").alias("ordinal")).agg(
        F.count_if(edges().touches(edges("r_"), -1)).alias("covered"), F.count_if(edges().within(edges("r_"), 1)).alias("inside"))
    p = pictures.join(counted, [*keys, "ordinal"], "left").join(pages, keys)
    background = (F.col("kind") == "image") & ((edges().area > 0.5 * F.col("width") * F.col("height")) | (F.coalesce("covered", F.lit(0)) > 3))
    per_picture = p.groupBy(*keys).agg(F.count_if(background).alias("backgrounds"), F.max(F.when(F.col("kind") == "drawing", F.coalesce("inside", F.lit(0)))).alias("_figure"))
    verticals = rules.filter((F.col("dir") == "v") & (F.col("b") - F.col("a") > 10)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_v"))
    total = words.groupBy(*keys).agg(F.count(F.lit(1)).alias("_w"))
    out = pages.join(total, keys, "left").join(verticals, keys, "left").join(per_picture, keys, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    form = (zero("_v") >= 4) | (zero("_figure") > 0.3 * F.greatest(F.lit(1), zero("_w")))
    return out.select(*keys, F.when(form, "form").otherwise("flow").alias("page_class"), zero("backgrounds").alias("backgrounds"))


def _alone(page: np.ndarray, starts: np.ndarray, x0: np.ndarray, x1: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Narrow lines that share a baseline with a narrow line beside them, of many pages."""
    whole = np.maximum.reduceat(x1, starts) - np.minimum.reduceat(x0, starts)
    whole[whole == 0] = 1
    few = np.flatnonzero(x1 - x0 <= 0.35 * whole[page])
    few = few[np.lexsort((base[few], page[few]))]
    alone = np.zeros(len(page), bool)
    # Of lines in the order of their bases, those of the next places, as long as any lies near.
    d = 1
    while d < len(few):
        a, b = few[:-d], few[d:]
        near = (page[a] == page[b]) & (np.abs(base[a] - base[b]) < 2)
        if not near.any():
            break
        beside = near & ((x1[b] < x0[a]) | (x0[b] > x1[a]))
        alone[a[beside]] = True
        beside = near & ((x1[a] < x0[b]) | (x0[a] > x1[b]))
        alone[b[beside]] = True
        d += 1
    return alone


def _blocks(x0: list[float], x1: list[float], top: list[float], bottom: list[float], size: list[float], base: list[float], text: list[str], alone: list[bool], marker: re.Pattern) -> list[int]:
    """Block of every line of a page."""
    n = len(x0)
    block = [-1] * n
    members: list[list[int]] = []
    box: list[list[float]] = []
    ends: list[tuple[float, float]] = []  # the least and greatest right end of a block's lines but its last

    def follows(i: int, k: int) -> bool | None:
        """True: continues block k; False: starts anew below it; None: k is not the paragraph above."""
        own = members[k]
        last = own[-1]
        s = max(size[i], size[last])
        gap = top[i] - bottom[last]
        left, right = box[k]
        shared = min(right, x1[i]) - max(left, x0[i])
        if not (-0.3 * s <= gap <= 0.75 * s and shared > 0.3 * min(x1[i] - x0[i], right - left)):
            return None
        if abs(size[i] - size[last]) > 0.12 * s or marker.match(text[i]):
            return False
        if len(own) >= 2:
            low, high = ends[k]
            if high - low < 0.6 * s and x1[last] < max(high, x1[last]) - 1.5 * s:
                return False
            if x0[i] > left + 0.6 * s and abs(x1[last] - right) < 0.6 * s and x1[i] > right - 0.6 * s:
                return False
            pitch = base[last] - base[own[-2]]
            if abs(base[i] - base[last] - pitch) > 0.15 * pitch:
                return False
        return True

    for i in sorted(range(n), key=lambda i: (top[i], x0[i])):
        target = -1
        if not alone[i]:
            for k in range(len(members) - 1, max(-1, len(members) - 1 - RECENT_BLOCKS), -1):
                if alone[members[k][0]]:
                    continue
                answer = follows(i, k)
                if answer is not None:
                    target = k if answer else -1
                    break
        if target < 0:
            target = len(members)
            members.append([])
            box.append([x0[i], x1[i]])
            ends.append((float("inf"), float("-inf")))
        if members[target]:
            last = x1[members[target][-1]]
            ends[target] = (min(ends[target][0], last), max(ends[target][1], last))
        members[target].append(i)
        box[target] = [min(box[target][0], x0[i]), max(box[target][1], x1[i])]
        block[i] = target
    return block


def block_boxes(lines: DataFrame, keys: list[str] = PAGE, together: bool = False) -> DataFrame:
    """The blocks of ``text_blocks`` themselves: box, number of lines, and their texts from top to bottom, a line each."""
    schema = _key_schema(lines, keys) + ", block_no int, x0 double, top double, x1 double, bottom double, lines int, text string"
    marker = re.compile(FLOW_MARKER)

    def rule(g: Columns, starts: np.ndarray) -> Columns:
        page, block, _ = _all_blocks(g, starts, marker)
        x0, x1, top, bottom = (g[c].astype(float) for c in ("x0", "x1", "top", "bottom"))
        order = np.lexsort((g["line_no"], x0, top, block, page))
        at = np.flatnonzero(np.append(True, (np.diff(page[order]) != 0) | (np.diff(block[order]) != 0)))
        n = np.diff(np.append(at, len(order)))
        return {
            "row": order[at], "block_no": block[order[at]], "x0": np.minimum.reduceat(x0[order], at), "top": np.minimum.reduceat(top[order], at), "x1": np.maximum.reduceat(x1[order], at),
            "bottom": np.maximum.reduceat(bottom[order], at), "lines": n, "text": joined(g["text"].take(pa.array(order)), n, "\n")}

    return fold_many(lines.select(*keys, "line_no", "x0", "top", "x1", "bottom", "size", "text"), keys, ["line_no"], schema, rule, together)


def _all_blocks(g: Columns, starts: np.ndarray, marker: re.Pattern) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Page and block of the lines of many pages, and whether they stand alone as part of a tabular row."""
    x0, x1, top, bottom, size = (g[c].astype(float) for c in ("x0", "x1", "top", "bottom", "size"))
    base = bottom - 0.2 * size
    page = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x0))))
    alone = _alone(page, starts, x0, x1, base)
    columns = [v.tolist() for v in (x0, x1, top, bottom, size, base)] + [g["text"].to_pylist(), alone.tolist()]
    block: list[int] = []
    for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(x0)]):
        block += _blocks(*(v[lo:hi] for v in columns), marker)
    return page, np.array(block), alone


def text_blocks(lines: DataFrame, keys: list[str] = PAGE, together: bool = False, keep: bool = False) -> DataFrame:
    """Lines with their paragraph block and a ``tabular`` flag; with ``keep`` also their box, size and text.

    A line is compared with the block as grown so far, among the last twelve.
    """
    kept = {"x0": "double", "top": "double", "x1": "double", "bottom": "double", "size": "double", "text": "string"} if keep else {}
    schema = _key_schema(lines, keys) + ", line_no int, block_no int, tabular boolean" + "".join(f", {c} {t}" for c, t in kept.items())
    marker = re.compile(FLOW_MARKER)

    def rule(g: Columns, starts: np.ndarray) -> Columns:
        _, block, alone = _all_blocks(g, starts, marker)
        return {"row": np.arange(len(block)), "line_no": g["line_no"], "block_no": block, "tabular": alone, **{c: g[c] for c in kept}}

    return fold_many(lines.select(*keys, "line_no", "x0", "top", "x1", "bottom", "size", "text"), keys, ["line_no"], schema, rule, together)


def _cut(items: np.ndarray, g: Group, depth: int) -> list[int]:
    """Reading order of a region: along gutters first, then across gaps, else top to bottom."""
    x0, top, x1, bottom = (g[c] for c in ("x0", "top", "x1", "bottom"))
    flow = lambda part: [int(i) for i in part[np.lexsort((x0[part], top[part]))]]
    if len(items) == 1 or depth > MAX_DEPTH:
        return flow(items)
    rule, wide = g["rule"], x1 - x0
    region = x1[items].max() - x0[items].min()

    def gutters(part: np.ndarray) -> list[tuple[float, float]]:
        part = part[np.lexsort((x1[part], x0[part]))]
        reach = np.maximum.accumulate(x1[part])
        at = np.flatnonzero(x0[part][1:] - reach[:-1] >= GUTTER) if len(part) else []
        return [(float(reach[i]), float(x0[part][i + 1])) for i in at]

    open_spans = items[~rule[items] | (wide[items] < 0.6 * region)]
    cuts = np.array([(a + b) / 2 for a, b in gutters(open_spans)])
    if len(cuts):
        crossing = np.array([rule[i] and ((x0[i] < cuts) & (cuts < x1[i])).any() for i in items])
        side = ((x0[items] + x1[items])[:, None] / 2 > cuts).sum(axis=1)
        columns = [items[(side == s) & ~crossing] for s in range(len(cuts) + 1)]
        columns = [c for c in columns if len(c)]
        if len(columns) > 1 and not crossing.any():
            return [i for c in columns for i in _cut(c, g, depth + 1)]
    ordered = items[np.argsort(top[items], kind="stable")]
    reach = np.maximum.accumulate(bottom[ordered])
    bands = np.split(ordered, np.flatnonzero(top[ordered][1:] >= reach[:-1] - 0.5) + 1)
    if len(bands) == 1:
        return flow(items)
    far = wide > 0.6 * region
    full = [bool(far[b[0]] if len(b) == 1 else far[b].any()) for b in bands]

    def running_columns(part: np.ndarray) -> bool:
        found = gutters(part[~rule[part]])
        if not found:
            return False
        a = found[0][1]
        text = g["text"][part]
        # The gutter is tested by where its right side begins.
        left, right = part[text & (x1[part] <= a)], part[text & (x0[part] >= a)]
        return g["lines"][left].sum() >= 3 and g["lines"][right].sum() >= 3

    regions: list[np.ndarray] = []
    i = 0
    while i < len(bands):
        j = i + 1
        while j < len(bands) and not full[i] and not full[j]:
            j += 1
        joined = np.concatenate(bands[i:j])
        regions.extend([joined] if j - i > 1 and running_columns(joined) else bands[i:j])
        i = j
    if len(regions) == 1 and len(regions[0]) == len(items):
        # Nothing was cut off: go deeper on the same items until the depth says stop.
        return _cut(regions[0], g, depth + 1)
    return [k for r in regions for k in ([int(r[0])] if len(r) == 1 else _cut(r, g, depth + 1))]


def xy_cut_order(elements: DataFrame, keys: list[str] = PAGE, ident: str = "element_no", keep: bool = False) -> DataFrame:
    """(keys, element, position): column by column by recursive cuts of the page; with ``keep`` all columns and position.

    ``elements`` holds kind (text, rule, image, table), edges and lines (number of text lines).
    """
    columns = elements.columns if keep else [*keys, ident]
    schema = _key_schema(elements, columns) + ", position int" if keep else _key_schema(elements, keys) + f", {ident} int, position int"

    def rule(g: Columns, starts: np.ndarray) -> Columns:
        boxes = {c: g[c].astype(float) for c in ("x0", "top", "x1", "bottom")}
        boxes.update({k: pc.fill_null(pc.equal(g["kind"], k), False).to_numpy(zero_copy_only=False) for k in ("rule", "text")}, lines=g["lines"])
        n = np.diff(np.append(starts, len(boxes["x0"])))
        row = np.concatenate([lo + np.array(_cut(np.arange(size), {c: v[lo:lo + size] for c, v in boxes.items()}, 0)) for lo, size in zip(starts.tolist(), n.tolist())])
        return {"row": row, **{c: _at(g[c], row) for c in columns if c not in keys}, "position": ranges(n)}

    used = dict.fromkeys([*keys, ident, "kind", "x0", "top", "x1", "bottom", "lines", *columns])
    return fold_many(elements.select(*used), keys, [ident], schema, rule)
