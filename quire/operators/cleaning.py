"""Corpus cleaning: every rule works inside the document's own row, so nothing is shuffled.

A document is one string. Its paragraphs, lines and pieces of lines are arrays of that row, and the
rules are regular expressions and array functions over them. A source with a third of all documents
is therefore no hotter than any other. Counting fixes costs a second pass of a pattern only in
documents the pattern changed.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as tx

ALL_RULES = frozenset(tx.CLEAN_RULES) - {"blankParagraphs"}
INLINE_ORDER = ("specialCharacters", "punctuation", "ocrSpacing", "extraSpaces")

# Internal marks, Unicode noncharacters: a paragraph boundary, and two pieces of one line.
_PARA = "﷐"
_GLUE = "﷑"


def _let(value: Column, use) -> Column:
    """Names an expression inside an array lambda, where repeated use would mean repeated work."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _rule_set(rules: Iterable[str] | None) -> frozenset:
    chosen = ALL_RULES if rules is None else frozenset(rules)
    unknown = chosen - set(tx.CLEAN_RULES)
    if unknown:
        raise ValueError(f"unknown rules: {sorted(unknown)}")
    return chosen


def _beyond_latin(pattern: str) -> bool:
    """A class of characters none of which Latin text holds (typographic quotes)."""
    return pattern.startswith(r"[\x{20")


def _inline(df: DataFrame, chosen: frozenset) -> DataFrame:
    # Paragraph marks are beyond Latin themselves, so the width is that of the text without them.
    df = df.withColumn("_wide", F.replace(F.col("_t"), F.lit(_PARA), F.lit("\n")).rlike(tx.WIDE))
    for rule in INLINE_ORDER:
        if rule not in chosen:
            continue
        for pattern, replacement in tx.INLINE_RULES[rule]:
            plain = F.col("_t") if _beyond_latin(pattern) else F.regexp_replace("_t", tx.narrow(pattern), replacement)
            df = df.withColumn("_next", F.when(F.col("_wide"), F.regexp_replace("_t", pattern, replacement)).otherwise(plain))
            found = F.when(F.col("_next") == F.col("_t"), 0).otherwise(tx.count(F.col("_t"), pattern))
            df = df.withColumn(rule, F.col(rule) + found).withColumn("_t", F.col("_next")).drop("_next")
    return df.drop("_wide")


def _join_breaks(df: DataFrame) -> DataFrame:
    """Replaces a break in mid-sentence by a glued space (or nothing, after a hyphen)."""
    df = df.withColumn("_l", F.split("_t", "\n"))

    def joins(i: Column) -> Column:
        before, after = F.get(F.col("_l"), i - 1), F.get(F.col("_l"), i)
        # Only the first and last part of a line that holds a paragraph mark is a line of its own.
        before, after = F.element_at(F.split(before, _PARA), -1), F.get(F.split(after, _PARA), F.lit(0))
        return (i > 0) & ~tx.is_blank(before) & ~before.rlike(tx.LINE_COMPLETE) & after.rlike(tx.LINE_CONTINUES)

    df = df.withColumn("_j", F.transform("_l", lambda line, i: F.coalesce(joins(i), F.lit(False))))

    def piece(line: Column, i: Column) -> Column:
        hyphen_before = F.get(F.col("_l"), i - 1).rlike(tx.LINE_HYPHEN)
        lead = (
            F.when(i == 0, F.lit("")).when(~F.get(F.col("_j"), i), F.lit("\n"))
            .when(hyphen_before, F.lit(_GLUE)).otherwise(F.lit(_GLUE + " " + _GLUE))
        )
        cut = F.coalesce(F.get(F.col("_j"), i + 1), F.lit(False)) & line.rlike(tx.LINE_HYPHEN)
        return F.concat(lead, F.when(cut, F.substring(line, F.lit(1), F.length(line) - 1)).otherwise(line))

    joined = F.aggregate("_j", F.lit(0), lambda n, j: n + j.cast("int"))
    df = df.withColumn("joinLines", F.col("joinLines") + joined)
    return df.withColumn("_t", F.array_join(F.transform("_l", piece), "")).drop("_l", "_j")


def _drop_breaks(df: DataFrame, rule: str) -> DataFrame:
    """Within a paragraph: a break right after a blank line goes (all of them, or the third and later)."""
    blank = "[" + tx.SPACE.replace(r"\n", "") + "]*"
    # A run of breaks with only blanks between: \G continues the run just cut, so all after the first go.
    kept = r"\n" if rule == "blankParagraphs" else r"\n" + blank + r"\n"
    pattern = r"((?!\A)\G|" + kept + ")(" + blank + r")\n"
    df = df.withColumn("_next", F.regexp_replace("_t", pattern, "$1$2" + _GLUE))
    found = F.when(F.col("_next") == F.col("_t"), 0).otherwise(tx.count(F.col("_t"), pattern))
    return df.withColumn(rule, F.col(rule) + found).withColumn("_t", F.col("_next")).drop("_next")


def _nested(df: DataFrame) -> DataFrame:
    return df.withColumn("_p", F.transform(F.split("_t", _PARA), lambda p: F.split(p, "\n")))


def _key(line: Column) -> Column:
    return tx.strip(F.replace(line, F.lit(_GLUE), F.lit("")))


def _drop_repeats(df: DataFrame) -> DataFrame:
    """Within a paragraph: a line equal to the line above goes."""
    def kept(lines: Column) -> Column:
        def use(pair: Column) -> Column:
            def fresh(line: Column, i: Column) -> Column:
                key = F.get(pair["keys"], i)
                return (i == 0) | (key == "") | (key != F.get(pair["keys"], i - 1))
            return F.filter(pair["lines"], fresh)
        return _let(F.struct(lines.alias("lines"), F.transform(lines, _key).alias("keys")), use)

    df = df.withColumn("_q", F.transform("_p", kept))
    gone = F.size(F.flatten("_p")) - F.size(F.flatten("_q"))
    return df.withColumn("duplicateLines", F.col("duplicateLines") + gone).withColumn("_p", F.col("_q")).drop("_q")


def _trim_edges(df: DataFrame) -> DataFrame:
    """White space at line ends, and where a joined piece meets the one before it."""
    ends = lambda p: tx.strip_right(p) != p

    def pieces(line: Column) -> Column:
        def use(ps: Column) -> Column:
            def trimmed(p: Column, j: Column) -> Column:
                before = F.get(ps, j - 1)
                emptied = tx.is_blank(before) & ((j == 1) | F.coalesce(ends(F.get(ps, j - 2)), F.lit(False)))
                left = (j == 0) | (ends(before) & ~emptied)
                out = F.when(left, tx.strip_left(p)).otherwise(p)
                return F.when(j == F.size(ps) - 1, tx.strip_right(out)).otherwise(out)
            return F.transform(ps, trimmed)
        return _let(F.split(line, _GLUE), use)

    df = df.withColumn("_q", F.transform("_p", lambda lines: F.transform(lines, pieces)))
    old = F.flatten(F.transform("_p", lambda lines: F.flatten(F.transform(lines, lambda l: F.split(l, _GLUE)))))
    new = F.flatten(F.transform("_q", lambda lines: F.flatten(lines)))
    changed = F.aggregate(F.zip_with(old, new, lambda a, b: F.when(a == b, 0).otherwise(1)), F.lit(0), lambda n, c: n + c)
    df = df.withColumn("extraSpaces", F.col("extraSpaces") + changed)
    return df.withColumn("_p", F.transform("_q", lambda lines: F.transform(lines, lambda ps: F.array_join(ps, "")))).drop("_q")


def _whole_blocks(df: DataFrame, chosen: frozenset) -> DataFrame:
    """Empty paragraphs, and paragraphs already seen in the document (the first one stays)."""
    df = df.withColumn("_b", F.transform("_p", lambda lines: F.replace(F.array_join(lines, "\n"), F.lit(_GLUE), F.lit("")))).withColumn("_k", F.transform("_b", tx.strip))
    row = F.arrays_zip(F.col("_b").alias("b"), F.col("_k").alias("k"), F.sequence(F.lit(0), F.size("_b") - 1).alias("i"))
    df = df.withColumn("_r", row)
    for rule in ("blankParagraphs", "collapseBlankLines"):
        if rule not in chosen or (rule == "collapseBlankLines" and "blankParagraphs" in chosen):
            continue
        first = F.lit(False) if rule == "blankParagraphs" else None
        keep = F.filter("_r", lambda r: (r["k"] != "") | (first if first is not None else ((r["i"] == 0) | (F.get(F.col("_k"), r["i"] - 1) != ""))))
        df = df.withColumn("_q", keep).withColumn(rule, F.col(rule) + F.size("_r") - F.size("_q")).withColumn("_r", F.col("_q")).drop("_q")
    if "duplicateLines" in chosen:
        # Sorted by (text, position), a repeat follows its equal; then back to document order.
        ordered = F.array_sort(F.transform("_r", lambda r: F.struct(r["k"].alias("k"), r["i"].alias("i"), r["b"].alias("b"))))
        df = df.withColumn("_s", ordered)
        keep = F.filter("_s", lambda r, i: (r["k"] == "") | (i == 0) | (F.get(F.col("_s"), i - 1)["k"] != r["k"]))
        df = df.withColumn("_q", keep).withColumn("duplicateLines", F.col("duplicateLines") + F.size("_s") - F.size("_q"))
        back = F.array_sort(F.transform("_q", lambda r: F.struct(r["i"].alias("i"), r["b"].alias("b"))))
        df = df.withColumn("_b", F.transform(back, lambda r: r["b"])).drop("_s", "_q")
    else:
        df = df.withColumn("_b", F.transform("_r", lambda r: r["b"]))
    return df.withColumn("_t", F.array_join("_b", "\n\n")).drop("_b", "_k", "_r", "_p")


def clean_documents(docs: DataFrame, rules: Iterable[str] | None = None, text: str = "text", block_split: str = "blank", case_mode: str | None = None) -> DataFrame:
    """Cleaned text and one count column per rule.

    ``block_split="line"`` treats every line as a paragraph, so repeats are found anywhere in the
    document, not only next to each other. ``case_mode`` is an optional last stage, counted per
    document it changed.
    """
    chosen = _rule_set(rules)
    if block_split not in ("blank", "line"):
        raise ValueError(f"unknown block_split: {block_split}")
    gap = r"\n{2,}" if block_split == "blank" else r"\n+"
    df = docs.withColumn("_t", F.regexp_replace(tx.unix_lines(F.col(text)), gap, _PARA))
    df = df.withColumns({rule: F.lit(0) for rule in tx.CLEAN_RULES})
    df = _inline(df, chosen)
    if "joinLines" in chosen:
        df = _join_breaks(df)
    for rule in ("blankParagraphs", "collapseBlankLines"):
        if rule in chosen and not (rule == "collapseBlankLines" and "blankParagraphs" in chosen):
            df = _drop_breaks(df, rule)
    df = _nested(df)
    if "duplicateLines" in chosen:
        df = _drop_repeats(df)
    if chosen & {"extraSpaces", "ocrSpacing"}:
        df = _trim_edges(df)
    df = _whole_blocks(df, chosen)
    if case_mode:
        df = df.withColumn("_c", tx.convert_case(F.col("_t"), case_mode)).withColumn("caseChanged", (F.col("_c") != F.col("_t")).cast("int")).withColumn("_t", F.col("_c")).drop("_c")
    return df.withColumn(text, F.col("_t")).drop("_t")


def join_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    return clean_documents(docs, ["joinLines"], text)


def drop_blanks(docs: DataFrame, text: str = "text", keep_one: bool = False) -> DataFrame:
    return clean_documents(docs, ["collapseBlankLines" if keep_one else "blankParagraphs"], text)


def dedup_lines(docs: DataFrame, text: str = "text", block_split: str = "blank") -> DataFrame:
    return clean_documents(docs, ["duplicateLines"], text, block_split)


def clean_report(docs: DataFrame, by: list[str], rules: Iterable[str] | None = None, text: str = "text", block_split: str = "blank") -> DataFrame:
    """Fixes per group and rule, long form: (by…, rule, fixes, documents touched)."""
    cleaned = clean_documents(docs.select(*by, text), rules, text, block_split)
    long = cleaned.select(*by, F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).cast("long").alias("n")) for r in tx.CLEAN_RULES])).alias("r"))
    return long.groupBy(*by, "r.rule").agg(F.sum("r.n").alias("fixes"), F.count_if(F.col("r.n") > 0).alias("documents"))
