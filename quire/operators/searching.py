"""Search and edit over tables of texts: ranked keywords, phrases, highlights, find and replace."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import html as ht
from quire.functions import text as tx
from quire.functions import unicode as un
from quire.plans.segments import merge_ranges, with_previous


def keyword_scores(items: DataFrame, query: str, name: str, rest: list[str]) -> DataFrame:
    """Items with a score: per word of the query name prefix 3, name 2, anywhere else 1; null if a word is missing."""
    words = un._fold(query).split()
    if not words:
        return items.withColumn("score", F.lit(0)).limit(0)
    out = items.withColumn("_name", un.fold(F.coalesce(name, F.lit("")))).withColumn("_rest", un.fold(F.concat_ws(" ", *rest)))
    score = F.lit(0)
    for word in words:
        # A word that matches nowhere is null, and so is the sum.
        score = score + F.when(F.col("_name").startswith(word), 3).when(F.col("_name").contains(word), 2).when(F.col("_rest").contains(word), 1)
    return out.withColumn("score", score).drop("_name", "_rest")


def keyword_search(items: DataFrame, query: str, k: int, name: str, rest: list[str], ordinal: str) -> DataFrame:
    """The best ``k`` items; ties keep the table's order."""
    # Filtered after the limit: before it, the optimizer would repeat the folded texts inside the filter.
    return keyword_scores(items, query, name, rest).orderBy(F.desc_nulls_last("score"), ordinal).limit(k).filter("score > 0")


def grouped_search(hits: DataFrame, group: str, item: str, ordinal: str) -> DataFrame:
    """Hits in groups, groups by their best hit; an item listed in several groups stays in its first."""
    columns = hits.columns
    rows = hits.groupBy(item).agg(F.min_by(F.struct(*columns), ordinal).alias("h")).select("h.*")
    best = rows.groupBy(group).agg(F.max(F.struct("score", (-F.col(ordinal)).alias("o"))).alias("b"))
    best = best.select(group, F.col("b.score").alias("group_score"), (-F.col("b.o")).alias("group_first"))
    return rows.join(best, group).orderBy(F.desc("group_score"), "group_first", F.desc("score"), ordinal)


# Matches are located in blocks of this many, so that a text with very many costs little more than its length.
_BLOCK = 64


def match_positions(text: Column, pattern: str, limit: Column | None = None, few: bool = False) -> Column:
    """Array of (start, end), code points from 0, of every match in a text.

    ``few`` is for texts known to be short (a line): the positions are then added up in one go.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if limit is not None:
        found = F.slice(found, F.lit(1), limit)
    row = F.struct(F.split(text, pattern, -1).alias("gaps"), found.alias("found"))

    def bind(value: Column, use) -> Column:
        return F.element_at(F.transform(F.array(value), use), 1)

    def locate(pairs: Column, at: Column) -> Column:
        zero = F.struct(at.cast("int").alias("at"), F.expr("array()").cast("array<struct<start:int,end:int>>").alias("out"))

        def step(acc: Column, pair: Column) -> Column:
            start = acc["at"] + pair["gap"]
            end = start + pair["word"]
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end")))).alias("out"))

        return F.aggregate(pairs, zero, step)["out"]

    def total(lengths: Column) -> Column:
        return F.aggregate(lengths, F.lit(0), lambda n, v: n + v)

    def in_blocks(pairs: Column) -> Column:
        part = lambda b: F.slice(pairs, b * _BLOCK + 1, F.lit(_BLOCK))
        blocks = F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / _BLOCK).cast("int"))
        sums = F.transform(blocks, lambda b: total(F.transform(part(b), lambda p: p["gap"] + p["word"])))
        return bind(sums, lambda s: F.flatten(F.transform(blocks, lambda b: locate(part(b), total(F.slice(s, F.lit(1), b))))))

    def use(b: Column) -> Column:
        pairs = F.zip_with(b["found"], F.slice(b["gaps"], F.lit(1), F.size(b["found"])), lambda w, g: F.struct(F.length(w).alias("word"), F.length(g).alias("gap")))
        return bind(pairs, (lambda p: locate(p, F.lit(0))) if few else in_blocks)

    # A limit of none, or a text without a match, leaves no pairs to locate.
    some = text.rlike(pattern) if limit is None else text.rlike(pattern) & (limit > 0)
    return F.when(some, bind(row, use))


def phrase_search(pages: DataFrame, query: str, doc: str, page: str | None, text: str = "text", match_case: bool = False, limit: int | None = None) -> DataFrame:
    """All hits of a phrase: document, page, start, end; with a ``limit`` the first so many per document, first pages first.

    Query and text are taken in NFC; positions count the composed text.
    """
    pattern = tx.phrase_pattern(unicodedata.normalize("NFC", query), match_case)
    keys = [doc] + ([page] if page else [])
    rows = pages.select(*keys, un.composed(F.col(text)).alias(text))
    if pattern is None:
        return rows.limit(0).select(*keys, F.lit(0).alias("start"), F.lit(0).alias("end"))
    rows = rows.filter(F.col(text).rlike(pattern))
    room = None if limit is None else F.lit(limit)
    if page and limit is not None:
        rows = rows.withColumn("_n", F.least(tx.count(F.col(text), pattern), F.lit(limit)))
        rows = with_previous(rows, [doc], [page], F.floor(F.col(page) / 256), {"_earlier": ("sum", F.col("_n"))})
        rows = rows.withColumn("_room", (F.lit(limit) - F.least(F.col("_earlier"), F.lit(limit))).cast("int")).filter("_room > 0")
        room = F.col("_room")
    hits = rows.select(*keys, F.explode(match_positions(F.col(text), pattern, room)).alias("m"))
    return hits.select(*keys, "m.start", "m.end")


def highlights(docs: DataFrame, query: str, key: str, text: str = "text") -> DataFrame:
    """Where the words of a query appear, as merged ranges. Texts whose length changes in lower case have none."""
    words = [w.lower() for w in query.split()]
    lowered = docs.select(key, F.lower(text).alias("_t"), F.length(text).alias("_n")).filter(F.length("_t") == F.col("_n"))
    empty = F.expr("array()").cast("array<struct<start:int,end:int>>")
    ranges = F.concat(*[F.coalesce(match_positions(F.col("_t"), tx.escape_pattern(w)), empty) for w in words]) if words else empty
    hits = lowered.select(key, F.explode(ranges).alias("m")).select(key, "m.start", "m.end")
    return merge_ranges(hits, [key])


def find_replace(docs: DataFrame, query: str, replacement: str, text: str = "text", match_case: bool = False, whole_word: bool = False) -> DataFrame:
    """Texts with every match replaced, and how many there were. The query and the text are taken in NFC."""
    if not query:
        return docs.withColumn("hits", F.lit(0))
    pattern = tx.find_pattern(unicodedata.normalize("NFC", query), match_case, whole_word)
    replacement = unicodedata.normalize("NFC", replacement)
    return docs.withColumn(text, un.composed(F.col(text))).withColumn("hits", tx.count(F.col(text), pattern)).withColumn(text, F.regexp_replace(text, pattern, tx.quote_replacement(replacement)))


def metadata_audit(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Per page: title over 70 characters, description outside 70 to 165, and whether it is listed.

    The description is the page's own, else its first paragraph. A page that names another address as
    its canonical one is left out of the address list.
    """
    t = F.col(html)
    meta = F.regexp_extract(t, r'(?is)<meta\s+name="description"\s+content="([^"]*)"', 1)
    title = F.trim(ht.html_text(ht.element_text(t, "title")))
    description = F.trim(F.when(meta != "", meta).otherwise(ht.html_text(ht.element_text(t, "p"))))
    canonical = F.regexp_extract(t, r'(?is)<link\s+rel="canonical"\s+href="([^"]*)"', 1)
    # The lengths a search result shows.
    return pages.select(
        *[c for c in pages.columns if c != html],
        F.length(title).alias("title_length"), (F.length(title) > 70).alias("long_title"),
        F.length(description).alias("description_length"), (~F.length(description).between(70, 165)).alias("bad_description"),
        ((canonical == "") | (canonical == F.col(url))).alias("listed"),
    )
