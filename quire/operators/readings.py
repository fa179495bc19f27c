"""Two readings of the same page: how far they agree, which pages need the second one, which one stands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.functions import unicode as un
from quire.operators.profile import detached_share
from quire.session import checkpoint

# --- fixed values -------------------------------------------------------------------------------
# Fewer letters and digits than this is no text layer.
MIN_LETTERS = 20
# Fonts that store Nepali letters under Latin codes.
LEGACY_FONT = r"(?i)preeti|kantipur|himali|sagarmatha|aakriti|ganess?h|kanchan|shangrila|pcs.?nepali|fontasy|navjeevan"
TRUST_AGREEMENT = 0.5
TRUST_DETACHED = 0.05
# Most words of items that every task holds; more are shuffled.
KNOWN_WORDS = 2_000_000
MODES = ("auto", "text", "ocr")
# ------------------------------------------------------------------------------------------------

TOKENIZERS = {
    "reading": lambda t: tx.reading_words(t),
    "layer": lambda t: tx.reading_words(t, tx.LAYER_BREAK),
    "lower": lambda t: tx.lower_words(t),
}


def bag_counts(df: DataFrame, keys: list[str], tokens: Column, sign: str) -> DataFrame:
    """(keys, word, left, right) rows; a text without words keeps its key through a null word."""
    one, none = F.when(F.col("word").isNotNull(), 1).otherwise(0), F.lit(0)
    exploded = df.select(*keys, F.explode_outer(tokens).alias("word"))
    return exploded.select(*keys, "word", (one if sign == "left" else none).alias("left"), (one if sign == "right" else none).alias("right"))


def agreement(left: DataFrame, right: DataFrame, key: list[str], text: str = "text", tokenizer: str = "reading", whole: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Dice coefficient of the two word bags per key, texts in NFC; 1 where neither side has words.

    Both sides are counted in one aggregation over (key, word), combined before the shuffle. With ``whole``, for keys
    of one text a side, the texts are shuffled instead, which take less room than their words; ``carry`` then names
    numbers of the right side that come along.
    """
    tokens = TOKENIZERS[tokenizer](un.composed(F.col(text)))
    if whole:
        # Composed before they are dealt out: what comes back from Python has no known place, and its words would be shuffled again.
        sides = [df.select(*key, un.composed(F.col(text)).alias(text), F.lit(side).alias("_side"), *(carry if side == "right" else ())) for df, side in ((left, "left"), (right, "right"))]
        met = sides[0].unionByName(sides[1], allowMissingColumns=True).repartition(*key).select(*key, "_side", *carry, F.explode_outer(TOKENIZERS[tokenizer](F.col(text))).alias("word"))
        count = lambda side: F.when(F.col("word").isNotNull() & (F.col("_side") == side), 1).otherwise(0).alias(side)
        both = met.select(*key, "word", *carry, count("left"), count("right"))
    else:
        both = bag_counts(left, key, tokens, "left").unionByName(bag_counts(right, key, tokens, "right"))
    carried = [F.max(c).alias(c) for c in carry]
    per_word = both.groupBy(*key, "word").agg(F.sum("left").alias("l"), F.sum("right").alias("r"), *carried)
    sums = per_word.groupBy(*key).agg(F.sum(F.least("l", "r")).alias("shared"), F.sum("l").alias("left_words"), F.sum("r").alias("right_words"), *carried)
    total = F.col("left_words") + F.col("right_words")
    return sums.withColumn("agreement", F.when(total == 0, F.lit(1.0)).otherwise(2 * F.col("shared") / total))


def row_agreement(left: Column, right: Column, tokenizer: str = "reading") -> Column:
    """The same for two texts of one row, without a shuffle: a merge walk over the two sorted bags."""
    pair = F.array(F.struct(F.array_sort(TOKENIZERS[tokenizer](left)).alias("a"), F.array_sort(TOKENIZERS[tokenizer](right)).alias("b")))

    def walk(p: Column) -> Column:
        zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("shared"))

        def step(at: Column, _: Column) -> Column:
            x, y = F.get(p["a"], at["i"]), F.get(p["b"], at["j"])
            i = F.when(x <= y, at["i"] + 1).otherwise(at["i"])
            j = F.when(x < y, at["j"]).otherwise(at["j"] + 1)
            return F.struct(i.alias("i"), j.alias("j"), F.when(x == y, at["shared"] + 1).otherwise(at["shared"]).alias("shared"))

        total = F.size(p["a"]) + F.size(p["b"])
        return F.when(total == 0, F.lit(1.0)).otherwise(2 * F.aggregate(F.sequence(F.lit(1), total), zero, step)["shared"] / total)

    return F.element_at(F.transform(pair, walk), 1)


def multiset_intersection(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Rows both sides hold, with how often both hold them."""
    both = left.select(*columns, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(*columns, F.lit(0).alias("l"), F.lit(1).alias("r")))
    counts = both.groupBy(*columns).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    return counts.select(*columns, F.least("l", "r").alias("times")).filter("times > 0")


def similar_passages(docs: DataFrame, items: DataFrame, minimum: float, doc: str = "doc_id", item: str = "item_id", text: str = "text", tokenizer: str = "lower") -> DataFrame:
    """All (document, item) pairs whose agreement reaches ``minimum``, texts in NFC.

    A pair that reaches it has lengths within ``minimum / (2 - minimum)`` of each other, and shares at least
    ``a = minimum / 2 * (n + m)`` words, repeats counted; in one order of all words, rarest first, the first
    ``n - a + 1`` of one side and ``m - a + 1`` of the other share a word. Every word travels with its place in that
    order, so that the prefixes, which depend on the pair, are a condition of the join. Documents that no item's length
    lets reach it, and words that no item holds, are left out before anything is shuffled. Nothing is capped.
    """
    if not 0 < minimum <= 1:
        raise ValueError("minimum must be above 0 and at most 1")

    def counted(df: DataFrame, key: str, words: str) -> DataFrame:
        return df.select(key, TOKENIZERS[tokenizer](un.composed(F.col(text))).alias("ws")).select(key, F.size("ws").alias(words), "ws")

    def bags(df: DataFrame, key: str, words: str, count: str, known: DataFrame | None = None) -> DataFrame:
        rows = df.select(key, words, F.explode("ws").alias("word"))
        rows = rows if known is None else rows.join(known, "word", "left_semi")
        return rows.groupBy(key, words, "word").agg(F.count(F.lit(1)).alias(count))

    def placed(df: DataFrame, key: str, count: str, place: str) -> DataFrame:
        """Words with how many of the text's known words come before them, rarest first."""
        order = Window.partitionBy(key).orderBy("documents", "word").rowsBetween(Window.unboundedPreceding, -1)
        return df.join(rarity, "word").withColumn(place, F.coalesce(F.sum(count).over(order), F.lit(0))).drop("documents")

    # Read several times below with different columns: written once instead of tokenizing again.
    item_words = checkpoint(bags(counted(items, item, "item_words"), item, "item_words", "m"))
    known = checkpoint(item_words.select("word").distinct())
    lengths = item_words.agg(F.min("item_words").alias("least"), F.max("item_words").alias("most")).first()
    # No item meets a text that the longest or the shortest of them cannot meet; a word that no item holds is only counted.
    n = F.col("doc_words")
    reach = lambda m: 2 * F.least(n, m) >= F.lit(minimum) * (n + m) - 1e-9
    near = reach(F.least(F.greatest(n, F.lit(lengths["least"])), F.lit(lengths["most"]))) if lengths["most"] else F.lit(False)
    near_docs = counted(docs, doc, "doc_words").filter(near)
    doc_words = checkpoint(bags(near_docs, doc, "doc_words", "n", F.broadcast(known) if known.count() <= KNOWN_WORDS else known))
    rarity = checkpoint(doc_words.select("word").union(item_words.select("word")).groupBy("word").agg(F.count(F.lit(1)).alias("documents")))
    left, right = placed(doc_words, doc, "n", "doc_place"), placed(item_words, item, "m", "item_place")
    # In the order of all words those that no item holds come first.
    left = left.withColumn("doc_place", F.col("doc_place") + F.col("doc_words") - F.sum("n").over(Window.partitionBy(doc)))
    # A document's words that no item could make it meet on stay behind: its partners are at least so long.
    shortest = F.ceil(F.lit(minimum) / 2 * (F.col("doc_words") + F.ceil(F.col("doc_words") * minimum / (2 - F.lit(minimum)) - 1e-9)) - 1e-9)
    left = left.filter(F.col("doc_place") < F.col("doc_words") - shortest + 1)
    least, most = F.least("doc_words", "item_words"), F.col("doc_words") + F.col("item_words")
    needed = F.ceil(F.lit(minimum) / 2 * most - 1e-9)
    early = (F.col("doc_place") < F.col("doc_words") - needed + 1) & (F.col("item_place") < F.col("item_words") - needed + 1) & (2 * least >= F.lit(minimum) * most - 1e-9)
    candidates = left.join(right, "word").filter(early).select(doc, item).distinct()
    scored = checkpoint(candidates).join(doc_words, doc).join(item_words, [item, "word"])
    out = scored.groupBy(doc, item, "doc_words", "item_words").agg(F.sum(F.least("n", "m")).alias("shared"))
    dice = 2 * F.col("shared") / (F.col("doc_words") + F.col("item_words"))
    return out.select(doc, item, "shared", dice.alias("agreement")).filter(F.col("agreement") >= minimum)


def page_reason(text: Column, images: Column, fonts: Column, mode: str = "auto") -> Column:
    """Why a page needs the expensive reading (null: it does not)."""
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    if mode == "text":
        return F.lit(None).cast("string")
    if mode == "ocr":
        return F.lit("forced")
    few = tx.count(text, r"[\p{L}\p{N}]") < MIN_LETTERS
    return (
        F.when(few, F.when((images > 0) | (text == ""), "scan"))
        .when(F.exists(fonts, lambda f: f.rlike(LEGACY_FONT)), "legacy-font")
        .when(text.rlike(tx.DEVANAGARI), "check")
    )


def route_pages(layer: DataFrame, mode: str = "auto") -> DataFrame:
    """The page layer with trimmed text and the reason for a second reading."""
    return layer.withColumn("text", tx.strip(F.col("text"))).withColumn("reason", page_reason(F.col("text"), F.col("images"), F.col("fonts"), mode))


def reconcile_readings(layer: DataFrame, readings: DataFrame, keys: list[str], mode: str = "auto") -> DataFrame:
    """Chooses per page between its own text and the second reading (``ocr_text``, ``confidence``).

    The page's own text stands if it was only to be checked and the reading confirms it; any other page
    with a reading takes the reading. A page whose reading is missing keeps what it has. Pages without
    a reason never meet the join.
    """
    routed = route_pages(layer, mode)
    read = readings.select(*keys, "ocr_text", "confidence", F.lit(True).alias("read"))
    own = F.col("text")
    j = routed.filter("reason IS NOT NULL").join(read, keys, "left").withColumn("_own", un.composed(own)).withColumn("_ocr", un.composed(F.coalesce("ocr_text", F.lit(""))))
    has = F.coalesce("read", F.lit(False))
    trusted = has & (F.col("reason") == "check") & (F.col("_ocr") != "") & (row_agreement(F.col("_own"), F.col("_ocr")) >= TRUST_AGREEMENT) & (detached_share(F.col("_own")) < TRUST_DETACHED)
    j = j.withColumn("_trusted", F.coalesce(trusted, F.lit(False)))
    kept = F.col("_trusted") | ~has
    other = F.when(F.col("_trusted"), F.struct(F.lit("ocr").alias("method"), F.col("ocr_text").alias("text"))).when(has & (own != ""), F.struct(F.lit("text").alias("method"), own.alias("text")))
    chosen = j.select(
        *keys,
        F.when(F.col("_trusted"), "text").when(has, "ocr").when(own == "", "none").otherwise("text").alias("method"),
        F.when(kept, own).otherwise(F.col("ocr_text")).alias("text"),
        other.alias("alternative"),
        F.when(has & ~F.col("_trusted"), F.when(F.col("reason") == "check", "mismatch").when(F.col("reason") != "forced", F.col("reason"))).alias("reason"),
        F.when(~has & (own == ""), "unavailable").alias("note"),
        F.when(has & ~F.col("_trusted"), F.col("confidence")).alias("confidence"),
    )
    plain = routed.filter("reason IS NULL").select(
        *keys, F.lit("text").alias("method"), "text", F.lit(None).cast(chosen.schema["alternative"].dataType).alias("alternative"),
        F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("note"), F.lit(None).cast("double").alias("confidence"))
    return chosen.unionByName(plain).withColumn("note", F.when((F.col("text") == "") & F.col("note").isNull(), "empty").otherwise(F.col("note")))


def reading_summary(readings: DataFrame, by: list[str]) -> DataFrame:
    return readings.groupBy(*by).agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if(F.col("method") == "text").alias("text_pages"),
        F.count_if(F.col("method") == "ocr").alias("ocr_pages"),
        F.count_if(F.col("note") == "unavailable").alias("unavailable"),
    )
