"""Text expressions: counting, tokenizing, cleaning patterns, case, slugs, find and replace, numbering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------------------
# What counts as white space in the source data (wider than Java's \s).
SPACE = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
SPACE_CHARS = "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
# Reading speed, words per minute.
WPM_LATIN = 238
WPM_DEVANAGARI = 180
# Cleaning rules, in reporting order.
CLEAN_RULES = ("extraSpaces", "ocrSpacing", "joinLines", "blankParagraphs", "collapseBlankLines", "duplicateLines", "punctuation", "specialCharacters")
# Character-level rules: (pattern, replacement), applied in this order.
INLINE_RULES = {
    "specialCharacters": [(r"[\x{0}-\x{8}\x{B}\x{C}\x{E}-\x{1F}\x{7F}-\x{9F}\x{AD}\x{200B}\x{2060}\x{FEFF}\x{FFFD}\x{E000}-\x{F8FF}]", "")],
    "punctuation": [
        (r"[\x{201C}\x{201D}\x{201E}\x{201F}\x{2033}]", '"'),
        (r"[\x{2018}\x{2019}\x{201A}\x{201B}\x{2032}]", "'"),
        (r"([!?])\1+", "$1"),
        (r",{2,}", ","),
        (r"\.{4,}", "..."),
    ],
    "ocrSpacing": [
        (r"[ \t]+([,.;:!?।॥)\]}])", "$1"),
        (r"([(\[{])[ \t]+", "$1"),
        (r"([,;!?।॥])(?=\p{L})", "$1 "),
        (r"(\p{Ll}{2})\.(?=\p{Lu})", "$1. "),
    ],
    "extraSpaces": [(r"[ \t\x{A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]{2,}", " ")],
}
# A line ending so is complete; a line beginning so continues the one above.
LINE_COMPLETE = r"[.!?।॥:;\"')\]][" + SPACE + r"]*\z"
LINE_CONTINUES = "^[" + SPACE + r"]*[\p{Ll}\x{900}-\x{97F}\d]"
LINE_HYPHEN = r"\p{L}-\z"
# Words that stay small inside a title.
SMALL_WORDS = ("a", "an", "the", "and", "but", "or", "nor", "for", "so", "yet", "as", "at", "by", "in", "of", "off", "on", "per", "to", "up", "via", "vs")
CASE_MODES = ("upper", "lower", "title", "sentence", "capitalize", "alternating")
CASE_WORD = r"\p{L}[\p{L}\p{M}\p{N}'’]*"
# Separators between the words two readings are compared by.
READING_BREAK = "[" + SPACE + r"।॥.,;:!?()\"'\x{2013}\x{2014}-]+"
# The same without the two dashes, for Word-style comparison.
LAYER_BREAK = "[" + SPACE + r"।॥.,;:!?()\"'-]+"
# Marks that cannot begin a Devanagari word.
DETACHED_SIGN = r"^[\x{900}-\x{903}\x{93A}-\x{94F}\x{951}-\x{957}\x{962}\x{963}]"
DEVANAGARI = r"[\x{900}-\x{97F}]"
DEVANAGARI_DIGITS = "०१२३४५६७८९"
BULLET_MARKERS = "•●○◦▪■▶►\\-–—*·✓✔"
LIST_MARKER = "^[" + SPACE + "]*([" + BULLET_MARKERS + r"]|(?:\d{1,3}|[a-zA-Z]|[ivxlcIVXLC]{1,5}|[०-९]{1,3})[.)])[" + SPACE + "]+"
BULLET_START = "^[" + SPACE + "]*[" + BULLET_MARKERS + "]"
ORDERED_START = "^[" + SPACE + r"]*(?:\d|[a-zA-Z]|[०-९])"
# -----------------------------------------------------------------------------------------------

# Plain letters first: one range test each, where the property classes cost several.
WORD = r"(?>[A-Za-z0-9]+|[\p{L}\p{M}\p{N}]+)+(?:['’][\p{L}\p{M}]+)*"
# Above this nothing of the Latin ranges is left; texts without such characters take narrower patterns,
# whose classes are one table lookup per character.
WIDE = r"[\x{900}-\x{10FFFF}]"
SPACE_LATIN = r"\t\n\x0B\f\r \xA0"
SENTENCE = r"[\p{L}\p{N}][^.!?।॥\n]*"
NON_SPACE = "[^" + SPACE + "]"
BEYOND_LATIN = r"[^\x{0}-\x{2FF}]"


def lit(value: str) -> Column:
    return F.lit(value)


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, lit(pattern))


def strip(text: Column) -> Column:
    """Trim of every white-space character, not only U+0020."""
    return F.btrim(text, lit(SPACE_CHARS))


def strip_left(text: Column) -> Column:
    return F.ltrim(text, lit(SPACE_CHARS))


def strip_right(text: Column) -> Column:
    return F.rtrim(text, lit(SPACE_CHARS))


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def by_width(text: Column, make) -> Column:
    """``make(pattern → pattern)`` built twice: with narrowed classes for plain Latin text, in full for the rest."""
    return F.when(text.rlike(WIDE), make(lambda p: p)).otherwise(make(narrow))


def narrow(pattern: str) -> str:
    """The pattern without what Latin text cannot hold."""
    for wide, latin in (
        (SPACE, SPACE_LATIN), (SPACE.replace(r"\n", ""), SPACE_LATIN.replace(r"\n", "")), (SPACE.replace(r"\n", "").replace(r"\r", ""), SPACE_LATIN.replace(r"\n", "").replace(r"\r", "")),
        (r"\x{A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}", r"\xA0"), (r"\x{200B}\x{2060}\x{FEFF}\x{FFFD}\x{E000}-\x{F8FF}", ""), ("।॥", ""), (r"\x{2013}\x{2014}", ""), (r"\x{900}-\x{97F}", ""),
    ):
        pattern = pattern.replace(wide, latin)
    return pattern


def unix_lines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def characters(text: Column) -> Column:
    """Graphemes, line feeds not counted. Below U+0300 nothing combines, so the length is enough there."""
    breaks = count(text, "\r?\n")
    feeds = count(text, "\r\n")
    clusters = F.when(text.rlike(BEYOND_LATIN), count(text, r"\X")).otherwise(F.length(text) - feeds)
    return (clusters - breaks).cast("long")


def characters_no_spaces(text: Column) -> Column:
    inner = SPACE.replace(r"\n", "").replace(r"\r", "")
    return characters(text) - by_width(text, lambda n: count(text, r"(?:\r(?!\n)|[" + n(inner) + r"])(?!\p{M})"))


def words(text: Column) -> Column:
    return count(text, WORD).cast("long")


def devanagari_words(text: Column) -> Column:
    inside = F.size(F.filter(F.regexp_extract_all(text, lit(WORD), lit(0)), lambda w: w.rlike(DEVANAGARI)))
    return F.when(text.rlike(DEVANAGARI), inside).otherwise(0).cast("long")


def sentences(text: Column) -> Column:
    return by_width(text, lambda n: count(text, n(SENTENCE))).cast("long")


def paragraphs(text: Column) -> Column:
    parts = F.split(text, r"\n[" + SPACE + r"]*\n")
    return F.size(F.filter(parts, lambda p: p.rlike(NON_SPACE))).cast("long")


def filled_lines(text: Column) -> Column:
    return by_width(text, lambda n: count(text, n(NON_SPACE) + r"[^\n]*")).cast("long")


def reading_words(text: Column, pattern: str = READING_BREAK) -> Column:
    """Words by which two readings are compared (at least one letter each). Text is taken as NFC."""
    return F.filter(by_width(text, lambda n: F.split(text, n(pattern))), lambda w: w.rlike(r"\p{L}"))


def lower_words(text: Column) -> Column:
    """Lower-case word characters, Devanagari signs included."""
    return F.regexp_extract_all(F.lower(text), lit(r"(?>[a-z0-9_]+|[\p{L}\p{N}_\x{900}-\x{97F}]+)+"), lit(0))


def words_and_gaps(text: Column, pattern: str, change) -> Column:
    """Rewrites every match of ``pattern``: ``change(match, index, gap_before, match_count)``."""
    found = F.regexp_extract_all(text, lit(pattern), lit(0))
    # One-element "let": gaps and matches are computed once per row, not once per element.
    bound = F.transform(F.array(F.struct(F.split(text, pattern, -1).alias("gaps"), found.alias("found"))), lambda b: F.concat(
        F.array_join(F.transform(b["found"], lambda w, i: F.concat(F.get(b["gaps"], i), change(w, i, F.get(b["gaps"], i), F.size(b["found"])))), ""),
        F.element_at(b["gaps"], -1),
    ))
    return F.element_at(bound, 1)


def initial_capital(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 2147483647)))


def convert_case(text: Column, mode: str) -> Column:
    if mode not in CASE_MODES:
        raise ValueError(f"unknown case mode: {mode}")
    if mode == "upper":
        return F.upper(text)
    if mode == "lower":
        return F.lower(text)
    if mode == "capitalize":
        return words_and_gaps(text, CASE_WORD, lambda w, i, gap, n: initial_capital(w))
    if mode == "title":
        def title(w, i, gap, n):
            edge = (i == 0) | (i == n - 1) | gap.rlike(r"[.!?:][" + SPACE + r"]*\z")
            return F.when(~edge & F.lower(w).isin(*SMALL_WORDS), F.lower(w)).otherwise(initial_capital(w))
        return words_and_gaps(text, CASE_WORD, title)
    if mode == "sentence":
        opening = "(?:^[" + SPACE + r"]*|[.!?।॥][" + SPACE + r"]+|\n[" + SPACE + r"]*)\p{Ll}"
        return words_and_gaps(F.lower(text), opening, lambda w, i, gap, n: F.upper(w))
    return words_and_gaps(text, r"[\p{Lu}\p{Ll}\p{Lt}]", lambda w, i, gap, n: F.when(i % 2 == 0, F.lower(w)).otherwise(F.upper(w)))


def escape_pattern(query: str) -> str:
    return "".join("\\" + c if c in r".*+?^${}()|[]\/-&~#" else c for c in query)


def find_pattern(query: str, match_case: bool = False, whole_word: bool = False) -> str:
    body = escape_pattern(query)
    inside = r"[\p{L}\p{M}\p{N}_]"
    if whole_word:
        body = f"(?<!{inside}){body}(?!{inside})"
    return body if match_case else "(?iu)" + body


def phrase_pattern(query: str, match_case: bool = False) -> str | None:
    """Spaces of the query match any spacing, or none."""
    parts = query.split()
    if not parts:
        return None
    body = ("[" + SPACE + "]*").join(escape_pattern(p) for p in parts)
    return body if match_case else "(?iu)" + body


def quote_replacement(value: str) -> str:
    return value.replace("\\", "\\\\").replace("$", "\\$")


def without_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*\z", "")


def ascii_slug(folded: Column, fallback: str = "image", length: int = 60) -> Column:
    """``folded`` is the NFKD form of the file name; the slug has at most ``length`` characters."""
    slug = F.regexp_replace(without_extension(folded), r"[^A-Za-z0-9_" + SPACE + "-]", "")
    slug = F.regexp_replace(strip(slug), "[" + SPACE + "_]+", "-")
    slug = F.substring(F.lower(F.regexp_replace(slug, "-+", "-")), 1, length)
    return F.when(slug == "", lit(fallback)).otherwise(slug)


def document_slug(name: Column, fallback: str = "document", length: int = 80) -> Column:
    """``name`` is in NFC; the slug has at most ``length`` characters."""
    slug = F.regexp_replace(without_extension(name), r"[^\p{L}\p{M}\p{N}" + SPACE + "_-]", " ")
    slug = F.regexp_replace(strip(slug), "[" + SPACE + "_]+", "-")
    slug = F.regexp_replace(F.regexp_replace(slug, "-+", "-"), "^-+|-+$", "")
    slug = F.substring(slug, 1, length)
    return F.when(slug == "", lit(fallback)).otherwise(slug)


def export_name(base: Column, preset: Column, width: Column, height: Column, extension: Column) -> Column:
    clean = F.lower(F.regexp_replace(F.regexp_replace(base, r"[^\p{L}\p{M}\p{N}]+", "-"), "^-+|-+$", ""))
    clean = F.when(clean == "", lit("image")).otherwise(clean)
    return F.concat(clean, lit("-"), preset, lit("-"), width.cast("string"), lit("x"), height.cast("string"), lit("."), extension)


def ascii_digits(text: Column) -> Column:
    return F.translate(text, DEVANAGARI_DIGITS, "0123456789")


def devanagari_digits(text: Column) -> Column:
    return F.translate(text, "0123456789", DEVANAGARI_DIGITS)


def roman(value: Column) -> Column:
    """Lower-case roman numeral, digit by digit; thousands are repeated."""
    def digit(place: int, one: str, five: str, ten: str) -> Column:
        names = ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten]
        return F.element_at(F.array(*[lit(n) for n in names]), ((F.floor(value / place) % 10) + 1).cast("int"))
    return F.concat(F.repeat(lit("m"), F.floor(value / 1000).cast("int")), digit(100, "c", "d", "m"), digit(10, "x", "l", "c"), digit(1, "i", "v", "x"))


def list_style(marker: Column, ordered: Column) -> Column:
    """How a list written with this marker numbers its items (null: plain decimal)."""
    body = F.regexp_replace(marker, r"[.)]\z", "")
    bullet = (
        F.when(marker.isin("•", "●", "·"), "disc").when(marker.isin("○", "◦"), "circle").when(marker.isin("▪", "■"), "square")
        .otherwise(F.concat(lit('"'), F.regexp_replace(marker, r'["\\]', ""), lit(' "')))
    )
    numbered = (
        F.when(body.rlike(r"\A[०-९]+\z"), "devanagari")
        .when(body.rlike(r"\A\d+\z"), F.lit(None).cast("string"))
        .when(body.rlike(r"\A[ivxlc]+\z") & (body != "c"), "lower-roman")
        .when(body.rlike(r"\A[IVXLC]+\z") & (body != "C"), "upper-roman")
        .when(body.rlike(r"\A[a-z]\z"), "lower-alpha")
        .when(body.rlike(r"\A[A-Z]\z"), "upper-alpha")
    )
    return F.when(ordered, numbered).otherwise(bullet)


def list_start(marker: Column) -> Column:
    body = F.regexp_replace(marker, r"[.)]\z", "")
    digits = ascii_digits(body)
    return F.when(digits.rlike(r"\A\d+\z"), digits.cast("int")).when(body.rlike(r"\A[A-Za-z]\z"), F.ascii(F.lower(body)) - 96).otherwise(F.lit(1))


def list_marker(style: Column, ordered: Column, start: Column, index: Column) -> Column:
    """The marker shown for the ``index``-th (from 0) item of a list."""
    value = start + index
    letter = ((value - 1) % 26).cast("int")
    bullet = (
        F.when(style.startswith('"'), strip(F.regexp_replace(style, r'\A"|"\z', "")))
        .when(style == "circle", "◦").when(style == "square", "▪").otherwise("•")
    )
    number = (
        F.when(style == "devanagari", devanagari_digits(value.cast("string")))
        .when(style == "lower-alpha", F.char(letter + 97)).when(style == "upper-alpha", F.char(letter + 65))
        .when(style == "lower-roman", roman(value)).when(style == "upper-roman", F.upper(roman(value)))
        .otherwise(value.cast("string"))
    )
    return F.when(ordered, F.concat(number, lit("."))).otherwise(bullet)
