"""Fonts and colours of text runs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------------------------------
STYLE_BOLD = ("bold", "bd", "black", "blk", "heavy", "hv", "semibold", "sb", "demi", "demibold", "medi", "medium", "md", "extrabold", "xbold", "ultra")
STYLE_ITALIC = ("italic", "ital", "it", "oblique", "obl", "slant", "sl", "inclined")
BOLD_NAME = "bold|black|heavy|semibold|demi"
BOLD_TEX_NAME = "^(?:cm|lm)bx"
ITALIC_NAME = "italic|oblique"
ITALIC_TEX_NAME = "^(?:cm|lm)(?:ti|sl|mi)"
NAME_SUFFIX = "(?:PSMT|PS|MT|Std|Pro|LT)$"
# Name patterns and the family they stand for, first match first; none: the face keeps its own name.
FAMILIES = (
    (r"helvetica|arial|liberationsans|arimo|nimbussan|texgyreheros|franklingothic", "Arial"),
    (r"timesnewroman|times|liberationserif|tinos|nimbusrom|texgyretermes|^cmr|^cmbx|^cmti|^cmsl|^lmroman|^sfrm|^ptmr", "Times New Roman"),
    (r"courier|liberationmono|cousine|nimbusmon|^cmtt|^lmmono", "Courier New"),
    (r"georgia", "Georgia"),
    (r"calibri|carlito", "Calibri"),
    (r"cambria|caladea", "Cambria"),
    (r"verdana", "Verdana"),
    (r"tahoma", "Tahoma"),
    (r"garamond", "Garamond"),
    (r"segoe", "Segoe UI"),
    (r"consolas", "Consolas"),
    (r"^cmsy|^cmmi|^cmex|^msbm|^msam|symbol", "Cambria Math"),
    (r"mangal|kalimati|kokila|aparajita|utsaah|nirmala|notosansdevanagari|kohinoordevanagari|devanagarimt|preeti", None),
)
PLAIN_INK = "#1A1A1A"
# --------------------------------------------------------------------------------------------------


def _style_words(name: Column) -> Column:
    after_hyphen = F.when(F.instr(name, "-") > 0, F.regexp_extract(name, r"^[^-]*-(.*)$", 1)).otherwise(F.lit(""))
    part = F.when(after_hyphen != "", after_hyphen).otherwise(F.regexp_extract(name, r"^[^,]*,(.*)$", 1))
    return F.transform(F.regexp_extract_all(part, F.lit("[A-Z][a-z]*|[a-z]+"), F.lit(0)), F.lower)


def _any_of(words: Column, known: tuple[str, ...]) -> Column:
    return F.arrays_overlap(words, F.array(*[F.lit(w) for w in known]))


def font_style(fontname: Column) -> Column:
    """A PDF font name as a struct of family, bold and italic."""
    name = F.regexp_replace(fontname, r"^[^+]*\+", "")
    low = F.replace(F.lower(name), F.lit(" "), F.lit(""))
    words = _style_words(name)
    bold = _any_of(words, STYLE_BOLD) | low.rlike(BOLD_NAME) | low.rlike(BOLD_TEX_NAME)
    italic = _any_of(words, STYLE_ITALIC) | low.rlike(ITALIC_NAME) | low.rlike(ITALIC_TEX_NAME)
    base = F.regexp_replace(F.regexp_extract(name, "^([^-]*)", 1), NAME_SUFFIX, "")
    pretty = F.trim(F.regexp_replace(base, "(?<=[a-z])(?=[A-Z])", " "))
    own = F.when(pretty == "", "Arial").otherwise(pretty)
    family = own
    for pattern, known in reversed(FAMILIES):
        family = F.when(low.rlike(pattern), own if known is None else F.lit(known)).otherwise(family)
    return F.struct(family.alias("family"), bold.alias("bold"), italic.alias("italic"))


def _byte(value: Column) -> Column:
    """A share of 255, rounded half to even and kept in range, as two hex digits."""
    return F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.bround(value * 255).cast("int")))), 2, "0")


def colour_hex(parts: Column) -> Column:
    """One (grey), three (RGB) or four (CMYK) shares as RRGGBB; anything else is null."""
    def part(i: int) -> Column:
        return F.get(parts, i)
    key = 1 - part(3)
    return (
        F.when(F.size(parts) == 1, F.repeat(_byte(part(0)), 3))
        .when(F.size(parts) == 3, F.concat(_byte(part(0)), _byte(part(1)), _byte(part(2))))
        .when(F.size(parts) == 4, F.concat(*[_byte((1 - part(i)) * key) for i in range(3)]))
    )


def channels(colour: Column) -> list[Column]:
    return [F.conv(F.substring(colour, start, 2), 16, 10).cast("double") for start in (2, 4, 6)]


def colour_distance(a: Column, b: Column) -> Column:
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(channels(a), channels(b))), F.lit(0.0)))


def text_colour(colour: Column) -> Column:
    """Near-black and nearly grey ink is plain ink."""
    r, g, b = channels(colour)
    plain = (F.greatest(r, g, b) - F.least(r, g, b) < 30) & ((r + g + b) / 3 < 90)
    return F.when(plain, PLAIN_INK).otherwise(F.upper(colour))
