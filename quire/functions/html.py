"""Text of HTML pages, by expressions only."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: elements that end a line, and the entities that are decoded ---
BLOCK_ELEMENTS = "address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h1|h2|h3|h4|h5|h6|header|hr|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul"
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&amp;": "&"}
# ---------------------------------------------------------------------------------


def html_text(html: Column) -> Column:
    """Text only: no scripts, styles or comments; blocks on lines of their own; entities decoded."""
    out = F.regexp_replace(html, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", "")
    out = F.regexp_replace(out, rf"(?i)</?(?:{BLOCK_ELEMENTS})\b[^>]*>", "\n")
    out = F.regexp_replace(out, r"<[^>]*>", "")
    for entity, char in ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def element_text(html: Column, name: str) -> Column:
    return F.regexp_extract(html, rf"(?is)<{name}\b[^>]*>(.*?)</{name}\s*>", 1)


def escape(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def document_html(title: Column, text: Column, lang: Column) -> Column:
    """A whole page: a paragraph per block, line breaks kept."""
    blocks = F.transform(F.split(text, r"\n{2,}"), lambda p: F.concat(F.lit("<p>"), F.replace(escape(p), F.lit("\n"), F.lit("<br>")), F.lit("</p>")))
    return F.concat(
        F.lit('<!doctype html>\n<html lang="'), lang, F.lit('">\n<head><meta charset="utf-8"><title>'), escape(title),
        F.lit("</title></head>\n<body>\n"), F.array_join(blocks, ""), F.lit("\n</body>\n</html>\n"),
    )
