"""Cleaning, its report, and what it changed."""

from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import changes, cleaning
from quire.sources import derive
from quire.sources.tables import documents

LINE_RULES = ("duplicateLines", "extraSpaces", "ocrSpacing", "punctuation", "specialCharacters", "joinLines", "collapseBlankLines")


def clean_corpus(spark, d):
    return cleaning.clean_documents(documents(spark, d, "doc_id", "text")).select("doc_id", "text")


def clean_report(spark, d):
    return cleaning.clean_report(documents(spark, d, "lang", "text"), ["lang"])


def clean_report_lines(spark, d):
    return cleaning.clean_report(documents(spark, d, "source", "text"), ["source"], block_split="line")


def join_lines(spark, d):
    return cleaning.join_lines(derive.wrapped_documents(spark, d)).select("doc_id", "text", F.col("joinLines").alias("joined"))


def drop_blanks(spark, d):
    return cleaning.drop_blanks(derive.page_texts(spark, d)).select("page_id", "text", F.col("blankParagraphs").alias("dropped"))


def collapse_blanks(spark, d):
    return cleaning.drop_blanks(derive.page_texts(spark, d), keep_one=True).select("page_id", "text", F.col("collapseBlankLines").alias("dropped"))


def dedup_lines(spark, d):
    return cleaning.dedup_lines(documents(spark, d, "doc_id", "text"), block_split="line").select("doc_id", "text", F.col("duplicateLines").alias("dropped"))


def dedup_adjacent_lines(spark, d):
    return cleaning.dedup_lines(documents(spark, d, "doc_id", "text")).select("doc_id", "text", F.col("duplicateLines").alias("dropped"))


def _before_after(spark, d):
    before = documents(spark, d, "doc_id", "text")
    after = cleaning.clean_documents(before, ["duplicateLines", "punctuation", "specialCharacters"])
    return before, after


def lines_changed(spark, d):
    return changes.lines_changed(*_before_after(spark, d))


def line_diff(spark, d):
    return changes.line_diff(*_before_after(spark, d))


def case_title(spark, d):
    return documents(spark, d, "doc_id", "text").select("doc_id", tx.convert_case(F.col("text"), "title").alias("text"))


def case_sentence(spark, d):
    return documents(spark, d, "doc_id", "text").select("doc_id", tx.convert_case(F.col("text"), "sentence").alias("text"))


def case_alternating(spark, d):
    return documents(spark, d, "doc_id", "text").select("doc_id", tx.convert_case(F.col("text"), "alternating").alias("text"))


def case_capitalize(spark, d):
    out = cleaning.clean_documents(documents(spark, d, "doc_id", "lang", "text"), [], case_mode="capitalize")
    return out.groupBy("lang").agg(F.sum("caseChanged").alias("changed"), F.count(F.lit(1)).alias("documents"))


QUERIES = {f.__name__: f for f in (clean_corpus, clean_report, clean_report_lines, join_lines, drop_blanks, collapse_blanks, dedup_lines, dedup_adjacent_lines, lines_changed, line_diff, case_title, case_sentence, case_alternating, case_capitalize)}

# The oracle's regular expressions have no look-around or back-references, hence the expanded forms.
_STAGES = [
    ("specialCharacters", r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}\x{AD}\x{200B}\x{2060}\x{FEFF}\x{FFFD}\x{E000}-\x{F8FF}]", ""),
    ("punctuation", r"[\x{201C}\x{201D}\x{201E}\x{201F}\x{2033}]", '"'),
    ("punctuation", r"[\x{2018}\x{2019}\x{201A}\x{201B}\x{2032}]", "''"),
    ("punctuation", r"!!+", "!"),
    ("punctuation", r"\?\?+", "?"),
    ("punctuation", r",,+", ","),
    ("punctuation", r"\.\.\.\.+", "..."),
    ("ocrSpacing", r"[ \t]+([,.;:!?।॥)\]}])", r"\1"),
    ("ocrSpacing", r"([(\[{])[ \t]+", r"\1"),
    ("ocrSpacing", r"([,;!?।॥])(\p{L})", r"\1 \2"),
    ("ocrSpacing", r"(\p{Ll}\p{Ll})\.(\p{Lu})", r"\1. \2"),
    ("extraSpaces", r"[ \t\x{A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}][ \t\x{A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]+", " "),
]


def clean_sql(source: str, rules, gap: str = r"\n\n+") -> str:
    """CTEs ending in ``cleaned(key, text, one column per rule)``; ``source`` selects (key, text)."""
    parts = [f"s0 AS (SELECT key, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS t0 FROM ({source}))"]
    counts: dict[str, list[str]] = {r: [] for r in tx.CLEAN_RULES}
    n = 0
    for rule, pattern, replacement in _STAGES:
        if rule not in rules:
            continue
        parts.append(f"s{n + 1} AS (SELECT *, len(regexp_extract_all(t{n}, '{pattern}')) AS c{n}, regexp_replace(t{n}, '{pattern}', '{replacement}', 'g') AS t{n + 1} FROM s{n})")
        counts[rule].append(f"c{n}")
        n += 1
    trims = bool({"extraSpaces", "ocrSpacing"} & set(rules))
    joined = r"""coalesce(regexp_matches(lag(line) OVER w, '\S') AND NOT regexp_matches(lag(line) OVER w, '[.!?।॥:;"'')\]]\s*$') AND regexp_matches(line, '^\s*[\p{Ll}\x{900}-\x{97F}\d]'), false)""" if "joinLines" in rules else "false"
    parts.append(f"""p0 AS (SELECT key, unnest(string_split_regex(t{n}, '{gap}')) AS para, generate_subscripts(string_split_regex(t{n}, '{gap}'), 1) AS p FROM s{n}),
l0 AS (SELECT key, p, unnest(string_split(para, chr(10))) AS line, generate_subscripts(string_split(para, chr(10)), 1) AS i FROM p0),
l1 AS (SELECT *, {joined} AS j, lag(line) OVER w AS before FROM l0 WINDOW w AS (PARTITION BY key, p ORDER BY i)),
l2 AS (SELECT *, sum(CASE WHEN j THEN 0 ELSE 1 END) OVER w AS g, coalesce(lead(j) OVER w, false) AS jn FROM l1 WINDOW w AS (PARTITION BY key, p ORDER BY i)),
l3 AS (SELECT key, p, g, sum(j::INT) AS nj, string_agg(CASE WHEN NOT j OR regexp_matches(before, '\\p{{L}}-$') THEN '' ELSE ' ' END || CASE WHEN jn AND regexp_matches(line, '\\p{{L}}-$') THEN left(line, length(line) - 1) ELSE line END, '' ORDER BY i) AS line FROM l2 GROUP BY ALL),
l4 AS (SELECT *, trim(line, chr(9) || ' ' || chr(13)) AS k FROM l3),
l5 AS (SELECT *, {"coalesce(k <> '' AND lag(k) OVER (PARTITION BY key, p ORDER BY g) = k, false)" if "duplicateLines" in rules else "false"} AS dup FROM l4),
b0 AS (SELECT key, p, sum(nj) AS nj, sum(dup::INT) AS nd, sum((NOT dup AND line <> k)::INT) AS nt, string_agg({"k" if trims else "line"}, chr(10) ORDER BY g) FILTER (NOT dup) AS para, trim(string_agg(line, chr(10) ORDER BY g) FILTER (NOT dup), chr(9) || chr(10) || ' ' || chr(13)) AS k FROM l5 GROUP BY ALL),
b1 AS (SELECT *, {"k = ''" if "blankParagraphs" in rules else "false"} AS bp, {"k = '' AND coalesce(lag(k) OVER (PARTITION BY key ORDER BY p) = '', false)" if "collapseBlankLines" in rules and "blankParagraphs" not in rules else "false"} AS bc, {"k <> '' AND row_number() OVER (PARTITION BY key, k ORDER BY p) > 1" if "duplicateLines" in rules else "false"} AS bd FROM b0),
b2 AS (SELECT key, sum(nj)::BIGINT AS nj, sum(nd + bd::INT)::BIGINT AS nd, sum(nt)::BIGINT AS nt, sum(bp::INT)::BIGINT AS np, sum(bc::INT)::BIGINT AS nc, coalesce(string_agg(para, chr(10) || chr(10) ORDER BY p) FILTER (NOT (bp OR bc OR bd)), '') AS text FROM b1 GROUP BY key)""")
    def total(rule):
        return " + ".join(counts[rule]) or "0"
    parts.append(f"""cleaned AS (SELECT b2.key, b2.text, ({total("extraSpaces")} + {"nt" if trims else "0"})::BIGINT AS "extraSpaces", ({total("ocrSpacing")})::BIGINT AS "ocrSpacing", nj AS "joinLines", np AS "blankParagraphs", nc AS "collapseBlankLines", nd AS "duplicateLines", ({total("punctuation")})::BIGINT AS punctuation, ({total("specialCharacters")})::BIGINT AS "specialCharacters" FROM b2 JOIN s{n} USING (key))""")
    return "WITH " + ",\n".join(parts)


_D = "SELECT doc_id AS key, text FROM documents"
WRAPPED = r"SELECT doc_id AS key, regexp_replace(text, '([^\n]{40,59}) ', '\1' || chr(10), 'g') AS text FROM documents"
_LONG = " UNION ALL ".join(f"""SELECT key, '{r}' AS rule, "{r}" AS n FROM cleaned""" for r in tx.CLEAN_RULES)


def _html_sql() -> str:
    from quire.functions import html as ht

    out = r"regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', '', 'g')"
    out = rf"regexp_replace({out}, '(?i)</?(?:{ht.BLOCK_ELEMENTS})\b[^>]*>', chr(10), 'g')"
    out = rf"regexp_replace({out}, '<[^>]*>', '', 'g')"
    for entity, char in ht.ENTITIES.items():
        out = "replace({}, '{}', '{}')".format(out, entity, char.replace("'", "''"))
    return out


HTML_TEXT = _html_sql()
_PAGES = f"SELECT page_id AS key, {HTML_TEXT} AS text FROM pages"
_ALL = cleaning.ALL_RULES
_DIFF = ["duplicateLines", "punctuation", "specialCharacters"]
SHARP = "ẞ"  # what the oracle makes of a sharp s in capitals
_WORD = r"\p{L}[\p{L}\p{M}\p{N}''’]*"


def _case_sql(pattern: str, change: str, text: str = "text") -> str:
    return rf"""WITH d AS (SELECT doc_id, string_split_regex({text}, '{pattern}') AS gaps, regexp_extract_all({text}, '{pattern}') AS found FROM documents)
SELECT doc_id, array_to_string(list_transform(range(len(found)), lambda i: gaps[i + 1] || {change}), '') || gaps[-1] AS text FROM d"""


ORACLE = {
    "clean_corpus": clean_sql(_D, _ALL) + " SELECT key AS doc_id, text FROM cleaned",
    "clean_report": clean_sql(_D, _ALL) + f" SELECT lang, rule, sum(n)::BIGINT AS fixes, count(*) FILTER (n > 0) AS documents FROM ({_LONG}) JOIN documents ON doc_id = key GROUP BY ALL",
    "clean_report_lines": clean_sql(_D, _ALL, r"\n+") + f" SELECT source, rule, sum(n)::BIGINT AS fixes, count(*) FILTER (n > 0) AS documents FROM ({_LONG}) JOIN documents ON doc_id = key GROUP BY ALL",
    "join_lines": clean_sql(WRAPPED, ["joinLines"]) + ' SELECT key AS doc_id, text, "joinLines" AS joined FROM cleaned',
    "drop_blanks": clean_sql(_PAGES, ["blankParagraphs"]) + ' SELECT key AS page_id, text, "blankParagraphs" AS dropped FROM cleaned',
    "collapse_blanks": clean_sql(_PAGES, ["collapseBlankLines"]) + ' SELECT key AS page_id, text, "collapseBlankLines" AS dropped FROM cleaned',
    "dedup_lines": clean_sql(_D, ["duplicateLines"], r"\n+") + ' SELECT key AS doc_id, text, "duplicateLines" AS dropped FROM cleaned',
    "dedup_adjacent_lines": clean_sql(_D, ["duplicateLines"]) + ' SELECT key AS doc_id, text, "duplicateLines" AS dropped FROM cleaned',
    "lines_changed": clean_sql(_D, _DIFF) + """, u AS (
SELECT key, unnest(string_split(text, chr(10))) AS line, 1 AS n FROM (SELECT doc_id AS key, text FROM documents) UNION ALL SELECT key, unnest(string_split(text, chr(10))), -1 FROM cleaned),
s AS (SELECT key, line, sum(n)::BIGINT AS n FROM u GROUP BY ALL HAVING sum(n) <> 0)
SELECT key AS doc_id, line, CASE WHEN n > 0 THEN 'removed' ELSE 'added' END AS change, abs(n) AS times FROM s""",
    "case_title": _case_sql(_WORD, rf"(CASE WHEN i > 0 AND i < len(found) - 1 AND NOT regexp_matches(gaps[i + 1], '[.!?:]\s*$') AND lower(found[i + 1]) IN ({', '.join(repr(w) for w in tx.SMALL_WORDS)}) THEN lower(found[i + 1]) ELSE replace(upper(left(found[i + 1], 1)), '{SHARP}', 'SS') || lower(substr(found[i + 1], 2)) END)"),
    "case_sentence": _case_sql(r"(?:^\s*|[.!?।॥]\s+|\n\s*)\p{Ll}", f"replace(upper(found[i + 1]), '{SHARP}', 'SS')", "lower(text)"),
    "case_alternating": _case_sql(r"[\p{Lu}\p{Ll}\p{Lt}]", f"(CASE WHEN i % 2 = 0 THEN lower(found[i + 1]) ELSE replace(upper(found[i + 1]), '{SHARP}', 'SS') END)"),
    "case_capitalize": rf"""WITH d AS (SELECT lang, text, string_split_regex(text, '{_WORD}') AS gaps, regexp_extract_all(text, '{_WORD}') AS found FROM documents),
c AS (SELECT lang, (text <> array_to_string(list_transform(range(len(found)), lambda i: gaps[i + 1] || replace(upper(left(found[i + 1], 1)), '{SHARP}', 'SS') || lower(substr(found[i + 1], 2))), '') || gaps[-1])::INT AS changed FROM d)
SELECT lang, sum(changed)::BIGINT AS changed, count(*) AS documents FROM c GROUP BY lang""",
}
