"""Profiles, scripts and shares."""

from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import profile
from quire.sources.tables import events, table

_PROFILE = r"""
WITH d AS (
  SELECT lang, source,
    length_grapheme(text) - len(regexp_extract_all(text, '\r?\n')) AS characters,
    len(regexp_extract_all(text, '[\t\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]')) AS blanks,
    len(regexp_extract_all(text, '[\p{L}\p{M}\p{N}]+(?:[''’][\p{L}\p{M}]+)*')) AS words,
    len(list_filter(regexp_extract_all(text, '[\p{L}\p{M}\p{N}]+(?:[''’][\p{L}\p{M}]+)*'), lambda w: regexp_matches(w, '[\x{900}-\x{97F}]'))) AS dev,
    len(regexp_extract_all(text, '[\p{L}\p{N}][^.!?।॥\n]*')) AS sentences,
    len(list_filter(string_split_regex(text, '\n\s*\n'), lambda p: regexp_matches(p, '\S'))) AS paragraphs,
    len(list_filter(string_split(text, chr(10)), lambda p: regexp_matches(p, '\S'))) AS lines
  FROM SRC)
SELECT KEYS, count(*) AS documents, sum(characters)::BIGINT AS characters, sum(characters - blanks)::BIGINT AS characters_no_spaces,
  sum(words)::BIGINT AS words, sum(sentences)::BIGINT AS sentences, sum(paragraphs)::BIGINT AS paragraphs, sum(lines)::BIGINT AS lines,
  round((sum(words) - sum(dev)) / 238.0::DOUBLE + sum(dev) / 180.0::DOUBLE, 4) AS reading_minutes
FROM d GROUP BY ROLLUP (KEYS)
"""

_LETTERS = """
WITH c AS (SELECT KEYS, sum(len(regexp_extract_all(text, '[\\x{900}-\\x{97F}]')))::BIGINT AS devanagari, sum(len(regexp_extract_all(text, '[A-Za-z]')))::BIGINT AS latin FROM documents GROUP BY KEYS)
SELECT *, CASE WHEN devanagari + latin = 0 THEN 'unknown' CASES END AS language FROM c
"""


def text_profile(spark, d):
    return profile.text_profile(table(spark, d, "documents", "lang", "source", "text"), ["lang", "source"])


def conversation_profile(spark, d):
    return profile.text_profile(table(spark, d, "conversations", "role", "text"), ["role"])


def script_language(spark, d):
    return profile.detect_language(table(spark, d, "documents", "lang", "source", "text"), ["lang", "source"])


def script_language_by_document(spark, d):
    return profile.detect_language(table(spark, d, "documents", "doc_id", "text"), ["doc_id"], variant="engine")


def label_share(spark, d):
    docs = table(spark, d, "documents", "doc_id", "lang", "text").select("doc_id", "lang", tx.words(F.col("text")).alias("words"))
    joined = docs.join(table(spark, d, "labels", "doc_id", "quality"), "doc_id", "left")
    return profile.share_where(joined, ["lang"], F.col("quality") == 1, F.col("quality").isNotNull() & (F.col("words") >= 50))


def detached_share(spark, d):
    docs = table(spark, d, "documents", "lang", "text")
    return docs.select("lang", profile.detached_share(F.col("text")).alias("s")).groupBy("lang").agg(F.round(F.max("s"), 6).alias("worst"), F.count_if(F.col("s") >= 0.05).alias("broken"))


def dominant_language(spark, d):
    return profile.dominant_value(table(spark, d, "documents", "source", "lang", "doc_id"), ["source"], "lang", "doc_id")


def few_values(spark, d):
    return profile.few_values(events(spark, d, "event_type", "value"), ["event_type"], "value", 400)


def few_users(spark, d):
    return profile.few_values(events(spark, d, "event_type", "user_id"), ["event_type"], "user_id", 400)


QUERIES = {f.__name__: f for f in (text_profile, conversation_profile, script_language, script_language_by_document, label_share, detached_share, dominant_language, few_values, few_users)}

_FEW = """SELECT event_type, least(count(DISTINCT {c}), 401)::BIGINT AS distinct_capped, count(DISTINCT {c}) <= 400 AS few FROM events GROUP BY event_type"""

ORACLE = {
    "text_profile": _PROFILE.replace("KEYS", "lang, source").replace("SRC", "documents"),
    "conversation_profile": _PROFILE.replace("KEYS", "role").replace("lang, source", "role").replace("SRC", "conversations"),
    "script_language": _LETTERS.replace("KEYS", "lang, source").replace("CASES", "WHEN devanagari / (devanagari + latin) < 0.05 THEN 'en' WHEN latin / (devanagari + latin) < 0.15 THEN 'ne' ELSE 'mixed'"),
    "script_language_by_document": _LETTERS.replace("KEYS", "doc_id").replace("CASES", "WHEN devanagari > 0 AND latin / (devanagari + latin) > 0.15 THEN 'mixed' WHEN devanagari > 0 THEN 'ne' ELSE 'en'"),
    "label_share": r"""
WITH j AS (SELECT d.lang, l.quality, l.quality IS NOT NULL AND len(regexp_extract_all(d.text, '[\p{L}\p{M}\p{N}]+(?:[''’][\p{L}\p{M}]+)*')) >= 50 AS eligible
  FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT lang, count(*) FILTER (eligible) AS eligible, count(*) FILTER (eligible AND quality = 1) AS matching,
  round(count(*) FILTER (eligible AND quality = 1) / nullif(count(*) FILTER (eligible), 0), 6) AS share FROM j GROUP BY lang""",
    "detached_share": r"""
WITH w AS (SELECT lang, list_filter(string_split_regex(text, '[\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}।॥.,;:!?()"''\x{2013}\x{2014}-]+'), lambda w: regexp_matches(w, '\p{L}') AND regexp_matches(w, '[\x{900}-\x{97F}]')) AS ws FROM documents),
s AS (SELECT lang, CASE WHEN len(ws) = 0 THEN 0.0::DOUBLE ELSE len(list_filter(ws, lambda w: regexp_matches(w, '^[\x{900}-\x{903}\x{93A}-\x{94F}\x{951}-\x{957}\x{962}\x{963}]'))) / len(ws) END AS s FROM w)
SELECT lang, round(max(s), 6) AS worst, count(*) FILTER (s >= 0.05) AS broken FROM s GROUP BY lang""",
    "dominant_language": """
WITH c AS (SELECT source, lang, count(*) AS n, min(doc_id) AS f FROM documents GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, f) AS k, sum(n) OVER (PARTITION BY source)::BIGINT AS total FROM c)
SELECT source, lang, n, total FROM r WHERE k = 1""",
    "few_values": _FEW.format(c="value"),
    "few_users": _FEW.format(c="user_id"),
}
