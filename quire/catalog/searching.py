"""Search, highlights, edits and page metadata."""

from pyspark.sql import functions as F

from quire.catalog.text_cleaning import HTML_TEXT
from quire.functions import text as tx
from quire.functions import unicode as un
from quire.operators import searching
from quire.sources import derive
from quire.sources.tables import documents, spread, table


def keyword_search(spark, d):
    return searching.keyword_search(table(spark, d, "part"), "Red widget", 50, "p_name", ["p_type", "p_brand"], "p_partkey").select("p_partkey", "p_name", "score")


def keyword_search_documents(spark, d):
    docs = documents(spark, d, "doc_id", "lang", "source", "text")
    return searching.keyword_search(docs, "de éau", 100, "source", ["lang", "text"], "doc_id").select("doc_id", "score")


def grouped_search(spark, d):
    hits = searching.keyword_scores(table(spark, d, "part"), "small economy", "p_name", ["p_type"]).filter("score > 0").select("p_partkey", "p_name", "p_brand", "score")
    return searching.grouped_search(hits, "p_brand", "p_partkey", "p_partkey")


def phrase_search(spark, d):
    return searching.phrase_search(documents(spark, d, "doc_id", "text"), "the th", "doc_id", None)


def phrase_search_turns(spark, d):
    return searching.phrase_search(table(spark, d, "conversations", "conv_id", "turn", "text"), "de la", "conv_id", "turn")


def merge_ranges(spark, d):
    return searching.highlights(documents(spark, d, "doc_id", "text"), "the he en", "doc_id")


def find_replace(spark, d):
    docs = documents(spark, d, "doc_id", "source", "text")
    out = searching.find_replace(docs, "the", "THE$1", whole_word=True)
    return out.select("doc_id", "text", F.col("hits").cast("long").alias("hits"))


def find_replace_report(spark, d):
    out = searching.find_replace(documents(spark, d, "source", "text"), "the", "The", match_case=True)
    return out.groupBy("source").agg(F.sum("hits").alias("hits"), F.count_if(F.col("hits") > 0).alias("documents"))


def metadata_audit(spark, d):
    return searching.metadata_audit(spread(table(spark, d, "pages"), "page_id")).drop("url")


def corpus_text(spark, d):
    return derive.page_texts(spark, d)


def document_names(spark, d):
    pages = table(spark, d, "pages", "page_id", "url")
    name = F.regexp_replace("url", "^https?://", "")
    slug = tx.document_slug(name)
    return pages.select("page_id", slug.alias("document_name"), tx.ascii_slug(un.nfkd(name)).alias("file_name"), tx.export_name(slug, F.lit("instagram-square"), F.lit(1080), F.lit(1080), F.lit("jpg")).alias("export_name"))


def folded_text(spark, d):
    return documents(spark, d, "doc_id", "text").select("doc_id", un.fold(F.col("text")).alias("folded"))


QUERIES = {f.__name__: f for f in (keyword_search, keyword_search_documents, grouped_search, phrase_search, phrase_search_turns, merge_ranges, find_replace, find_replace_report, metadata_audit, corpus_text, document_names, folded_text)}

# Occurrences of the pattern of a text, in code points.
_HITS = r"""p AS (SELECT {keys}, string_split_regex({text}, '{pattern}') AS gaps, regexp_extract_all({text}, '{pattern}') AS found FROM {table}),
h0 AS (SELECT {keys}, unnest(range(1, len(found) + 1)) AS i, unnest(list_transform(range(1, len(found) + 1), lambda k: length(gaps[k]))) AS gap, unnest(list_transform(range(1, len(found) + 1), lambda k: length(found[k]))) AS n FROM p),
h1 AS (SELECT {keys}, i, (sum(gap + n) OVER (PARTITION BY {keys} ORDER BY i))::BIGINT AS "end", n FROM h0)"""


def _hits(table, keys, text, pattern):
    return _HITS.format(table=table, keys=keys, text=text, pattern=pattern)


_MERGE = """WITH r AS (RANGES),
m AS (SELECT *, max("end") OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT doc_id, min(start)::INT AS start, max("end")::INT AS "end" FROM g GROUP BY doc_id, g"""
_RANGES = " UNION ALL ".join(f"""SELECT doc_id, "end" - n AS start, "end" FROM (WITH {_hits("documents", "doc_id", "lower(text)", w)} SELECT * FROM h1)""" for w in ("the", "he", "en"))

ORACLE = {
    "keyword_search": """
WITH w AS (SELECT *, lower(strip_accents(p_name)) AS n, lower(strip_accents(p_type || ' ' || p_brand)) AS r FROM part),
s AS (SELECT p_partkey, p_name, CASE WHEN starts_with(n, 'red') THEN 3 WHEN contains(n, 'red') THEN 2 WHEN contains(r, 'red') THEN 1 END + CASE WHEN starts_with(n, 'widget') THEN 3 WHEN contains(n, 'widget') THEN 2 WHEN contains(r, 'widget') THEN 1 END AS score FROM w)
SELECT * FROM s WHERE score > 0 ORDER BY score DESC, p_partkey LIMIT 50""",
    "keyword_search_documents": """
WITH w AS (SELECT doc_id, lower(strip_accents(source)) AS n, lower(strip_accents(lang || ' ' || text)) AS r FROM documents),
s AS (SELECT doc_id, CASE WHEN starts_with(n, 'de') THEN 3 WHEN contains(n, 'de') THEN 2 WHEN contains(r, 'de') THEN 1 END + CASE WHEN starts_with(n, 'eau') THEN 3 WHEN contains(n, 'eau') THEN 2 WHEN contains(r, 'eau') THEN 1 END AS score FROM w)
SELECT * FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 100""",
    "grouped_search": """
WITH s AS (SELECT p_partkey, p_name, p_brand, CASE WHEN starts_with(lower(p_name), 'small') THEN 3 WHEN contains(lower(p_name), 'small') THEN 2 WHEN contains(lower(p_type), 'small') THEN 1 END + CASE WHEN starts_with(lower(p_name), 'economy') THEN 3 WHEN contains(lower(p_name), 'economy') THEN 2 WHEN contains(lower(p_type), 'economy') THEN 1 END AS score FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_partkey) AS k FROM s WHERE score > 0)
SELECT a.p_partkey, a.p_name, a.p_brand, a.score, b.score AS group_score, b.p_partkey AS group_first FROM r a JOIN r b ON a.p_brand = b.p_brand AND b.k = 1""",
    "phrase_search": "WITH " + _hits("documents", "doc_id", "text", r"(?i)the\s*th") + """ SELECT doc_id, ("end" - n)::INT AS start, "end"::INT AS "end" FROM h1""",
    "phrase_search_turns": "WITH " + _hits("conversations", "conv_id, turn", "text", r"(?i)de\s*la") + """ SELECT conv_id, turn, ("end" - n)::INT AS start, "end"::INT AS "end" FROM h1""",
    "merge_ranges": _MERGE.replace("RANGES", _RANGES),
    "find_replace": r"""
WITH t AS (SELECT doc_id, string_split_regex(text, '(?i)the') AS gaps, regexp_extract_all(text, '(?i)the') AS found FROM documents),
f AS (SELECT *, list_transform(range(1, len(found) + 1), lambda i: NOT regexp_matches(gaps[i], '[\p{L}\p{M}\p{N}_]$') AND NOT regexp_matches(gaps[i + 1], '^[\p{L}\p{M}\p{N}_]') AND NOT (i > 1 AND gaps[i] = '') AND NOT (i < len(found) AND gaps[i + 1] = '')) AS ok FROM t)
SELECT doc_id, array_to_string(list_transform(range(1, len(found) + 1), lambda i: gaps[i] || CASE WHEN ok[i] THEN 'THE$1' ELSE found[i] END), '') || gaps[-1] AS text, len(list_filter(ok, lambda x: x)) AS hits FROM f""",
    "find_replace_report": "SELECT source, sum(len(regexp_extract_all(text, 'the')))::BIGINT AS hits, count(*) FILTER (contains(text, 'the')) AS documents FROM documents GROUP BY source",
    "metadata_audit": rf"""
WITH m AS (SELECT page_id, url, regexp_extract(html, '(?is)<meta\s+name="description"\s+content="([^"]*)"', 1) AS meta, regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title\s*>', 1) AS t, regexp_extract(html, '(?is)<p\b[^>]*>(.*?)</p\s*>', 1) AS p, regexp_extract(html, '(?is)<link\s+rel="canonical"\s+href="([^"]*)"', 1) AS canonical FROM pages),
x AS (SELECT page_id, url, canonical, length(trim({HTML_TEXT.replace("html,", "t,", 1)})) AS title_length, length(trim(CASE WHEN meta <> '' THEN meta ELSE {HTML_TEXT.replace("html,", "p,", 1)} END)) AS description_length FROM m)
SELECT page_id, title_length::INT AS title_length, title_length > 70 AS long_title, description_length::INT AS description_length, description_length NOT BETWEEN 70 AND 165 AS bad_description, canonical = '' OR canonical = url AS listed FROM x""",
    "corpus_text": f"SELECT page_id, {HTML_TEXT} AS text FROM pages",
    "document_names": r"""
WITH n AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '\.[^.]*$', '') AS b FROM pages),
a AS (SELECT page_id, left(trim(regexp_replace(regexp_replace(trim(regexp_replace(b, '[^\p{L}\p{M}\p{N}\s_-]', ' ', 'g')), '[\s_]+', '-', 'g'), '-+', '-', 'g'), '-'), 80) AS document_name,
  left(lower(regexp_replace(regexp_replace(trim(regexp_replace(strip_accents(b), '[^A-Za-z0-9_\s-]', '', 'g')), '[\s_]+', '-', 'g'), '-+', '-', 'g')), 60) AS file_name FROM n)
SELECT page_id, CASE WHEN document_name = '' THEN 'document' ELSE document_name END AS document_name, CASE WHEN file_name = '' THEN 'image' ELSE file_name END AS file_name,
  lower(trim(regexp_replace(document_name, '[^\p{L}\p{M}\p{N}]+', '-', 'g'), '-')) || '-instagram-square-1080x1080.jpg' AS export_name FROM a""",
    "folded_text": "SELECT doc_id, trim(strip_accents(lower(text)), chr(9) || chr(10) || ' ') AS folded FROM documents",
}
