"""Agreement of readings, routing and reconciliation."""

from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import readings
from quire.sources import derive
from quire.sources.tables import documents, table


def agreement(spark, d):
    left = documents(spark, d, "doc_id", "text")
    right = derive.second_readings(spark, d).select("doc_id", F.col("ocr_text").alias("text"))
    return readings.agreement(left, right, ["doc_id"], whole=True).select("doc_id", "shared", "left_words", "right_words", F.round("agreement", 6).alias("agreement"))


def agreement_turns(spark, d):
    """Users' and assistants' words of a conversation, lower-cased."""
    turns = table(spark, d, "conversations", "conv_id", "role", "text")
    out = readings.agreement(turns.filter("role = 'user'"), turns.filter("role = 'assistant'"), ["conv_id"], tokenizer="lower")
    return out.withColumn("agreement", F.round("agreement", 6))


def similar_passages(spark, d):
    out = readings.similar_passages(documents(spark, d, "doc_id", "text"), table(spark, d, "benchmark", "item_id", "text"), 0.25)
    return out.withColumn("agreement", F.round("agreement", 6))


def shared_words(spark, d):
    words = lambda df: df.select(F.explode(tx.lower_words(F.col("text"))).alias("word"))
    return readings.multiset_intersection(words(documents(spark, d, "text")), words(table(spark, d, "benchmark", "text")), ["word"])


def page_routes(spark, d):
    return readings.route_pages(derive.page_layer(spark, d)).select("doc_id", "reason")


def reconciled_readings(spark, d):
    out = readings.reconcile_readings(derive.page_layer(spark, d), derive.second_readings(spark, d), ["doc_id"])
    return out.select("doc_id", "method", "text", F.col("alternative.method").alias("other_method"), F.col("alternative.text").alias("other_text"), "reason", "note", "confidence")


def reading_summary(spark, d):
    layer = derive.page_layer(spark, d)
    out = readings.reconcile_readings(layer, derive.second_readings(spark, d), ["doc_id"])
    return readings.reading_summary(out.join(layer.select("doc_id", "source"), "doc_id"), ["source"])


QUERIES = {f.__name__: f for f in (agreement, agreement_turns, similar_passages, shared_words, page_routes, reconciled_readings, reading_summary)}

_READING = r"list_filter(string_split_regex({t}, '[\s\x0B\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x{{FEFF}}।॥.,;:!?()\"''\x{{2013}}\x{{2014}}-]+'), lambda w: regexp_matches(w, '\p{{L}}'))".replace('\\"', '"')
_LOWER = r"regexp_extract_all(lower({t}), '[\p{{L}}\p{{N}}_\x{{900}}-\x{{97F}}]+')"
_SECOND = "SELECT doc_id, CASE WHEN doc_id % 13 = 5 THEN regexp_replace(text, '[aeiou]', 'x', 'g') ELSE replace(text, 'the', 'tbe') END AS ocr_text, (doc_id % 50 + 50) / 100 AS confidence FROM documents"
_LAYER = r"""SELECT doc_id, source, regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') AS text, abs(doc_id) % 3 AS images, legacy FROM (
  SELECT doc_id, source, CASE WHEN doc_id % 5 = 2 THEN 'पृष्ठ' || chr(10) || text ELSE text END AS text, doc_id % 7 = 3 AS legacy FROM documents
  UNION ALL SELECT -doc_id - 1, source, CASE WHEN doc_id % 11 = 0 THEN '' ELSE 'p ' || doc_id END, false FROM documents WHERE doc_id % 11 < 2)"""
_ROUTE = r"""CASE WHEN len(regexp_extract_all(text, '[\p{L}\p{N}]')) < 20 THEN CASE WHEN images > 0 OR text = '' THEN 'scan' END WHEN legacy THEN 'legacy-font' WHEN regexp_matches(text, '[\x{900}-\x{97F}]') THEN 'check' END"""


def _dice(key: str, left: str, right: str, words: str) -> str:
    return f"""wl AS (SELECT {key}, unnest({words.format(t="text")}) AS w FROM ({left})), wr AS (SELECT {key}, unnest({words.format(t="text")}) AS w FROM ({right})),
cl AS (SELECT {key}, w, count(*) AS n FROM wl GROUP BY ALL), cr AS (SELECT {key}, w, count(*) AS n FROM wr GROUP BY ALL),
sh AS (SELECT {key}, sum(least(cl.n, cr.n)) AS shared FROM cl JOIN cr USING ({key}, w) GROUP BY {key}),
ks AS (SELECT {key} FROM ({left}) UNION SELECT {key} FROM ({right})),
dice AS (SELECT k.{key}, coalesce(sh.shared, 0)::BIGINT AS shared, coalesce(a.n, 0)::BIGINT AS left_words, coalesce(b.n, 0)::BIGINT AS right_words
  FROM ks k LEFT JOIN sh USING ({key}) LEFT JOIN (SELECT {key}, count(*) AS n FROM wl GROUP BY {key}) a USING ({key}) LEFT JOIN (SELECT {key}, count(*) AS n FROM wr GROUP BY {key}) b USING ({key}))"""


_DICE_OUT = "CASE WHEN left_words + right_words = 0 THEN 1.0::DOUBLE ELSE 2 * shared / (left_words + right_words) END"
_RECONCILED = f"""layer AS ({_LAYER}), r AS (SELECT *, {_ROUTE} AS why FROM layer), second AS ({_SECOND}),
{_dice("doc_id", "SELECT doc_id, text FROM layer", "SELECT doc_id, ocr_text AS text FROM second", _READING)},
j AS (SELECT r.doc_id, r.source, r.text, r.why, s.ocr_text, s.confidence, s.doc_id IS NOT NULL AS has, r.why = 'check' AND s.ocr_text <> '' AND {_DICE_OUT} >= 0.5 AS ok FROM r LEFT JOIN second s ON s.doc_id = r.doc_id AND r.why IS NOT NULL LEFT JOIN dice ON dice.doc_id = r.doc_id),
k AS (SELECT *, coalesce(has AND ok, false) AS trusted FROM j),
out AS (SELECT doc_id, source, CASE WHEN why IS NULL OR trusted THEN 'text' WHEN has THEN 'ocr' WHEN text = '' THEN 'none' ELSE 'text' END AS method,
  CASE WHEN trusted OR NOT has THEN text ELSE ocr_text END AS text, CASE WHEN trusted THEN 'ocr' WHEN has AND text <> '' THEN 'text' END AS other_method, CASE WHEN trusted THEN ocr_text WHEN has AND text <> '' THEN text END AS other_text,
  CASE WHEN has AND NOT trusted THEN CASE WHEN why = 'check' THEN 'mismatch' ELSE why END END AS reason, CASE WHEN why IS NOT NULL AND NOT has AND text = '' THEN 'unavailable' END AS note0, CASE WHEN has AND NOT trusted THEN confidence END AS confidence FROM k),
fin AS (SELECT * EXCLUDE (note0), CASE WHEN text = '' AND note0 IS NULL THEN 'empty' ELSE note0 END AS note FROM out)"""

ORACLE = {
    "agreement": f"WITH {_dice('doc_id', 'SELECT doc_id, text FROM documents', f'SELECT doc_id, ocr_text AS text FROM ({_SECOND})', _READING)} SELECT *, round({_DICE_OUT}, 6) AS agreement FROM dice",
    "agreement_turns": "WITH " + _dice("conv_id", "SELECT conv_id, text FROM conversations WHERE role = 'user'", "SELECT conv_id, text FROM conversations WHERE role = 'assistant'", _LOWER) + f" SELECT *, round({_DICE_OUT}, 6) AS agreement FROM dice",
    "similar_passages": f"""
WITH a AS (SELECT doc_id, unnest({_LOWER.format(t='text')}) AS w FROM documents), b AS (SELECT item_id, unnest({_LOWER.format(t='text')}) AS w FROM benchmark),
ca AS (SELECT doc_id, w, count(*) AS n FROM a GROUP BY ALL), cb AS (SELECT item_id, w, count(*) AS n FROM b GROUP BY ALL),
s AS (SELECT doc_id, item_id, sum(least(ca.n, cb.n))::BIGINT AS shared FROM ca JOIN cb USING (w) GROUP BY ALL)
SELECT doc_id, item_id, shared, round(2 * shared / (x.n + y.n), 6) AS agreement FROM s JOIN (SELECT doc_id, count(*) AS n FROM a GROUP BY ALL) x USING (doc_id) JOIN (SELECT item_id, count(*) AS n FROM b GROUP BY ALL) y USING (item_id)
WHERE 2 * shared / (x.n + y.n) >= 0.25""",
    "shared_words": f"""
WITH a AS (SELECT unnest({_LOWER.format(t='text')}) AS word FROM documents), b AS (SELECT unnest({_LOWER.format(t='text')}) AS word FROM benchmark)
SELECT word, least(x.n, y.n)::BIGINT AS times FROM (SELECT word, count(*) AS n FROM a GROUP BY word) x JOIN (SELECT word, count(*) AS n FROM b GROUP BY word) y USING (word)""",
    "page_routes": f"SELECT doc_id, {_ROUTE} AS reason FROM ({_LAYER})",
    "reconciled_readings": f"WITH {_RECONCILED} SELECT * EXCLUDE (source) FROM fin",
    "reading_summary": f"WITH {_RECONCILED} SELECT source, count(*) AS pages, count(*) FILTER (method = 'text') AS text_pages, count(*) FILTER (method = 'ocr') AS ocr_pages, count(*) FILTER (note = 'unavailable') AS unavailable FROM fin GROUP BY source",
}
