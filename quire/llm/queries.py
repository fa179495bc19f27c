"""One registered query per operator of this folder, with its SQL where SQL can say the same."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import hard_negatives, host_paths, kd_shards, kneser_ney, mixing, minhash, periodic_runs, pieces, pivot_search, quality_rules, simhash, substring_dedup, suffix_dedup
from quire.sources.tables import table

WORD = r"[^\x20\x09-\x0D]+"

#: Where the model file is; it is read on the driver.
MODEL = os.environ.get("SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of 50-word passages that stand in an earlier document are removed; digest of what is left."""
    cut = substring_dedup.drop_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


SQL_OP1 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i, w FROM d),
k AS (SELECT doc_id, i, word, CASE WHEN i + 49 <= n THEN md5_number(array_to_string(w[i:i + 49], ' ')) END AS win FROM p),
f AS (SELECT *, CASE WHEN win IS NULL THEN NULL ELSE min(doc_id) OVER (PARTITION BY win) END AS first FROM k),
c AS (SELECT doc_id, i, word, coalesce(max(CASE WHEN first < doc_id THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) AS gone FROM f),
g AS (SELECT doc_id, count(*) AS n, sum(gone) AS r, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0), '') AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(r, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)
"""


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of 200-byte strings that start anywhere else are removed; digest of what is left."""
    cut = suffix_dedup.drop_repeated_bytes(table(spark, sf_dir, "documents", "doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


SQL_OP2 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
o AS (SELECT doc_id, length(h) // 2 AS n, unnest(range((length(h) // 2 + 499) // 500)) AS c, h FROM d),
q AS (SELECT doc_id, n, c, substr(h, 1000 * c + 1, 1398) AS h FROM o),
p AS (SELECT doc_id, n, c, h, unnest(range(least(500, n - 500 * c))) AS j FROM q),
k AS (SELECT doc_id, 500 * c + j AS i, substr(h, 2 * j + 1, 2) AS b, CASE WHEN 500 * c + j + 200 <= n THEN md5_number(substr(h, 2 * j + 1, 400)) END AS win FROM p),
f AS (SELECT doc_id, i, b, CASE WHEN win IS NULL THEN 0 WHEN count(*) OVER (PARTITION BY win) > 1 THEN 1 ELSE 0 END AS again FROM k),
c AS (SELECT doc_id, i, b, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS gone FROM f),
e AS (SELECT *, CASE WHEN gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) = 0 THEN 1 ELSE 0 END AS begins FROM c),
g AS (SELECT doc_id, count(*) AS n, sum(gone) AS r, sum(begins) AS s, coalesce(string_agg(b, '' ORDER BY i) FILTER (WHERE gone = 0), '') AS kept FROM e GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_bytes, coalesce(r, 0)::BIGINT AS n_removed, coalesce(s, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)
"""



def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every text under the model of the trusted ones, against its language's threshold."""
    return kneser_ney.judged(table(spark, sf_dir, "documents", "doc_id", "text", "lang"), table(spark, sf_dir, "labels"))


def op4_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of near-equal bytes."""
    rows = kd_shards.shard(table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))
    return rows.withColumn("grown_shard", F.lit(None).cast("int"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, read by its host's consensus path."""
    return host_paths.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes, with its source's size and target."""
    rows = mixing.mix(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"), "times")


def op7_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest integer inner products of every hundredth vector with all others."""
    return pivot_search.top_k(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


SQL_OP7 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of every text and the component of near copies it belongs to."""
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every text, the base rule, and the verdict of the list learned from all labels."""
    return quality_rules.judged(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every text, and whether decoding them gives it back."""
    return pieces.round_trip(table(spark, sf_dir, "documents", "doc_id", "text"), pieces.load(MODEL)).drop("text")


def _planted(text: Column, doc_id: Column) -> Column:
    """One text in ten repeats what begins at one of its words with a period, both drawn from the id's checksum; a null id leaves the text as it is."""
    draw = F.crc32(doc_id.cast("string"))
    g = F.floor(draw / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
        again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(again, F.lit(1), n - a)), " ")

    # The lambda binds the words, which are found once.
    made = F.transform(F.array(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), lambda words: F.when(F.size(words) > 0, repeated(words)).otherwise(""))
    return F.when((draw % 10 == 0) & text.isNotNull(), made[0]).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words that repeat with a period in every text, the longest, and digests of all runs and of the text with each run cut to its first period."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text").withColumn("text", _planted(F.col("text"), F.col("doc_id")))
    rows = periodic_runs.collapse(docs)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    rows = rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("l"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"), "n_words")
    exponent = F.floor(F.lit(1000) * F.col("l.length") / -F.col("l.period"))
    return rows.select("doc_id", "n_runs", (-F.col("l.start")).alias("start"), F.col("l.length").alias("length"), (-F.col("l.period")).alias("period"), exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256", "n_words")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector's five nearest of its label; every seventh row's label is moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label").withColumn("label", label))


SQL_OP12 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score FROM v a JOIN v r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS i FROM s WHERE same),
n AS (SELECT p.anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
  row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score WHERE i <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""


def op13_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every text among those whose five-word shingles are alike in 85 of 100, one of each kept."""
    rows = minhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), similarity=0.85)
    return rows.select("doc_id", "n_shingles", "component_id", F.expr("doc_id <=> component_id").alias("kept"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_kd_shards": op4_kd_shards,
    "op5_html_extraction": op5_html_extraction,
    "op6_mixing": op6_mixing,
    "op7_pivot_search": op7_pivot_search,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_minhash_near_dedup": op13_minhash_near_dedup,
}

ORACLE: dict[str, str] = {
    "op1_substring_dedup": SQL_OP1,
    "op2_suffix_dedup": SQL_OP2,
    "op7_pivot_search": SQL_OP7,
    "op12_hard_negatives": SQL_OP12,
}
