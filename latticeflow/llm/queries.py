"""The opN_ queries over the corpus tables, and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, embeddings, html_extract, packing, quality, sharding, simhash, toxicity, url_filters, warc
from .common import new_path, table


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    labels = table(spark, sf_dir, "labels")
    bad = labels.groupBy(F.col("doc_id").alias("page_id")).agg(
        F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad")
    )
    mined = url_filters.mine_rules(pages.select("page_id", "url").join(bad, "page_id"))
    return url_filters.judge(pages, mined)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out("doc_id"))
    scorer = toxicity.fit(docs, labels)
    return toxicity.score(docs, scorer).select(
        F.col("id").alias("doc_id"),
        toxicity.held_out("id").alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), out)
    return warc.read(spark, out, payloads=False).select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        simhash.hex_fingerprint("fp").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select(
        F.col("id").alias("vec_id"),
        "n_links",
        F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"),
    )


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages")).select(F.col("id").alias("page_id"), "url", "text", "n_chars")


def op7_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.kd_shards(table(spark, sf_dir, "documents"), shards=8).select(
        F.col("id").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "similarity")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs)).withColumnRenamed("id", "doc_id")


QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_toxicity": op2_toxicity,
    "op3_warc": op3_warc,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_html_extraction": op6_html_extraction,
    "op7_kd_sharding": op7_kd_sharding,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_decontamination": op9_decontamination,
    "op10_quality_classifier": op10_quality_classifier,
}

# base32 is taken digit by digit: five bits of the SHA-1 at a time.
_ORACLE_OP3 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages
), d AS (
  SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha,
         min(page_id) OVER (PARTITION BY sha) AS first FROM p
)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + (('0x' || substr(sha, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) % 32, 1)),
         'string_agg', '') AS payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to
FROM d
"""

_ORACLE_OP5 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), fit AS (
  SELECT * FROM v WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                    AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM fit a JOIN fit b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98
), reach(id, root) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT w, root FROM reach JOIN links ON u = id
), roots AS (
  SELECT id, min(root) AS component_id FROM reach GROUP BY id
), counts AS (
  SELECT u, count(*) AS n FROM links GROUP BY u
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN roots ON id = vec_id LEFT JOIN counts ON u = vec_id
"""

# For the pages at hand, whose articles hold headings, paragraphs, bold text and line breaks only.
_ORACLE_OP6 = r"""
WITH inside AS (
  SELECT page_id, url, split_part(split_part(coalesce(html, ''), '<article>', 2), '</article>', 1) AS a FROM pages
), blocks AS (
  SELECT page_id, url, list_transform(
    regexp_split_to_array(regexp_replace(a, '<!--.*?-->', '', 'gs'), '</?(?:p|h[1-6])(?:\s[^>]*)?>'),
    lambda b: trim(regexp_replace(replace(replace(replace(replace(
      regexp_replace(regexp_replace(b, '<br[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g'),
      '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g'))) AS bs
  FROM inside
), texts AS (
  SELECT page_id, url, array_to_string(list_filter(bs, lambda b: b <> ''), chr(10) || chr(10)) AS text FROM blocks
)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM texts
"""

_ORACLE_OP9 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL
), i AS (
  SELECT item_id, w, len(w) AS n, least(5, len(w)) AS k FROM
    (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark WHERE text IS NOT NULL) WHERE len(w) > 0
), shingles AS (
  SELECT item_id, n, k, array_to_string(w[p : p + k - 1], ' ') AS s, count(*) AS c
  FROM (SELECT *, unnest(range(1, n - k + 2)) AS p FROM i) GROUP BY ALL
), places AS (
  SELECT doc_id, len(w) AS total, k, p, array_to_string(w[p : p + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM i))
), hits AS (
  SELECT doc_id, item_id, p, s, c, n - k + 1 AS per, least(n - k + 1, total - k + 1) AS held, greatest(1, total - n + 1) AS last
  FROM places JOIN shingles USING (k, s)
), windows AS (
  SELECT DISTINCT doc_id, item_id, per, held, unnest(range(greatest(1, p - held + 1), least(p, last) + 1)) AS start FROM hits
), common AS (
  SELECT doc_id, item_id, windows.per, windows.held, start, s, least(count(*), any_value(c)) AS c
  FROM windows JOIN hits USING (doc_id, item_id) WHERE p BETWEEN start AND start + windows.held - 1 GROUP BY ALL
), alike AS (
  SELECT doc_id, item_id, sum(c)::DOUBLE / (per + held - sum(c))::DOUBLE AS similarity
  FROM (SELECT doc_id, item_id, per, held, start, s, c FROM common) GROUP BY doc_id, item_id, per, held, start
)
SELECT doc_id, item_id, max(similarity) AS similarity FROM alike WHERE similarity >= 0.8 GROUP BY ALL
"""

ORACLE: dict[str, str] = {
    "op3_warc": _ORACLE_OP3,
    "op5_embedding_near_dedup": _ORACLE_OP5,
    "op6_html_extraction": _ORACLE_OP6,
    "op9_decontamination": _ORACLE_OP9,
}
