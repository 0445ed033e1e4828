"""The contract queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, ctph, embed_dedup, kneser_ney, licenses, packing, simhash, token_orc, toxicity, warc

VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, radius=4)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_orc.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), end_id=0)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model, limits = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text", "lang"), model, limits, lang_col="lang")  # the language chooses a threshold, never a score
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(toxicity.FOLDS)) == 0
    return scored.select("doc_id", held.alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"), F.col("toxic_limit").alias("lang_threshold"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), end_id=2).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctph.compare_with_edits(table(spark, sf_dir, "documents"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1,
        "op2_multi_index": op2,
        "op3_token_orc": op3,
        "op4_license_scan": op4,
        "op5_toxicity": op5,
        "op6_byte_bpe": op6,
        "op7_best_fit_packing": op7,
        "op8_warc_archive": op8,
        "op9_piecewise_hash": op9,
        "op10_kneser_ney": op10,
        "pipeline": pipeline,
    }


OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e,
         label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
         AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), false)
         AND coalesce(list_bool_or(list_transform(embedding, lambda x: x <> 0)), false) AS ok
  FROM embeddings),
links AS (
  SELECT a.r AS a, b.r AS b FROM v a JOIN v b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
  WHERE a.ok AND b.ok AND CASE WHEN a.ok AND b.ok THEN list_cosine_similarity(a.e, b.e) END >= 0.93),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT reach.a, min(v.vec_id) AS least FROM reach JOIN v ON v.r = reach.b GROUP BY reach.a)
SELECT v.vec_id, CAST(count(links.b) AS BIGINT) AS n_links,
       CAST(least(v.vec_id, coalesce(min(least.least), v.vec_id)) AS BIGINT) AS component_id,
       v.vec_id = least(v.vec_id, coalesce(min(least.least), v.vec_id)) AS kept
FROM v LEFT JOIN links ON links.a = v.r LEFT JOIN least ON least.a = v.r
GROUP BY v.r, v.vec_id
"""

OP8_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_page FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_page THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_page THEN first_page END AS refers_to
FROM q
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_multi_index": OP2_SQL, "op8_warc_archive": OP8_SQL}
