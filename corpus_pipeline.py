"""A corpus pipeline over ``documents``: toxicity, quality, near duplicates, packing.

Each stage takes all that the one before kept; all but the last return the columns of documents. Decisions are joined
to rows by id and text, so that rows without an id or with a repeated one are judged by their own text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtide.llm import kneser_ney, packing, simhash, toxicity
from rowtide.llm.common import Scratch, utf8

#: No stage but the second half of packing has a form in SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below their language's threshold."""
    model, limits = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    own, limit = (f"{x}_{'_'.join(docs.columns)}" for x in ("score", "limit"))  # unlike any column of documents
    return toxicity.score(docs, model, limits, lang_col="lang", score_col=own, limit_col=limit).where(F.col(own) < F.col(limit)).select(docs.columns)


def marked(docs: DataFrame, id_col: str, mark_col: str) -> DataFrame:
    """Documents with their id and a hash of their text under names unlike theirs, by which decisions are joined to rows."""
    return docs.withColumn(id_col, docs["doc_id"].cast("long")).withColumn(mark_col, F.xxhash64(utf8(docs["text"])))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within their language's threshold."""
    scored = kneser_ney.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    own, mark, lang = (f"{x}_{'_'.join(docs.columns)}" for x in ("id", "mark", "lang"))
    poor = scored.where("not keep").select(F.col("doc_id").alias(own), F.col("mark").alias(mark), F.col("lang").alias(lang)).distinct()
    rows = marked(docs, own, mark).withColumn(lang, docs["lang"].cast("string"))
    same = rows[own].eqNullSafe(poor[own]) & (rows[mark] == poor[mark]) & rows[lang].eqNullSafe(poor[lang])
    return rows.join(poor, same, "left_anti").select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of the least id (null last)."""
    groups = Scratch(spark, "groups").save(simhash.near_duplicates(docs, words=5, similarity=0.8), "rows")
    own, mark = (f"{x}_{'_'.join(docs.columns)}" for x in ("id", "mark"))
    found = groups.groupBy(F.col("doc_id").alias(own), F.col("mark").alias(mark)).agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    found = Scratch(spark, "groups").save(found.where("not kept or n > 1"), "decided")
    rows = marked(docs, own, mark)

    def of(some: DataFrame, how: str) -> DataFrame:
        return rows.join(some, rows[own].eqNullSafe(some[own]) & (rows[mark] == some[mark]), how)

    out = of(found, "left_anti").select(docs.columns)
    again = found.where("kept")  # the same text under the same id: one row of them
    if again.isEmpty():
        return out
    return out.unionByName(of(again, "left_semi").dropDuplicates([own, mark]).select(docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    packed = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("near copies", drop_near_copies), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.save(docs, f"stage-{i}")
    return docs


