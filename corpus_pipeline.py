"""Corpus pipeline over ``documents``: each stage works on all rows the one before it kept.

Stages, in order: language ID (rows it rejects go, ``lang`` becomes the identified language), n-gram Jaccard join (of each
group of near duplicates the row with the smallest doc_id stays), benchmark decontamination (contaminated rows go), PII (spans become their kind
in angle brackets, ``n_chars`` follows) and SentencePiece (ids, byte spans and decoded text of each row left).
All stages but the last return the columns of ``documents``. SQL cannot express stages 1, 4 and 5, so ORACLE_SQL is None and
the pipeline is tested against plain versions.

Null texts are rejected by the first stage. Rows with a null doc_id are in no group of near duplicates: they stay. Of
rows with equal doc_id and text one stays. Empty tables pass through all stages; extra columns stay to the last but one.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import decontaminate, language_id, ngram_join, pii, sentencepiece_codec
from ledgerlens.llm.common import fresh_name, shared_dir, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    into = fresh_name(docs, "identified")
    out = language_id.identify(docs, text_col="text", declared=F.col("lang"), host=F.col("source"), into=into)
    return out.where(F.col(into)["accepted"]).withColumn("lang", F.col(into)["language"]).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups, gone = ngram_join.near_duplicates(docs), fresh_name(docs, "_gone")
    # One row of a component has the smallest doc_id (repeated rows of it count as one); documents without words link with nothing.
    lost = groups.where("component_id < doc_id").select(F.col("doc_id").alias(gone)).distinct()
    kept = docs.join(lost, F.col("doc_id") == F.col(gone), "left_anti")
    keyed = kept.where("doc_id is not null").dropDuplicates(["doc_id", "text"])
    return keyed.unionByName(kept.where("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    into = fresh_name(docs, "scan")
    out = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"), into=into)
    return out.where(~decontaminate.contaminated(F.col(into)["n_words"], decontaminate.n_hit(into))).select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    into = fresh_name(docs, "pii")
    out = pii.detect(docs, into=into).withColumn("text", pii.redacted(F.col("text"), F.col(into)["spans"]))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = docs.select("doc_id", "lang", "source", "text")
    out = sentencepiece_codec.encode(rows, public_tokenizers.path("piece_bpe_32k.model"), into="p")
    return out.select("doc_id", "lang", "source", "p.ids", "p.starts", "p.ends", F.col("p.decoded").alias("decoded"))


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("sentencepiece", encode_pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{base}/{k}-{name}")
            docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs
