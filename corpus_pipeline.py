"""Training-corpus pipeline over ``documents``: five operators, each stage on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's ``docs``; all but the last return
the columns of ``documents``.
"""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import decontam, langid, line_dedup, packing, simhash
from quantloom.session import cut_lineage

TOKENIZER = "byte_bpe_50k.json"
ORACLE_SQL = None      # language id, SimHash and BM25 are not SQL; tests/llm holds the brute-force version


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; those without text or letters (``und``) go."""
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.with_language(docs, model, "_found").where(
        F.col("_found.lang_pred") != langid.UNKNOWN).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later matches of a line leave the texts; every document stays, ``n_chars`` follows its text."""
    out = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every SimHash component stays."""
    return simhash.drop_near(docs, shingle=3, max_bits=2)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that give a test item away go."""
    return decontam.remove_leaks(docs, spark.read.parquet(os.path.join(sf_dir, "benchmark.parquet")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences, with the ids' checksum."""
    pieces = packing.pack(docs, public_tokenizers.path(TOKENIZER))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


STAGES = [("language_id", language_id), ("line_dedup", dedup_lines), ("simhash_dedup", near_dedup),
          ("decontamination", decontaminate), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
