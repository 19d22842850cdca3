"""Corpus pipeline: language filter, exact and near de-duplication, source mixing, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame, which is written as Parquet and read again as the
next one's docs.  All but the last return the columns of ``documents``; the
last returns the pieces of packed sequences.

Defined cases: an empty table gives no pieces; without labelled rows the language
stage keeps all; texts without a letter go there, null texts among them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evalforge.llm.exactdup import drop_exact
from evalforge.llm.langid import keep_known_languages
from evalforge.llm.mixing import mixed_order
from evalforge.llm.neardup import drop_near
from evalforge.llm.packing import pack
from evalforge.session import scratch_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_known_languages(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_order(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Files come back in any order, so the mixed order is worked out again; sequences are numbered along it."""
    return pack(mixed_order(docs))


STAGES = [("language", language), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup),
          ("mix_sources", mix_sources), ("pack_sequences", pack_sequences)]

#: SQL cannot run the recurrent network or the tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
