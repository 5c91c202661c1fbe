"""The training-text pipeline: five stages, each written as Parquet and read again before the next.

A document without text, of a language without trusted text or without doc_id passes the
filters. All stages but the last return the columns of documents, and no other column of the input.
"""

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringwatch.llm import decontamination, line_dedup, mixing, n_gram_quality, near_duplicates
from ringwatch.llm.common import table, with_missing
from ringwatch.session import shared_folder

COLUMNS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}


def documents_only(docs: DataFrame) -> DataFrame:
    return with_missing(docs, **COLUMNS).select(*COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within the quantile of trusted text of their language."""
    return n_gram_quality.keep_good(documents_only(docs), table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go; the documents stay."""
    kept = line_dedup.drop_shared_lines(documents_only(docs), min_docs=10)
    text = F.when(F.col("text").isNotNull(), F.col("kept_text"))
    return kept.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id."""
    return near_duplicates.keep_representatives(documents_only(docs))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.clean_documents(documents_only(docs), table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document is taken for the mix: doc_id, source, size, source_size, target, copies, taken."""
    return mixing.mix_sources(documents_only(docs)).drop("tie")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("source_mix", mix),
]

#: no SQL for the model, the candidate search or the draw; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result goes through a Parquet folder beside the checkpoints."""
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}_{name}")
        docs = spark.read.parquet(f"{folder}/{k}_{name}")
    return docs
