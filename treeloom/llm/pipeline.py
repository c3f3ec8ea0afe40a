"""The corpus pipeline: documents go through five stages, each written as Parquet and read again.

Each stage takes all rows that its predecessor kept, and all but the last return
them with the columns of documents, whatever other columns there are and however
they are named. An empty table passes every stage as an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, langid, neardup, packing, secretscan
from .shared import materialize, text_batches


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a language model of the corpus's languages compresses stay.

    Null texts, empty ones and those without a letter outside words with digits
    have no language and go; texts are judged entire, however long; repeated
    rows share their fate; a null doc_id or lang doesn't matter to a row's own fate.
    """
    text_batches(spark)
    return langid.keep_identified(docs, langid.train(docs))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the least doc_id.

    Rows with a null doc_id, and null, empty or wordless texts, are in no group
    and stay; of rows that repeat doc_id and text one stays; texts compare entire.
    """
    text_batches(spark)
    return neardup.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold none and stay; texts and items are read entire;
    repeated rows share their fate; without items all stay.
    """
    text_batches(spark)
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts, and n_chars follows; no row goes.

    Null and empty texts pass unchanged; texts are read entire; repeated rows change alike.
    """
    text_batches(spark)
    return secretscan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents take their places in training sequences.

    Rows with a null doc_id can't be named and take none, nor do null or empty
    texts; long texts are cut into pieces; equal lengths go by a hash of doc_id;
    repeated rows each take a place.
    """
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("near_dedup", dedup),
    ("decontamination", decontaminate),
    ("secret_redaction", redact),
    ("best_fit_packing", pack),
]

#: The stages hold models and iterations that SQL can't express; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
