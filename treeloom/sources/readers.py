"""Sources of text, and sinks of results."""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.functions.detect import detect_language


def read_sources(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """doc_id, path, language, text, error of files, each whole; files that aren't UTF-8 have an error and no text.

    doc_id is a hash of the path, so it is the same in every run.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)
    text = F.col("content").cast("string")
    ok = F.is_valid_utf8(text)
    return files.select(
        F.xxhash64("path").alias("doc_id"), "path", F.when(ok, text).alias("text"), F.when(~ok, "not valid UTF-8").alias("error"),
    ).withColumn("language", detect_language("path", "text"))


def read_source(spark: SparkSession, file: str) -> DataFrame:
    """One file, or standard input for ``-``."""
    raw = sys.stdin.buffer.read() if file == "-" else Path(file).read_bytes()
    rows = spark.createDataFrame([(0, None if file == "-" else file, bytearray(raw))], "doc_id long, path string, content binary")
    text = F.col("content").cast("string")
    return rows.select("doc_id", "path", F.when(F.is_valid_utf8(text), text).alias("text")).withColumn("language", detect_language("path", "text"))


def from_rows(spark: SparkSession, rows: list[tuple[int, str, str]]) -> DataFrame:
    """(doc_id, language, text) rows in memory."""
    return spark.createDataFrame(rows, "doc_id long, language string, text string")


def write_json(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)
