"""Report sources: text files, raw bytes and inline tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import tabular, text


def write_reports(reports: DataFrame, path: str) -> str:
    """Reports (name, text) as text files of many reports each, a file per task; returns the mark that ends each report.

    The name, of one line, is the first line of a report; where the text is null it is all of it. The mark is drawn anew
    for each call, as for the parts of a mail, so that no text holds it.
    """
    mark = f"\n--{uuid.uuid4().hex}--\n"
    named = F.concat_ws("\n", F.coalesce(F.col("name").cast("string"), F.lit("")), "text")
    reports.select(named.alias("value")).write.text(path, lineSep=mark)
    return mark


def read_reports(spark: SparkSession, path: str, mark: str | None = None) -> DataFrame:
    """One row per text file, or per report of files by ``write_reports``: path (or name), text, line_count."""
    if mark is None:
        files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    else:
        name = F.substring_index("value", "\n", 1)
        files = spark.read.text(path, lineSep=mark).select(
            name.alias("path"),
            F.when(F.contains("value", F.lit("\n")), F.substring("value", F.length(name) + 2, F.length("value"))).alias("text"),
        )
    return files.select("path", "text", tabular.line_count(F.col("text")).alias("line_count"))


def read_bytes(spark: SparkSession, path: str) -> DataFrame:
    """One row per file, decoded as UTF-8 or, failing that, Latin-1."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", text.decode_bytes(F.col("content")).alias("text"))


def inline_reports(reports: DataFrame) -> DataFrame:
    """Reports that hold text; (case_id, doc_id, doc_kind, text)."""
    return reports.filter(text.strip(F.coalesce(F.col("text"), F.lit(""))) != "")


def blank_submissions(reports: DataFrame) -> DataFrame:
    """Cases whose submitted reports are all blank: these are refused."""
    filled = F.max(text.strip(F.coalesce(F.col("text"), F.lit(""))) != "")
    return reports.groupBy("case_id").agg(filled.alias("_any")).filter(~F.col("_any")).select("case_id")
