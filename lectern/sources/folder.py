"""Documents from a folder of text files, and PDFs from a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """name, text of every .md and .txt file: the name is the file's without its suffix, line ends stay as they are."""
    files = spark.read.option("pathGlobFilter", "*.{md,txt}").text(folder, wholetext=True)
    return files.select(F.regexp_replace("_metadata.file_name", r"\.(md|txt)$", "").alias("name"), F.col("value").alias("text"))


def read_pdf_folder(spark: SparkSession, folder: str) -> DataFrame:
    """name, text, pages, unread, why of every .pdf file."""
    from lectern.sources.pdf import read_pdfs

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder)
    return read_pdfs(files.select(F.regexp_replace("_metadata.file_name", r"\.pdf$", "").alias("name"), F.col("content").alias("bytes")))
