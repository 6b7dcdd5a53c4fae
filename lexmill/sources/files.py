"""Documents and pages from files, and results to files."""

from __future__ import annotations

import importlib.util
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import PdfSupportError


def base_name(path: Column) -> Column:
    """The last part of a path or URL, decoded."""
    return F.url_decode(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\+", "%2B"))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, source_name, text: one document per UTF-8 file."""
    read = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    return read.select(F.xxhash64("path").alias("doc_id"), base_name(F.col("path")).alias("source_name"), F.col("value").alias("text"))


def pdf_pages(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, source_name, page_number, raw: the pages of PDF files, read on the executors."""
    if importlib.util.find_spec("fitz") is None:
        raise PdfSupportError("reading PDF files needs PyMuPDF; give pages (doc_id, page_number, raw) instead")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{pdf,PDF}").load(path)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import fitz

        for batch in batches:
            for row in batch.itertuples():
                with fitz.open(stream=io.BytesIO(row.content), filetype="pdf") as document:
                    raw = [page.get_text("text") for page in document]
                yield pd.DataFrame({"doc_id": row.doc_id, "source_name": row.source_name, "page_number": range(1, len(raw) + 1), "raw": raw})

    own = files.select(F.xxhash64("path").alias("doc_id"), base_name(F.col("path")).alias("source_name"), "content")
    return own.mapInPandas(read, "doc_id long, source_name string, page_number int, raw string")


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_text(df: DataFrame, path: str, column: str = "text") -> None:
    df.select(column).write.text(path)


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Chunks, sections or citations as Parquet, in folders by the given columns."""
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
