"""Dump parts that arrive in a folder, as a stream of page records.

The format has no event time: files are read once each, in arrival order, and
counts need no watermark (their state is one row per page type).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from foliospark.operators import pages as P
from foliospark.sources.dumps import first_page


def read_pages(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """title, ns, text of the pages in files that arrive in a folder (compressed or not)."""
    lines = spark.readStream.option("lineSep", "</page>").option("maxFilesPerTrigger", files_per_batch).text(folder)
    raw = lines.where(F.instr("value", "<page>") > 0).select(first_page(F.concat("value", F.lit("</page>"))).alias("raw"))
    return P.records(raw)


def count_types(records: DataFrame) -> DataFrame:
    """page_type, count over all pages so far."""
    return records.groupBy(P.page_type(F.col("title"), F.col("ns"), F.col("text")).alias("page_type")).count()


def append_to(records: DataFrame, path: str, checkpoint: str):
    """Write records to a Parquet folder, each file's pages exactly once."""
    return records.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
