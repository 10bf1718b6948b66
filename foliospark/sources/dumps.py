"""Dump files as rows of page strings, and the files written from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SUFFIXES = (".xml", ".xml.bz2")
PREFIX, SUFFIX = '<?xml version="1.0" encoding="utf-8"?><pages>', "</pages>"


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """raw: one row per <page>…</page> of a dump file or a folder of them, compressed or not.

    The file is cut at the closing tag by the text source, so a bzip2 file is
    split among tasks. Other suffixes are refused; folders are not checked.
    """
    name = path.rstrip("/").rsplit("/", 1)[-1]
    if "." in name and not name.endswith(SUFFIXES):
        raise ValueError(f"a dump ends in {' or '.join(SUFFIXES)}: {path}")
    lines = spark.read.option("lineSep", "</page>").text(path)
    return lines.where(F.instr("value", "<page>") > 0).select(first_page(F.concat("value", F.lit("</page>"))).alias("raw"))


def first_page(s: Column) -> Column:
    return F.substring(s, F.instr(s, "<page>"), 0x7FFFFFFF)


def split_pages(s: Column) -> Column:
    """All page strings of a text, in order; what stands outside of them is left out."""
    return F.regexp_extract_all(s, F.lit("(?s)(<page>.*?</page>)"), F.lit(1))


def limited(pages: DataFrame, order: str, n: int) -> DataFrame:
    """A test run: the first n pages in input order, exactly n."""
    return pages.orderBy(order).limit(n)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """One text line per row; partitions become files."""
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def envelope(xml: Column) -> Column:
    """Page trees joined into one document. For exports small enough for one row."""
    return F.concat(F.lit(PREFIX), F.array_join(F.transform(F.array_sort(F.collect_list(xml)), lambda x: x), ""), F.lit(SUFFIX))
