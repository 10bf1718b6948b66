"""The files of a finished corpus, its options and report, and reading them again."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from foliospark.operators import documents, pages as P
from foliospark.sources.dumps import PREFIX, SUFFIX, limited, write_lines


@dataclass
class ParseOptions:
    """What goes into the corpus and how it is marked."""

    discard_lists: bool = True
    discard_disambiguations: bool = True
    captions: bool = True
    marks: bool = True
    test_pages: int | None = None

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(asdict(self), f)

    @classmethod
    def load(cls, path: str) -> ParseOptions:
        """Saved options; the defaults where there is no file."""
        try:
            with open(path, encoding="utf-8") as f:
                return cls(**json.load(f))
        except FileNotFoundError:
            return cls()


def estimated_output(input_bytes: int, compressed: bool) -> int:
    """Bytes of the written corpus for a dump of a size (published ratios)."""
    return input_bytes * 40 // (11 if compressed else 55)


def corpus(records: DataFrame, options: ParseOptions, keys: list[str] | None = None) -> DataFrame:
    """Typed and parsed pages: keys, title, page_type, is_list, target, xml, plain, errors.

    `records` has title, ns, text (unescaped) and the keys. Redirects keep
    their target and are not parsed; pages of other types go before Python.
    """
    keys = keys or ["title"]
    if options.test_pages is not None:
        records = limited(records, keys[0], options.test_pages)
    t, n, x = F.col("title"), F.col("ns"), F.col("text")
    typed = records.withColumn("kind", P.page_type(t, n, x)).withColumn("is_list", P.is_list(t, x))
    routed = P.routed(typed.withColumnRenamed("kind", "page_type"), options.discard_lists, options.discard_disambiguations)
    redirects = routed.where("page_type = 'redirect'").select(*keys, *(c for c in ("title",) if c not in keys), "page_type", "is_list", P.redirect_target(x).alias("target"))
    more = [*keys, *(c for c in ("title", "page_type", "is_list") if c not in keys)]
    parsed = documents.parsed(routed.where("page_type <> 'redirect'"), more).select(*more, "xml", "plain", "errors")
    return parsed.unionByName(redirects, allowMissingColumns=True)


def write_corpus(pages: DataFrame, folder: str) -> None:
    """Parquet as the primary form, and the text files: page trees, plain text, titles, redirects, report."""
    pages.write.mode("overwrite").parquet(f"{folder}/corpus")
    stored = pages.sparkSession.read.parquet(f"{folder}/corpus")
    write_lines(stored.where("xml IS NOT NULL").withColumn("line", F.replace("xml", F.lit("\n"), F.lit("&#10;"))), "line", f"{folder}/trees")
    write_lines(stored.where("plain IS NOT NULL"), "plain", f"{folder}/plain_text")
    write_lines(stored.where("page_type IN ('article', 'disambiguation')").select("title").orderBy("title"), "title", f"{folder}/titles")
    write_lines(stored.where("page_type = 'redirect' AND target IS NOT NULL").select(F.concat("title", F.lit("\t\t-->\t\t"), "target").alias("line")).orderBy("line"), "line", f"{folder}/redirects")
    write_lines(report(stored).select(F.concat_ws("\t", "part", "name", F.col("n").cast("string")).alias("line")), "line", f"{folder}/report")


def report(pages: DataFrame) -> DataFrame:
    """part, name, n: pages by type, sizes, and errors by message, most frequent first."""
    types = pages.groupBy("page_type").agg(F.count("*").alias("n")).select(F.lit("pages").alias("part"), F.col("page_type").alias("name"), "n")
    sizes = pages.agg(F.coalesce(F.sum(F.octet_length("xml")), F.lit(0)).alias("n")).select(F.lit("size").alias("part"), F.lit("tree bytes").alias("name"), "n")
    errors = pages.select(F.explode("errors").alias("e")).groupBy("e.category", "e.message").agg(F.count("*").alias("n"))
    return types.unionByName(sizes).unionByName(errors.select(F.lit("errors").alias("part"), F.concat_ws(": ", "category", "message").alias("name"), "n")).orderBy("part", F.desc("n"), "name")


def joined_xml(spark: SparkSession, folder: str, path: str) -> None:
    """All page trees of a written corpus in one file with the enclosing element, one partition at a time on the driver."""
    with open(path, "w", encoding="utf-8") as f:
        f.write(PREFIX)
        for row in spark.read.text(f"{folder}/trees").toLocalIterator():
            f.write(row.value)
        f.write(SUFFIX)


def page(spark: SparkSession, folder: str, title: str) -> DataFrame:
    """One page of a written corpus; the filter reaches the Parquet scan."""
    return spark.read.parquet(f"{folder}/corpus").where(F.col("title") == title)


# ---------------------------------------------------------- plain tables of lines, columns and numbers


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """value: lines without their line ends, whichever these are."""
    return spark.read.text(path).select(F.regexp_replace("value", "\r\\z", "").alias("value"))


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("sep", "\t").option("quote", "").option("mode", "PERMISSIVE").schema(schema).csv(path)


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated columns without quotes; null is empty."""
    df.select(F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns)).alias("value")).write.mode("overwrite").text(path)


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """path, content of files as bytes."""
    return spark.read.format("binaryFile").load(path).select("path", "content")
