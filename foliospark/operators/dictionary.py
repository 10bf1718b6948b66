"""Dictionaries of keys with dense numbers and frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from foliospark.functions.stage import written


def dense_numbers(keys: DataFrame, order: str, number: str = "id") -> DataFrame:
    """`keys` with numbers from 0 in the order of a column, without one window over all rows.

    Rows are range-partitioned and written, so that both uses of them see the
    same ranges; a row's number is its place in the partition plus the sizes of
    the partitions before (one short row each).
    """
    part = written(keys.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = part.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return part.withColumn("_in", inside).join(F.broadcast(before), "_part").withColumn(number, (F.col("_in") + F.col("_offset")).cast("bigint")).drop("_part", "_in", "_offset")


def frequencies(words: DataFrame, key: str) -> DataFrame:
    """key, freq of every key; null keys are left out."""
    return words.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("freq"))


def merged(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Two dictionaries as one; frequencies of common keys add up."""
    return a.unionByName(b).groupBy(key).agg(F.sum("freq").alias("freq"))


def first_seen_ids(words: DataFrame, key: str, position: str) -> DataFrame:
    """key, id: dense numbers in the order of each key's first position (positions are unique)."""
    first = words.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(position).alias("_first"))
    return dense_numbers(first, "_first").select(key, "id")


def lookup(words: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """`words` with the id of its key, -1 where the dictionary has none."""
    return words.join(ids.select(key, "id"), key, "left").withColumn("id", F.coalesce("id", F.lit(-1).cast("bigint")))


def without(dictionary: DataFrame, words: DataFrame, key: str) -> DataFrame:
    return dictionary.join(words.select(key).distinct(), key, "left_anti")


def only(dictionary: DataFrame, words: DataFrame, key: str) -> DataFrame:
    return dictionary.join(words.select(key).distinct(), key, "left_semi")
