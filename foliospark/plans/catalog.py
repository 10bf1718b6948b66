"""All core queries by name, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.operators import dewey
from foliospark.plans import documents, markup, matrices, pages, strings, vectors  # noqa: F401  (registers its queries)
from foliospark.plans.registry import ORACLES, QUERIES, query
from foliospark.sources.tables import table

__all__ = ["ORACLES", "QUERIES"]


@query("p7_found")
def p7_found(spark, d):
    return dewey.node_links(table(spark, d, "dump_pages"))


@query("p7_tables")
def p7_tables(spark, d):
    nodes = dewey.node_tables(table(spark, d, "dump_pages"))
    return nodes.select("rev_id", "node_no", "parent_no", "param_no", F.array_join(F.col("label").cast("array<string>"), ".").alias("label"), "path", "name")


@query("p7_sections")
def p7_sections(spark, d):
    nodes = dewey.path_table(dewey.node_tables(table(spark, d, "dump_pages")), "section")
    return nodes.select("rev_id", "node_no", "parent_no", F.size("label").alias("depth"), "name")


@query("p7_calls")
def p7_calls(spark, d):
    nodes = dewey.path_table(dewey.node_tables(table(spark, d, "dump_pages")), "call")
    return nodes.select("rev_id", "node_no", "parent_no", "param_no", "path", "name")
