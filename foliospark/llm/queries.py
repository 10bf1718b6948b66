"""Queries of the training-data operators."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from foliospark.llm import duplicates, leaks, markup, quality, residue, sentences, split, subjects, tokens
from foliospark.sources.tables import table


def p1_found(spark, d):
    return residue.residue_pages(table(spark, d, "dump_pages"))


def p1_templates(spark, d):
    return residue.residue_templates(table(spark, d, "dump_pages"))


def p2_found(spark, d):
    return split.oversized(table(spark, d, "dump_pages"))


def p2_pieces(spark, d):
    return split.split_pages(table(spark, d, "dump_pages"))


def p3_found(spark, d):
    return markup.structural_units(table(spark, d, "dump_pages"))


def p3_clean(spark, d):
    return markup.clean_pages(table(spark, d, "dump_pages"))


def p8_ids(spark, d):
    return tokens.token_ids(table(spark, d, "documents"))


def p8_decoded(spark, d):
    return tokens.decoded(tokens.token_ids(table(spark, d, "documents")))


def p9_found(spark, d):
    return leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_near(spark, d):
    return leaks.near_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p10_found(spark, d):
    return sentences.sentence_units(table(spark, d, "documents").where("form = 'prose'"))


def p10_units(spark, d):
    return sentences.sentence_units(table(spark, d, "documents"))


def p5_found(spark, d):
    return duplicates.similar_pairs(table(spark, d, "dump_pages"))


def p5_groups(spark, d):
    return duplicates.groups(table(spark, d, "dump_pages"))


def p6_found(spark, d):
    return quality.shapes(table(spark, d, "dump_pages"))


def p6_statistics(spark, d):
    return quality.outliers(quality.text_statistics(table(spark, d, "dump_pages")))


def p4_found(spark, d):
    return subjects.page_subjects(table(spark, d, "dump_pages"), table(spark, d, "page_labels"))


def p4_composition(spark, d):
    found = subjects.page_subjects(table(spark, d, "dump_pages"), table(spark, d, "page_labels"))
    return found.groupBy("subject").agg(F.count("*").alias("pages"))


QUERIES = {n: f for n, f in list(globals().items()) if re.match(r"p\d+_", n) and callable(f)}
_PLAIN = "replace(replace(replace(replace(replace(text, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&amp;', '&')"
_ITEM_WORDS = r"regexp_extract_all(regexp_replace(strip_accents(lower(text)), '[\p{Mn}\p{Me}\p{Cf}]', '', 'g'), '[\p{L}\p{N}]+')"


def _runs(key: str, source: str) -> str:
    return f"SELECT {key}, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(list_slice(w, i, i + 11), ' '))) AS run FROM (SELECT {key}, {_ITEM_WORDS} AS w FROM {source}) WHERE len(w) >= 12"


#: SQL twins, where SQL is quick enough on whole tables. p8_decoded: decoding undoes encoding, so the texts themselves are the result.
ORACLES: dict[str, str] = {
    "p2_found": r"SELECT rev_id, max(len(list_filter(regexp_extract_all(text, '[^\s\v\p{Z}.!?。！？]+'), lambda x: strlen(x) > 6000)))::INT AS unbroken FROM dump_pages WHERE strlen(text) > 6000 GROUP BY rev_id",
    "p5_found": rf"""
WITH words AS (SELECT rev_id, regexp_extract_all(lower({_PLAIN}), '[\p{{L}}\p{{N}}]+') AS w FROM (SELECT DISTINCT rev_id, text FROM dump_pages WHERE text IS NOT NULL)),
 s AS (SELECT DISTINCT rev_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM words WHERE len(w) >= 50),
 n AS (SELECT rev_id, count(*) AS n FROM s GROUP BY 1),
 c AS (SELECT a.rev_id AS a, b.rev_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.rev_id < b.rev_id GROUP BY 1, 2)
SELECT a AS rev_id_a, b AS rev_id_b FROM c JOIN n x ON x.rev_id = a JOIN n y ON y.rev_id = b WHERE 10 * common >= 7 * (x.n + y.n - common)""",
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p9_found": f"SELECT DISTINCT doc_id, item_id FROM ({_runs('doc_id', 'documents')}) JOIN ({_runs('item_id', 'eval_items')}) USING (run)",
}
