"""Deeply nested records to flat tables that keep parent-child links.

Every node of a page (headings, template calls) gets a Dewey label: the
ordinals of the path from the root, one per level. A parent's label is the
child's label without its last ordinal, so parent links need no join against
the source. The schema path (the kinds along the path) names the flat table a
node belongs to.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from foliospark.functions.arrow import map_rows
from foliospark.wikitext.lexer import calls, headings, masked, opaque_spans, unescape_once

NODE_TYPE = T.ArrayType(
    T.StructType(
        [
            T.StructField("node_no", T.IntegerType()),
            T.StructField("parent_no", T.IntegerType()),
            T.StructField("param_no", T.IntegerType()),
            T.StructField("label", T.ArrayType(T.IntegerType())),
            T.StructField("path", T.StringType()),
            T.StructField("name", T.StringType()),
        ]
    )
)


def dewey_labels(text: str) -> list[tuple[str, tuple[int, ...], int, str]]:
    """(schema path, Dewey label, param_no, name) of the nodes of one page, in document order.

    Labels: the root is (); children are numbered from 1 per parent.
    """
    mask = masked(text, opaque_spans(text))
    heads, found = headings(mask), calls(mask)
    if not heads and not found:
        return []
    marks = [(start, 0, level, end) for start, end, level in heads]
    marks += [(c[0], 1, i, c[1]) for i, c in enumerate(found)]
    marks.sort()
    children: dict[tuple[int, ...], int] = {}
    open_heads: list[tuple[int, tuple[int, ...], str]] = []
    call_label: list[tuple[tuple[int, ...], str]] = [((), "")] * len(found)
    out = []
    for start, is_call, ref, end in marks:
        if is_call:
            _, _, parent, param = found[ref]
            above, path = call_label[parent] if parent >= 0 else (open_heads[-1][1:] if open_heads else ((), ""))
            path += "/call"
            inner = text[start + 2 : end - 2]
            name = inner[: inner.find("|")] if "|" in inner else inner
        else:
            while open_heads and open_heads[-1][0] >= ref:
                open_heads.pop()
            above, path = open_heads[-1][1:] if open_heads else ((), "")
            path += "/section"
            param = 0
            name = text[start:end].strip("= \t")
        ordinal = children[above] = children.get(above, 0) + 1
        label = (*above, ordinal)
        if is_call:
            call_label[ref] = (label, path)
        else:
            open_heads.append((ref, label, path))
        out.append((path, label, param if is_call and found[ref][2] >= 0 else 0, name.strip()))
    return out


def flat_links(text: str) -> list[tuple[int, int, int]]:
    """(node_no, parent_no, param_no): the parent is found by truncating the Dewey label."""
    labelled = dewey_labels(text)
    number = {label: n for n, (_, label, _, _) in enumerate(labelled, 1)}
    number[()] = 0
    return [(number[label], number[label[:-1]], param) for _, label, param, _ in labelled]


def _rows(text: str | None) -> list[dict]:
    if not text:
        return []
    labelled = dewey_labels(unescape_once(text))
    number = {label: n for n, (_, label, _, _) in enumerate(labelled, 1)}
    number[()] = 0
    return [
        {"node_no": number[label], "parent_no": number[label[:-1]], "param_no": param, "label": list(label), "path": path, "name": name}
        for path, label, param, name in labelled
    ]


def _links_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    nodes, parents, params = [], [], []
    for text in batch.column("text").to_pylist():
        links = flat_links(unescape_once(text)) if text else ()
        nodes.append(len(links))
        parents.append([p for _, p, _ in links])
        params.append([p for _, _, p in links])
    return pa.RecordBatch.from_arrays(
        [batch.column("rev_id"), batch.column("unnamed"), pa.array(parents, pa.list_(pa.int32())), pa.array(params, pa.list_(pa.int32()))],
        ["rev_id", "unnamed", "parents", "params"],
    )


def _texts(pages: DataFrame) -> DataFrame:
    """rev_id, unnamed (a text hash where rev_id is null, so that such pages stay apart), text."""
    unnamed = F.when(F.col("rev_id").isNull(), F.xxhash64("text"))
    return pages.where(F.length("text") > 0).select(F.col("rev_id").cast("long").alias("rev_id"), unnamed.alias("unnamed"), "text")


def node_links(pages: DataFrame) -> DataFrame:
    """rev_id, node_no, parent_no, param_no of every node of every page revision.

    `pages` needs rev_id and text (escaped wikitext). Null and empty texts have
    no nodes; pages with a null rev_id keep it, one set of nodes per distinct
    text. A revision that occurs twice
    counts once (of differing copies the one with the smallest node arrays);
    other columns are ignored. The only shuffle is of node arrays, by rev_id.
    """
    links = map_rows(_texts(pages), _links_batch, "rev_id BIGINT, unnamed BIGINT, parents ARRAY<INT>, params ARRAY<INT>")
    once = links.where(F.size("parents") > 0).groupBy("rev_id", "unnamed").agg(F.min(F.struct("parents", "params")).alias("n"))
    return once.select("rev_id", F.posexplode(F.arrays_zip("n.parents", "n.params")).alias("at", "x")).select(
        "rev_id", (F.col("at") + 1).alias("node_no"), F.col("x.parents").alias("parent_no"), F.col("x.params").alias("param_no")
    )


def node_tables(pages: DataFrame) -> DataFrame:
    """All nodes with label, schema path (the flat table they belong to) and name.

    One row per node; filter on `path` to get one flat table. Defined as in
    `node_links` for nulls, empty texts and repeated revisions.
    """

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = [_rows(t) for t in b.column("text").to_pylist()]
        kind = pa.list_(
            pa.struct(
                [
                    ("node_no", pa.int32()),
                    ("parent_no", pa.int32()),
                    ("param_no", pa.int32()),
                    ("label", pa.list_(pa.int32())),
                    ("path", pa.string()),
                    ("name", pa.string()),
                ]
            )
        )
        return pa.RecordBatch.from_arrays([b.column("rev_id"), b.column("unnamed"), pa.array(rows, kind)], ["rev_id", "unnamed", "nodes"])

    schema = T.StructType([T.StructField("rev_id", T.LongType()), T.StructField("unnamed", T.LongType()), T.StructField("nodes", NODE_TYPE)])
    nodes = map_rows(_texts(pages), batch, schema)
    once = nodes.where(F.size("nodes") > 0).groupBy("rev_id", "unnamed").agg(F.min("nodes").alias("nodes"))
    return once.select("rev_id", F.inline("nodes"))


def path_table(nodes: DataFrame, kind: str) -> DataFrame:
    """The flat table of one kind of node (section or call), whatever its schema path; parent_no links it to the table of the parent."""
    return nodes.where(F.col("path").endswith(f"/{kind}"))
