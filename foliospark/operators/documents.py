"""Pages as node tables and rendered texts: one Arrow stage parses, Catalyst does the rest."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from foliospark.functions.arrow import slices, spread
from foliospark.wikitext import tree

NODE = "struct<node_id:int,parent_id:int,depth:int,name:string,text:string,attrs:map<string,string>,subtree_end:int,path:string,value:string>"
_NODE_ARROW = pa.list_(
    pa.struct([("node_id", pa.int32()), ("parent_id", pa.int32()), ("depth", pa.int32()), ("name", pa.string()), ("text", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("subtree_end", pa.int32()), ("path", pa.string()), ("value", pa.string())])
)


#: Nodes whose whole text is kept beside them; the larger ones would repeat the page once per level.
VALUED = frozenset(("target", "tSection", "anchor", "param", "caption", "secTitle", "par", "listEl", "b", "i", "curlyThree"))


def node_rows(root: tree.Node) -> list[dict]:
    """Nodes in document order; text runs are nodes named #text. A subtree is [node_id, subtree_end)."""
    rows: list[dict] = []

    def add(node, parent: int, depth: int, path: str) -> None:
        at = len(rows)
        is_text = isinstance(node, str)
        name = "#text" if is_text else node.name
        path = f"{path}/{name}"
        value = node.text() if name in VALUED else None
        rows.append({"node_id": at, "parent_id": parent, "depth": depth, "name": name, "text": node if is_text else None, "attrs": [] if is_text else sorted(node.attrs.items()), "subtree_end": 0, "path": path, "value": value})
        if not is_text:
            for c in node.children:
                add(c, at, depth + 1, path)
        rows[at]["subtree_end"] = len(rows)

    add(root, -1, 0, "")
    return rows


PARTS = ("nodes", "xml", "plain", "flat", "errors")


def parsed(pages: DataFrame, keys: list[str], article: bool = True, want: tuple[str, ...] = PARTS) -> DataFrame:
    """keys and nodes, xml, plain, flat, errors (those of them in `want`) of every row with a text.

    `pages` has the keys, text (unescaped) and, for `plain`, title and
    page_type if they are there. Null texts give no row. With `article` the
    tree is pruned as for the corpus, else it stays whole. A section that
    cannot be read is left out and named in errors. No shuffle.
    """
    has = {c: c in pages.columns for c in ("title", "page_type")}
    picked = pages.where("text IS NOT NULL").select(*keys, "text", *(F.coalesce(F.col(c), F.lit("")).alias(f"_{c}") if has[c] else F.lit("").alias(f"_{c}") for c in has))
    fields = {f.name: f for f in picked.schema.fields}
    schema = ", ".join(f"`{k}` {fields[k].dataType.simpleString()}" for k in keys)
    kinds = {"nodes": f"array<{NODE}>", "errors": "array<struct<category:string,message:string>>"}
    schema += "".join(f", {w} {kinds.get(w, 'string')}" for w in want)
    arrow = {"nodes": _NODE_ARROW, "errors": pa.list_(pa.struct([("category", pa.string()), ("message", pa.string())]))}

    def run(batches):
        for b in (part for whole in batches for part in slices(whole)):
            out: dict[str, list] = {w: [] for w in want}
            for text, title, kind in zip(*(b.column(c).to_pylist() for c in ("text", "_title", "_page_type"))):
                found: list = []
                root = tree.parse(text, found)
                if article:
                    root = tree.processed(root)
                for w in want:
                    if w == "nodes":
                        out[w].append(node_rows(root))
                    elif w == "xml":
                        out[w].append(tree.xml(root))
                    elif w == "plain":
                        out[w].append(tree.document(root, title, kind))
                    elif w == "flat":
                        out[w].append(tree.flat(root))
                    else:
                        out[w].append([{"category": c, "message": m} for c, m in found])
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), *(pa.array(out[w], arrow.get(w, pa.string())) for w in want)], [*keys, *want])

    return spread(picked).mapInArrow(run, schema)


def nodes(pages: DataFrame, keys: list[str], article: bool = True) -> DataFrame:
    """keys and one row per node."""
    return parsed(pages, keys, article, ("nodes",)).select(*keys, F.inline("nodes"))


# ---------------------------------------------------------- node-table operators


def named(table: DataFrame, *names: str) -> DataFrame:
    return table.where(F.col("name").isin(*names))


def text_of(table: DataFrame, name: str, keys: list[str], alias: str = "value") -> DataFrame:
    """keys, node_id, value: the text below each node of a name (one of those that keep their text)."""
    return named(table, name).select(*keys, "node_id", F.coalesce("value", F.lit("")).alias(alias))


def child_texts(table: DataFrame, parent: str, child: str, keys: list[str], alias: str) -> DataFrame:
    """keys, parent_id, node_id, value: the text of each child of a name under parents of a name. One equi-join on the parent's id."""
    kids = named(table, child).select(*keys, "node_id", "parent_id", F.coalesce("value", F.lit("")).alias(alias))
    parents = named(table, parent).select(*keys, F.col("node_id").alias("parent_id"))
    return kids.join(parents, [*keys, "parent_id"], "left_semi").select(*keys, "parent_id", "node_id", alias)


def _reach(keys: list[str], condition: Column) -> Column:
    """How far the subtrees reach of the earlier nodes of a page that a condition names."""
    earlier = Window.partitionBy(*keys).orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
    return F.max(F.when(condition, F.col("subtree_end"))).over(earlier)


def without_subtrees(table: DataFrame, keys: list[str], doomed: Column) -> DataFrame:
    """The nodes outside the subtrees of those that a condition names: one running maximum per page, no pairs."""
    marked = table.withColumn("_doomed", F.coalesce(doomed, F.lit(False)))
    reach = marked.withColumn("_reach", F.coalesce(_reach(keys, F.col("_doomed")), F.lit(0)))
    return reach.where("NOT _doomed AND node_id >= _reach").drop("_doomed", "_reach")


def inside(table: DataFrame, keys: list[str], name: str, within: str) -> DataFrame:
    """Nodes of one name in the subtree of nodes of another: one running maximum per page."""
    reach = table.withColumn("_reach", _reach(keys, F.col("name") == within))
    return reach.where((F.col("name") == name) & (F.col("node_id") < F.col("_reach"))).drop("_reach")


def section_parents(table: DataFrame, keys: list[str]) -> DataFrame:
    """keys, node_id, level, title, parent_title of each section; null for those at the top. A section lies in the content of its parent."""
    s = named(table, "section").select(*keys, "node_id", "parent_id", F.element_at("attrs", "level").cast("int").alias("level"))
    titles = child_texts(table, "section", "secTitle", keys, "title").select(*keys, F.col("parent_id").alias("node_id"), "title")
    full = s.join(titles, [*keys, "node_id"])
    content = named(table, "secContent").select(*keys, F.col("node_id").alias("parent_id"), F.col("parent_id").alias("_above"))
    above = titles.select(*keys, F.col("node_id").alias("_above"), F.col("title").alias("parent_title"))
    return full.join(content, [*keys, "parent_id"], "left").join(above, [*keys, "_above"], "left").select(*keys, "level", "title", "parent_title")
