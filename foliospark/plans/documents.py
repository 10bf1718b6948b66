"""Queries of the page parser: texts are built from table columns, so that the columns are the expected result."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.operators import documents as D
from foliospark.plans.registry import query
from foliospark.sources.tables import table


def _text(df, *parts):
    return df.withColumn("text", F.concat(*(F.lit(p[1:]) if p.startswith("=") else F.col(p) for p in parts)))


def _nations(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"])


def _links(spark, d, parts, source=None, key="n_nationkey", kind="link"):
    t = D.nodes(_text(source if source is not None else _nations(spark, d), *parts), [key], article=False)
    target, anchor = (D.child_texts(t, kind, c, [key], c).select(key, "parent_id", c) for c in ("target", "anchor"))
    return target.join(anchor, [key, "parent_id"]).drop("parent_id")


@query("parse_link", "SELECT n_nationkey, upper(left(r_name, 1)) || substr(r_name, 2) AS target, n_name || 's' AS anchor FROM nation JOIN region ON n_regionkey = r_regionkey")
def parse_link(spark, d):
    return _links(spark, d, ("=In [[", "r_name", "=|", "n_name", "=]]s now."))


@query("parse_external_link", "SELECT c_custkey, 'http://x.example/' || c_custkey AS target, c_name AS anchor FROM customer")
def parse_external_link(spark, d):
    c = table(spark, d, "customer").withColumn("k", F.col("c_custkey").cast("string"))
    return _links(spark, d, ("=[http://x.example/", "k", "= ", "c_name", "=]"), c, "c_custkey", "extLink")


@query("link_types", "SELECT n_nationkey, unnest(['category', 'file', 'interwiki', 'link', 'media']) AS kind, 1 AS n FROM nation")
def link_types(spark, d):
    n = _text(table(spark, d, "nation"), "=[[Category:", "n_name", "=]] [[Image:", "n_name", "=.png|left]] [[Wikt:", "n_name", "=|x]] [[:category:", "n_name", "=]] [[media:", "n_name", "=.ogg]]")
    t = D.named(D.nodes(n, ["n_nationkey"], article=False), "link", "file", "media", "category", "interwiki")
    return t.groupBy("n_nationkey", F.col("name").alias("kind")).agg(F.count("*").cast("int").alias("n"))


def _order_template(spark, d):
    return _text(table(spark, d, "orders"), "={{Infobox order|status=", "o_orderstatus", "=|priority=", "o_orderpriority", "=}}")


@query("template_params", "SELECT o_orderkey, o_orderstatus AS status, o_orderpriority AS priority FROM orders")
def template_params(spark, d):
    t = D.nodes(_order_template(spark, d), ["o_orderkey"])
    p = D.named(t, "param").select("o_orderkey", "node_id", F.element_at("attrs", "pn").alias("pn"))
    v = p.join(D.text_of(t, "param", ["o_orderkey"]), ["o_orderkey", "node_id"], "left")
    return v.groupBy("o_orderkey").agg(*(F.max(F.when(F.col("pn") == c, F.col("value"))).alias(c) for c in ("status", "priority")))


@query("template_target", "SELECT o_orderkey, 'Infobox order' AS target FROM orders")
def template_target(spark, d):
    t = D.nodes(_order_template(spark, d), ["o_orderkey"])
    return D.child_texts(t, "template", "target", ["o_orderkey"], "target").select("o_orderkey", "target")


def _sections(spark, d):
    docs = table(spark, d, "documents").where("lang IS NOT NULL AND source IS NOT NULL")
    return _text(docs, "=\n== ", "lang", "= ==\nx\n=== ", "source", "= ===\ny")


@query("section_split", "SELECT doc_id, lang AS title, 2 AS level FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL UNION ALL SELECT doc_id, source, 3 FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def section_split(spark, d):
    return D.section_parents(D.nodes(_sections(spark, d), ["doc_id"], article=False), ["doc_id"]).select("doc_id", "title", "level")


@query("section_tree_parent", "SELECT doc_id, source AS title, lang AS parent_title FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def section_tree_parent(spark, d):
    return D.section_parents(D.nodes(_sections(spark, d), ["doc_id"], article=False), ["doc_id"]).where("level = 3").select("doc_id", "title", "parent_title")


@query("list_elements", "SELECT p_partkey, p_brand AS element FROM part UNION ALL SELECT p_partkey, p_type FROM part")
def list_elements(spark, d):
    t = D.nodes(_text(table(spark, d, "part"), "=\n*", "p_brand", "=\n**", "p_type"), ["p_partkey"], article=False)
    return D.text_of(t, "listEl", ["p_partkey"], "element").select("p_partkey", "element")


@query("leading_lists", "SELECT p_partkey, p_type || ' ' AS flat FROM part")
def leading_lists(spark, d):
    """Lists before the first paragraph with text are left out of an article."""
    t = _text(table(spark, d, "part"), "=\n*", "p_brand", "=\n\n", "p_type")
    return D.parsed(t, ["p_partkey"]).select("p_partkey", "flat")


@query("paragraph_split", "SELECT p_partkey, p_name AS par FROM part UNION ALL SELECT p_partkey, p_brand || p_type FROM part")
def paragraph_split(spark, d):
    """A blank line parts paragraphs; a single line feed goes without a blank."""
    t = D.nodes(_text(table(spark, d, "part"), "p_name", "=\n\n", "p_brand", "=\n", "p_type"), ["p_partkey"])
    return D.text_of(t, "par", ["p_partkey"], "par").select("p_partkey", "par")


@query("bold_synonyms", "SELECT s_suppkey, s_name AS synonym FROM supplier")
def bold_synonyms(spark, d):
    t = D.nodes(_text(table(spark, d, "supplier"), "='''", "s_name", "=''' text"), ["s_suppkey"])
    hit = D.inside(t, ["s_suppkey"], "b", "firstPara").select("s_suppkey", "node_id")
    return hit.join(D.text_of(t, "b", ["s_suppkey"], "synonym"), ["s_suppkey", "node_id"]).select("s_suppkey", "synonym")


@query("bold_italic_odd", "SELECT s_suppkey, 'dont ' || s_name AS flat FROM supplier")
def bold_italic_odd(spark, d):
    """An odd set of apostrophe runs takes every apostrophe of the section away."""
    return D.parsed(_text(table(spark, d, "supplier"), "=don't ''", "s_name"), ["s_suppkey"]).select("s_suppkey", F.trim("flat").alias("flat"))


@query("unbalanced_discard", "SELECT s_suppkey, 'section' AS category, 'unmatched [' AS message FROM supplier")
def unbalanced_discard(spark, d):
    return D.parsed(_text(table(spark, d, "supplier"), "=[[", "s_name"), ["s_suppkey"]).select("s_suppkey", F.inline("errors"))


def _files(spark, d, parts, key="p_partkey", source="part"):
    df = table(spark, d, source).withColumn("k", F.col(key).cast("string"))
    t = D.nodes(_text(df, *parts), [key])
    target, caption = (D.child_texts(t, "file", c, [key], c).select(key, "parent_id", c) for c in ("target", "caption"))
    return target.join(caption, [key, "parent_id"]).drop("parent_id")


@query("file_captions", "SELECT p_partkey, 'File:' || p_partkey || '.jpg' AS target, p_name AS caption FROM part")
def file_captions(spark, d):
    return _files(spark, d, ("=[[File:", "k", "=.jpg|thumb|", "p_name", "=]]"))


@query("infobox_image", "SELECT p_partkey, 'File:' || p_partkey || '.jpg' AS target, p_name AS caption FROM part")
def infobox_image(spark, d):
    return _files(spark, d, ("={{Infobox part|name=", "p_brand", "=|image=", "k", "=.jpg|caption=", "p_name", "=}}"))


@query("gallery_files", "SELECT p_partkey, 'File:' || p_partkey || '.jpg' AS target, p_name AS caption FROM part UNION ALL SELECT p_partkey, 'File:' || p_partkey || '.png', p_type FROM part")
def gallery_files(spark, d):
    return _files(spark, d, ("=<gallery>\nFile:", "k", "=.jpg|", "p_name", "=\nImage:", "k", "=.png|", "p_type", "=\n</gallery>"))


@query("multiple_image", "SELECT p_partkey, 'File:' || p_partkey || '.jpg' AS target, p_name AS caption FROM part UNION ALL SELECT p_partkey, 'File:' || p_partkey || '.png', '' FROM part")
def multiple_image(spark, d):
    return _files(spark, d, ("={{multiple image|image1=", "k", "=.jpg|caption1=", "p_name", "=|image2=", "k", "=.png}}"))


@query("double_image", "SELECT p_partkey, 'File:' || p_partkey || '.jpg' AS target, p_name AS caption FROM part UNION ALL SELECT p_partkey, 'File:' || p_partkey || '.png', p_type FROM part")
def double_image(spark, d):
    return _files(spark, d, ("={{double image|left|", "k", "=.jpg|10|", "k", "=.png|20|", "p_name", "=|", "p_type", "=}}"))


def _flat(spark, d, parts, source="part", key="p_partkey", alias="flat"):
    return D.parsed(_text(table(spark, d, source).withColumn("k", F.col(key).cast("string")), *parts), [key]).select(key, F.trim("flat").alias(alias))


@query("quote_templates", "SELECT p_partkey, unnest([p_name || ' ' || p_brand, p_name || ' ' || p_brand, p_name || ' ' || p_brand, p_name || ' ' || p_brand, p_name || ' ' || p_brand, p_name || ' ' || p_brand]) AS flat FROM part")
def quote_templates(spark, d):
    shapes = (("={{quote|", "p_name", "=|", "p_brand", "=}}"), ("={{quotation|1=", "p_name", "=|2=", "p_brand", "=}}"), ("={{rquote|left|", "p_name", "=|", "p_brand", "=}}"), ("={{bq|text=", "p_name", "=|author=", "p_brand", "=}}"), ("={{centered pull quote|", "p_name", "=|author=", "p_brand", "=}}"), ("={{quote box|quote=", "p_name", "=|source=", "p_brand", "=}}"))
    out = None
    for s in shapes:
        q = _flat(spark, d, s)
        out = q if out is None else out.unionByName(q)
    return out


@query("convert_templates", "SELECT p_partkey, p_size || ' km' AS flat FROM part")
def convert_templates(spark, d):
    p = table(spark, d, "part").withColumn("size", F.col("p_size").cast("string"))
    return D.parsed(_text(p, "={{convert|", "size", "=|km|mi}}"), ["p_partkey"]).select("p_partkey", F.trim("flat").alias("flat"))


@query("plain_templates", "SELECT p_partkey, p_name || p_brand || p_type || ' (' || p_name || ')' AS flat FROM part")
def plain_templates(spark, d):
    return _flat(spark, d, ("={{nowrap|", "p_name", "=}}{{lang-de|", "p_brand", "=}}{{nihongo|", "p_type", "=|x|", "p_name", "=}}"))


_PAGE = ("='''", "p_name", "=''' is [[part|", "p_brand", "=]].\n\n== About ==\nSee ", "p_type", "=.{{citation needed}}\n* ", "k", "=\n\n== References ==\nnone")


@query("plain_text_render", "SELECT p_partkey, chr(10) || chr(10) || '#Article: ' || p_name || chr(10) || '#Type: article' || chr(10) || chr(10) || p_name || ' is ' || p_brand || '.' || chr(10) || chr(10) || '#Subtitle level 2: About' || chr(10) || chr(10) || 'See ' || p_type || '.' || chr(10) || chr(10) || chr(9) || ' ' || p_partkey || chr(10) || chr(10) AS plain FROM part")
def plain_text_render(spark, d):
    p = table(spark, d, "part").withColumns({"k": F.col("p_partkey").cast("string"), "title": F.col("p_name"), "page_type": F.lit("article")})
    return D.parsed(_text(p, *_PAGE), ["p_partkey"]).select("p_partkey", "plain")


@query("flat_text_render", "SELECT p_partkey, p_name || ' is ' || p_brand || '. About See ' || p_type || '.  ' || p_partkey AS flat FROM part")
def flat_text_render(spark, d):
    return _flat(spark, d, _PAGE)


@query("pruned_sections", "SELECT p_partkey, 'About' AS title FROM part")
def pruned_sections(spark, d):
    p = table(spark, d, "part").withColumn("k", F.col("p_partkey").cast("string"))
    return D.section_parents(D.nodes(_text(p, *_PAGE), ["p_partkey"]), ["p_partkey"]).select("p_partkey", "title")


@query("node_count_by_name", "SELECT unnest(['b', 'link', 'template', 'section', 'listEl', 'wTable', 'curlyThree']) AS name, unnest([1, 1, 1, 2, 1, 1, 1]) * (SELECT count(*) FROM part) AS n")
def node_count_by_name(spark, d):
    p = table(spark, d, "part").withColumn("k", F.col("p_partkey").cast("string"))
    t = D.nodes(_text(p, *_PAGE, "=\n{|a|}{{{x}}}"), ["p_partkey"], article=False)
    return D.named(t, "b", "link", "template", "section", "listEl", "wTable", "curlyThree").groupBy("name").agg(F.count("*").alias("n"))


@query("subtree_removal", "SELECT p_partkey, count(*) AS n FROM (SELECT p_partkey, unnest([1, 2, 3, 4, 5]) FROM part) GROUP BY 1")
def subtree_removal(spark, d):
    """text, firstPara, par and the two text runs around a removed link."""
    t = D.nodes(_text(table(spark, d, "part"), "=a [[", "p_name", "=|b]] c"), ["p_partkey"])
    return D.without_subtrees(t, ["p_partkey"], F.col("name") == "link").groupBy("p_partkey").agg(F.count("*").alias("n"))


@query("page_trees", None)
def page_trees(spark, d):
    """rev_id, page trees as XML and their plain text, of all articles."""
    from foliospark.operators import pages as P

    p = table(spark, d, "dump_pages").withColumn("page_type", P.page_type(F.col("title"), F.col("ns"), F.col("text"))).where("page_type IN ('article', 'disambiguation')")
    plain = F.col("text")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(a), F.lit(b))
    return D.parsed(p.withColumn("text", plain), ["rev_id"], want=("xml", "plain", "errors")).select("rev_id", "xml", "plain", F.size("errors").alias("n_errors"))
