"""Queries of regular expressions, XPath, XML and HTML operators with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.functions import regexes as R
from foliospark.operators import documents as D, markup_trees as M
from foliospark.plans.registry import columns, query
from foliospark.sources.tables import table


def X():
    return F.col("text")


def N():
    return F.col("p_name")


def B():
    return F.col("p_brand")


def H():
    return F.col("html")


columns("regex_full_match", "part", ["p_partkey"], {"ok": (lambda: R.full(B(), r"Brand#[1-9]\d?"), "regexp_full_match(p_brand, 'Brand#[1-9]\\d?')"), "part": (lambda: R.partial(B(), "#1"), "regexp_matches(p_brand, '#1')")})
columns("regex_consume", "part", ["p_partkey"], {"rest": (lambda: R.consumed(B(), r"Brand#\d"), "CASE WHEN regexp_matches(p_brand, '^Brand#\\d') THEN substr(p_brand, length(regexp_extract(p_brand, '^Brand#\\d')) + 1) END")})
columns("regex_extract_all", "documents", ["doc_id"], {"years": (lambda: R.found(X(), r"1[0-9]{3}"), "regexp_extract_all(text, '1[0-9]{3}')"), "n": (lambda: R.count(X(), r"1[0-9]{3}"), "len(regexp_extract_all(text, '1[0-9]{3}'))")})
columns("regex_replace_first", "dump_pages", ["rev_id"], {"x": (lambda: R.replace_first(X(), "(the|a) ([a-z]+)", "<$2>"), "regexp_replace(text, '(the|a) ([a-z]+)', '<\\2>')")})
columns("regex_global_replace", "dump_pages", ["rev_id"], {"x": (lambda: R.replace_all(X(), "(the|a) ([a-z]+)", "<$2>"), "regexp_replace(text, '(the|a) ([a-z]+)', '<\\2>', 'g')"), "n": (lambda: R.count(X(), "(the|a) ([a-z]+)"), "len(regexp_extract_all(text, '(the|a) ([a-z]+)'))")})
columns("regex_rewrite", "documents", ["doc_id"], {"x": (lambda: R.extracted(X(), r"in ([0-9]{4}) ([a-z]+)", [2, ":", 1]), "CASE WHEN regexp_matches(text, 'in ([0-9]{4}) ([a-z]+)') THEN regexp_extract(text, 'in ([0-9]{4}) ([a-z]+)', 2) || ':' || regexp_extract(text, 'in ([0-9]{4}) ([a-z]+)', 1) END")})
columns("regex_quote", "dump_pages", ["rev_id"], {"q": (lambda: R.quoted(F.col("title")), "regexp_replace(title, '([^A-Za-z0-9_])', '\\\\\\1', 'g')")})
def _typed():
    return R.typed(F.concat(F.lit("n="), F.col("p_size"), F.lit(" x="), F.hex("p_partkey"), F.lit(" f="), F.col("p_size"), F.lit(".5")), r"n=(\d+) x=([0-9A-F]+) f=([0-9.]+)", ["int", "hex", "float"])
columns("regex_typed", "part", ["p_partkey"], {"i": (lambda: _typed()[0], "p_size::BIGINT"), "h": (lambda: _typed()[1], "p_partkey"), "f": (lambda: _typed()[2], "p_size + 0.5::DOUBLE")})
_PATTERNS = [r"\bmoved\b", r"[0-9]{4}", r"(?i)the", "xyzzy"]
columns("regex_set_match", "documents", ["doc_id"], {"ids": (lambda: R.matching_set(X(), _PATTERNS), "list_filter([CASE WHEN regexp_matches(text, '\\bmoved\\b') THEN 0 END, CASE WHEN regexp_matches(text, '[0-9]{4}') THEN 1 END, CASE WHEN regexp_matches(text, '(?i)the') THEN 2 END, CASE WHEN regexp_matches(text, 'xyzzy') THEN 3 END], lambda x: x IS NOT NULL)")}, where="text IS NOT NULL")
columns("regex_filtered_set", "documents", ["doc_id"], {"ids": (lambda: R.filtered_set(X(), [("moved", r"\bmoved\b"), ("19", "19[0-9]{2}")]), "list_filter([CASE WHEN regexp_matches(text, '\\bmoved\\b') THEN 0 END, CASE WHEN regexp_matches(text, '19[0-9]{2}') THEN 1 END], lambda x: x IS NOT NULL)")}, where="text IS NOT NULL")


@query("regex_range", "SELECT p_partkey, p_brand FROM part WHERE regexp_matches(p_brand, '^Brand#1[0-9]')")
def regex_range(spark, d):
    return R.pruned(table(spark, d, "part"), "p_brand", "Brand#1[0-9]").select("p_partkey", "p_brand")


# ---------------------------------------------------------- XPath on XML strings

def _XML():
    return F.concat(F.lit('<p k="'), F.col("p_partkey").cast("string"), F.lit('"><name>'), N(), F.lit('</name><s u="cm">'), F.col("p_size").cast("string"), F.lit('</s><s u="in">2</s><t/></p>'))


def _xp(name, kind, path, sql):
    return {name: (lambda: F.expr(f"{kind}(xml, \"{path}\")"), sql)}


def _with_xml(df):
    return df.withColumn("xml", _XML())


columns("xpath_titles", "part", ["p_partkey"], {**_xp("name", "xpath_string", "p/name", "p_name"), **_xp("all", "xpath", "p/s/text()", "[p_size::VARCHAR, '2']")}, base=_with_xml)
columns("xpath_count", "part", ["p_partkey"], {**_xp("n", "xpath_int", "count(p/s)", "2"), **_xp("total", "xpath_double", "sum(p/s)", "p_size + 2.0::DOUBLE"), **_xp("last", "xpath_string", "p/s[last()]", "'2'"), **_xp("at", "xpath_int", "p/s[position()=2]", "2")}, base=_with_xml)
columns("xpath_attr_filter", "part", ["p_partkey"], {**_xp("cm", "xpath_int", "p/s[@u='cm']", "p_size"), **_xp("key", "xpath_long", "p/@k", "p_partkey"), **_xp("has", "xpath_boolean", "p/s[@u='in']", "TRUE"), **_xp("no", "xpath_boolean", "p/s[@u='ft']", "FALSE")}, base=_with_xml)
columns("xpath_axes", "part", ["p_partkey"], {**_xp("up", "xpath_string", "//s[1]/parent::p/name", "p_name"), **_xp("down", "xpath_int", "count(p/descendant::*)", "4"), **_xp("after", "xpath_int", "count(p/name/following-sibling::*)", "3"), **_xp("before", "xpath_int", "count(p/t/preceding-sibling::s)", "2"), **_xp("self", "xpath_string", "name(p/s[1]/self::node())", "'s'"), **_xp("above", "xpath_int", "count(p/t/ancestor::*)", "1"), **_xp("both", "xpath_int", "count(p/name | p/t)", "2")}, base=_with_xml)
columns("xpath_functions", "part", ["p_partkey"], {**_xp("cat", "xpath_string", "concat(p/name, '-', p/s[2])", "p_name || '-2'"), **_xp("starts", "xpath_boolean", "starts-with(p/name, 'p')", "starts_with(p_name, 'p')"), **_xp("holds", "xpath_boolean", "contains(p/name, '1')", "contains(p_name, '1')"), **_xp("before", "xpath_string", "substring-before(p/name, ' ')", "CASE WHEN contains(p_name, ' ') THEN split_part(p_name, ' ', 1) ELSE '' END"), **_xp("sub", "xpath_string", "substring(p/name, 2, 3)", "substr(p_name, 2, 3)"), **_xp("len", "xpath_int", "string-length(p/name)", "length(p_name)"), **_xp("tr", "xpath_string", "translate(p/name, 'abc', 'ABC')", "translate(p_name, 'abc', 'ABC')"), **_xp("norm", "xpath_string", "normalize-space(concat('  ', p/name, '  '))", "p_name")}, base=_with_xml)
columns("xpath_numbers", "part", ["p_partkey"], {**_xp("half", "xpath_double", "p/s[1] div 2", "p_size / 2.0"), **_xp("mod", "xpath_int", "p/s[1] mod 3", "p_size % 3"), **_xp("fl", "xpath_int", "floor(p/s[1] div 2)", "p_size // 2"), **_xp("ce", "xpath_int", "ceiling(p/s[1] div 2)", "(p_size + 1) // 2"), **_xp("ro", "xpath_int", "round(-2.5)", "-2"), **_xp("cmp", "xpath_boolean", "p/s[1] > 20 and not(p/s[1] = 30) or false()", "p_size > 20 AND p_size <> 30")}, base=_with_xml)


def _tree(spark, d):
    return M.repaired(_with_xml(table(spark, d, "part")), ["p_partkey"], "xml").select("p_partkey", F.inline("nodes"))


@query("xml_nodes_by_name", "SELECT p_partkey, unnest(['cm', 'in']) AS unit FROM part")
def xml_nodes_by_name(spark, d):
    return D.named(_tree(spark, d), "s").select("p_partkey", F.element_at("attrs", "u").alias("unit"))


@query("xml_first_child", "SELECT p_partkey, p_name AS value FROM part")
def xml_first_child(spark, d):
    return D.child_texts(_tree(spark, d), "p", "name", ["p_partkey"], "value").select("p_partkey", "value")


@query("xml_remove_by_name", "SELECT p_partkey, unnest(['p', 'name', 't']) AS name FROM part")
def xml_remove_by_name(spark, d):
    t = D.without_subtrees(_tree(spark, d), ["p_partkey"], F.col("name") == "s")
    return t.where("name <> '#text'").select("p_partkey", "name")


@query("xml_find_by_value", "SELECT p_partkey FROM part WHERE p_size = 7")
def xml_find_by_value(spark, d):
    v = D.child_texts(_tree(spark, d), "p", "s", ["p_partkey"], "value")
    return v.where("value = '7'").select("p_partkey").distinct()


@query("xml_paths", "SELECT p_partkey, unnest(['/p', '/p/name', '/p/s', '/p/s', '/p/t']) AS path FROM part")
def xml_paths(spark, d):
    return _tree(spark, d).where("name <> '#text'").select("p_partkey", "path")


# ---------------------------------------------------------- HTML

def _HTML():
    return F.concat(
        F.lit("<html><head><title>"), N(), F.lit('</title><style>b{}</style></head><body><!-- c --><h1>'), B(), F.lit("</h1><p>one <b>two<p>three<ul><li>"), F.col("p_type"), F.lit('<li>x</ul><h3>low</h3><a href="/p/'), F.col("p_partkey").cast("string"),
    F.lit('">more</a><img src="a.png"><img src="b.png" alt="b"><center>c</center></body></html>'),
)


def _with_html(df):
    return df.withColumn("html", _HTML())


columns("html_title", "part", ["p_partkey"], {"t": (lambda: M.title(H()), "p_name")}, base=_with_html)
columns("html_links", "part", ["p_partkey"], {"hrefs": (lambda: M.links(H()), "['/p/' || p_partkey]")}, base=_with_html)
columns("html_comment_strip", "part", ["p_partkey"], {"n": (lambda: F.length(H()) - F.length(M.without_comments(H())), "10")}, base=_with_html)
columns("html_text", "part", ["p_partkey"], {"t": (lambda: M.text(H()), "p_name || ' ' || p_brand || ' one two three ' || p_type || ' x low more c'")}, base=_with_html)
columns("html_typography", "documents", ["doc_id"], {"t": (lambda: M.plain_typography(X()), "translate(text, '“”„‘’–—' || chr(160), '\"\"\"''''-- ')")})
columns("heading_nesting_audit", "part", ["p_partkey"], {"n": (lambda: M.skipped_headings(H()), "1")}, base=_with_html)
columns("img_alt_audit", "part", ["p_partkey"], {"n": (lambda: M.tag_count(H(), "img", lacking="alt"), "1"), "ok": (lambda: M.tag_count(H(), "img", having="alt"), "1")}, base=_with_html)


@query("html_audit", "SELECT p_partkey, 1 AS img_no_alt, 0 AS area_no_alt, 0 AS table_no_summary, 1 AS html_no_lang, 0 AS input_no_id, 0 AS frame_no_title, 0 AS scripts, 0 AS anchor_no_href, 1 AS deprecated, 1 AS skipped_headings, TRUE AS no_doctype FROM part")
def html_audit(spark, d):
    return M.audit(_with_html(table(spark, d, "part")), ["p_partkey"])


@query("html_repair", "SELECT p_partkey, '<html><head><title>' || p_name || '</title><style>b{}</style></head><body><h1>' || p_brand || '</h1><p>one <b>two</b></p><p>three</p><ul><li>' || p_type || '</li><li>x</li></ul><h3>low</h3><a href=\"/p/' || p_partkey || '\">more</a><img src=\"a.png\"/><img src=\"b.png\" alt=\"b\"/><div>c</div></body></html>' AS clean, 4 AS warnings, 0 AS errors FROM part")
def html_repair(spark, d):
    return M.repaired(_with_html(table(spark, d, "part")), ["p_partkey"]).select("p_partkey", "clean", "warnings", "errors")


@query("html_nodes", "SELECT p_partkey, unnest(['li', 'p', 'img', 'b']) AS name, unnest([2, 2, 2, 1]) AS n FROM part")
def html_nodes(spark, d):
    t = M.repaired(_with_html(table(spark, d, "part")), ["p_partkey"]).select("p_partkey", F.inline("nodes"))
    return D.named(t, "li", "p", "img", "b").groupBy("p_partkey", "name").agg(F.count("*").cast("int").alias("n"))


@query("xml_well_formed", "SELECT p_partkey, 0 AS warnings, CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS errors FROM part")
def xml_well_formed(spark, d):
    """The accept test of cleaned pages: no warning and no error."""
    p = table(spark, d, "part").withColumn("html", F.concat(F.lit("<a><c>x</c>"), F.when(F.col("p_size") > 25, "</zz>").otherwise(""), F.lit("</a>")))
    return M.repaired(p, ["p_partkey"]).select("p_partkey", "warnings", "errors")
