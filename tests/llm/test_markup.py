from foliospark.llm import markup


def found(spark, *texts):
    pages = spark.createDataFrame(list(enumerate(texts, 1)), "rev_id BIGINT, text STRING")
    return sorted(tuple(r) for r in markup.structural_units(pages).collect())


def test_units_are_numbered_without_an_empty_one_at_the_end(spark):
    got = found(spark, "== A ==\n* b\n&lt;pre&gt;c&lt;/pre&gt;\n", "* only\n", "no unit", None, "")
    assert got == [(1, 1, "heading"), (1, 2, "item"), (1, 3, "code"), (2, 1, "item")]


def test_every_shape_of_a_host_enters_its_wrapper_at_any_size():
    for n in (1, 100, 10000):
        w = markup.induce({("h",): 70 * n, ("s", "h", "T"): 1})
        assert markup.accepts(w, "h") and markup.accepts(w, "shT")
    many = {("h", *"T" * n): 60 - n for n in range(60)}
    assert markup.accepts(markup.induce(many), "h" + "T" * 59)


def test_shared_shape_goes_to_the_host_that_shows_it_more_often(spark):
    w = markup.Wrappers({"markdown": {("h",): 99, ("(h)+",): 1}, "wiki": {("(h)+",): 90, ("h",): 10}})
    assert w.host("h") == "markdown" and w.host("hhh") == "wiki"
    pages = ["# Camiro\n\nSee [here](http://a.b).\n"] * 3 + ["[[a]]\n\n# b\n# c\n"] * 3 + ["# x\n# y\n"]
    assert found(spark, *pages)[-2:] == [(7, 1, "item"), (7, 2, "item")]


def test_calls_and_tables_keep_their_text_and_units():
    w = markup.Wrappers({})
    texts = {
        "* court {{nowrap|Camiro}} of {{convert|632|c}}": "[item] court Camiro of 632 c",
        "{{box|name = Velda\n| parts =\n* one\n* two {{small|three}}\n}}": None,
        "{| class=x\n|-\n! a !! b\n|-\n| c || d\n|}": "a  b\n c  d",
        "a <ref>see <math>x</math> there</ref> b": None,
    }
    for text, clean in texts.items():
        got = markup.clean(text, w)
        assert markup.re.findall(r"\[(heading|item|code|formula)\]", got) == [k for _, k in markup.units(text, w)]
        if clean:
            assert got.split() == clean.split(), got


def test_roles_come_from_the_pages_not_from_the_signs(spark):
    """Where a corpus uses a list sign as a heading, its wrapper says so."""
    usual = ["* a\n* b\n* c\n\ntext\n"] * 3
    single = ["* Title\n\ntext of it\n\n* Next\n\nmore text\n"] * 9
    assert {k for *_, k in found(spark, *usual)} == {"item"}
    assert {k for *_, k in found(spark, *single)} == {"heading"}


def test_repeated_and_single_markers_of_each_host():
    counts: dict = {}
    for text in ("<h2>A</h2>\n<p>x\n<ul>\n<li>a</li>\n<li>b</li>\n</ul>", "\\section{A}\n\nx\n\n\\begin{itemize}\n  \\item a\n  \\item b\n\\end{itemize}", "== A ==\nx\n\n* a\n** b", "# A\n\n**bold** x\n\n- a\n- b\n\n1. c\n2. d"):
        spans = markup.opaque_spans(text)
        mask = markup.masked(text, spans)
        for host, shape in markup.shapes(mask, markup.headings(mask)):
            counts.setdefault(host, {})[markup.fold(shape)] = 1
    role = markup.Wrappers(counts).role
    assert all(role[x] == "item" for x in "sLImn") and all(role[x] == "heading" for x in "eHS") and role["h markdown"] == "heading"
