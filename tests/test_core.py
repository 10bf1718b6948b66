"""Small cases of the core operators: the page format's quirks, nulls, ties, repeated rows and empty tables."""

import bz2
import random
import time

import pytest
from pyspark.sql import functions as F

from foliospark.functions import regexes, strings as S, vectors as V
from foliospark.operators import corpus, dewey, dictionary, documents, markup_trees, matrices, pages as P
from foliospark.sources import dumps, exports
from foliospark.streaming import pages as streams
from foliospark.wikitext import lexer, tree
from foliospark.wikitext.lexer import opaque_spans

TREE = [
    ("[[dog]]s bark", "<par><link><target>Dog</target><anchor>dogs</anchor></link> bark</par>"),
    ("[[a_b#C d|x]]", "<par><link><target>A b</target><tSection>C d</tSection><anchor>x</anchor></link></par>"),
    ("don't ''a", "<par>dont a</par>"),
    ("don't", "<par>don't</par>"),
    ("'''''x'''''", "<par><b><i>x</i></b></par>"),
    ("{{a|b|c=d}}", '<par><template><target>a</target><param>b</param><param pn="c">d</param></template></par>'),
    ("{{Main }}", "<par><template><target>Main </target></template></par>"),
    ("{{{x}}}", "<par><curlyThree>x</curlyThree></par>"),
    ("{{{{x}}}}", ""),
    ("{x}", "<par>{x}</par>"),
    ("{|r|}", "<par><wTable>|r|</wTable></par>"),
    ("[[a", ""),
    ("[[a {{b]] c}}", ""),
    ("\n* a\n** b\nc", "<list><listEl> a</listEl><listEl> b</listEl></list><par>c</par>"),
    ("a\nb", "<par>ab</par>"),
    ("a\n\nb", "<par>a</par><par>b</par>"),
    ("[http://e.x y z]", "<par><extLink><target>http://e.x</target><anchor>y z</anchor></extLink></par>"),
    ("[[File:a.jpg|thumb|200px]]", "<par><file><target>File:A.jpg</target><param>thumb</param><param>200px</param><caption/></file></par>"),
    ("[[fr:X]] [[Wikt:x]] [[:Category:C]]", "<par><link><target>Fr:X</target><anchor>fr:X</anchor></link> <interwiki><target>Wikt:x</target><anchor>Wikt:x</anchor></interwiki> <link><target>Category:C</target><anchor>Category:C</anchor></link></par>"),
    ("<!-- a <!-- b --> c -->d", "<par>d</par>"),
    ("<!-- a", "<par>&lt;!-- a</par>"),
    ("a<ref>x</ref><br/>b", "<par>ab</par>"),
    ("", ""),
]


@pytest.mark.parametrize("text, want", TREE)
def test_trees(text, want):
    first = tree.parse(text).children[0]
    assert "".join(map(tree.xml, first.children)) == want


def test_sections_nest_by_level_and_fail_alone():
    errors = []
    root = tree.parse("\n== A ==\nt\n==== B ====\n[[\n=== C ===\nv", errors)
    a = root.children[1]
    assert [s.attrs["level"] for s in a.walk() if s.name == "section"] == ["2", "4", "3"]
    assert a.first("secContent").all("section")[0].first("secContent").children == [] and errors == [("section", "unmatched [")]


def test_deep_nesting_is_an_error_not_a_crash():
    errors = []
    tree.parse("{{a|" * 5000 + "}}" * 5000, errors)
    assert errors


def test_articles_are_pruned_and_files_go_last():
    root = tree.processed(tree.parse("* lead\n\nx [[File:a.jpg|left|Cap]] y {{foo}}{{main|Z}}\n\n== Notes ==\nz"))
    assert [c.name for c in root.children[0].children] == ["par", "par"] and len(root.children) == 1
    assert tree.document(root, "T", "article") == "\n\n#Article: T\n#Type: article\n\nx  y \n\n#Caption: Cap\n\n"
    assert tree.shortened(root).children[0].children[0].text() == "x  y"


def test_node_table_keeps_keys_and_drops_nulls(spark):
    df = spark.createDataFrame([(1, "[[a]]", 5), (1, "[[a]]", 6), (2, None, 7), (3, "", 8)], "k BIGINT, text STRING, node_id INT")
    t = documents.nodes(df, ["k"])
    assert sorted(r.k for r in documents.named(t, "link").collect()) == [1, 1] and t.where("k = 2").isEmpty()


@pytest.mark.parametrize("name", ["d.xml", "d.xml.bz2"])
def test_dumps_are_read_compressed_or_not(spark, tmp_path, name):
    page = "<page>\n<title>{}</title><ns>{}</ns><revision><text x='y'>{}</text></revision></page>\n"
    whole = "<mediawiki>\n" + page.format("A", 0, "x") + page.format("B", "", "#REDIRECT [[b_c#d]]") + "<page><title>no text</title><ns>q</ns><text/></page></mediawiki>\n"
    (tmp_path / name).write_bytes(bz2.compress(whole.encode()) if name.endswith("bz2") else whole.encode())
    got = {r.title: (r.ns, r.text) for r in P.records(dumps.read_dump(spark, str(tmp_path / name))).collect()}
    assert got == {"A": (0, "\nx"), "B": (-10, "\n#REDIRECT [[b_c#d]]"), "no text": (0, None)}
    with pytest.raises(ValueError):
        dumps.read_dump(spark, str(tmp_path / "d.zip"))


def test_pages_arrive_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xml").write_text("<m><page><title>A</title><ns>0</ns><text>x</text></page><page><title>B</title><ns>10</ns><text>y</text></page></m>")
    q = streams.count_types(streams.read_pages(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("types").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.page_type: r["count"] for r in spark.table("types").collect()} == {"article": 1, "other": 1}


def test_page_types(spark):
    rows = [("A", 0, "x"), ("A", 0, "see #redirect [[X#y]] there"), ("A", 0, "{{Disambig|x}}"), ("Template:Infobox a", 10, ""), ("template:infobox a", 10, ""), (None, None, None), ("A", 0, None)]
    df = spark.createDataFrame(rows, "title STRING, ns INT, text STRING").select(P.page_type(F.col("title"), F.col("ns"), F.col("text")).alias("t"), P.redirect_target(F.col("text")).alias("r"))
    got = df.collect()
    assert [r.t for r in got] == ["article", "redirect", "disambiguation", "template", "other", "other", "article"] and got[1].r == "Xy"


def test_redirect_circles_end(spark):
    rows = [("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("n", None), ("b", "c")]
    got = dict(map(tuple, P.redirect_chains(spark.createDataFrame(rows, "from_title STRING, to_title STRING")).collect()))
    assert got["A"] == got["B"] == "C" and "N" not in got and {got["X"], got["Y"]} <= {"X", "Y"}


def test_dictionaries(spark):
    w = spark.createDataFrame([("b", 0), ("a", 1), ("b", 2), (None, 3)], "w STRING, at INT")
    assert dict(map(tuple, dictionary.first_seen_ids(w, "w", "at").collect())) == {"b": 0, "a": 1}
    f = dictionary.frequencies(w, "w")
    assert dict(map(tuple, dictionary.merged(f, f, "w").collect())) == {"b": 4, "a": 2}
    none = w.limit(0)
    assert dictionary.first_seen_ids(none, "w", "at").isEmpty() and dictionary.without(f, none, "w").count() == 2


def test_word_functions(spark):
    df = spark.createDataFrame([(w,) for w in ("man", "axis", "city", "day", "box", "church", "basic", "noble", "happy", "big", "large", "")], "w STRING")
    w = F.col("w")
    got = {r[0]: tuple(r)[1:] for r in df.select("w", S.plural(w), S.adverb(w), S.comparative(w)).collect()}
    assert got["man"][0] == "men" and got["axis"][0] == "axes" and got["city"][0] == "cities" and got["day"][0] == "days" and got["church"][0] == "churches"
    assert got["basic"][1] == "basically" and got["noble"][1] == "nobly" and got["happy"][1:] == ("happily", "happier") and got["big"][2] == "bigger" and got["large"][2] == "larger"


def test_luhn_and_addresses(spark):
    df = spark.createDataFrame([("79927398713", "HTTPS://a.b/c#d"), ("79927398710", "a.b?c"), ("", ""), (None, None)], "n STRING, u STRING")
    got = df.select(S.luhn(F.col("n")), S.url_root(F.col("u"))).collect()
    assert [tuple(r) for r in got] == [(True, "a.b"), (False, "a.b"), (True, ""), (None, None)]


def test_arrays_of_no_elements(spark):
    df = spark.createDataFrame([([],), (None,)], "a ARRAY<DOUBLE>")
    a = F.col("a")
    got = df.select(V.mean(a), V.variance(a), V.cosine(a, a), V.entropy(a)).collect()
    assert tuple(got[0]) == (0.0, 0.0, 0.0, 0.0) and got[1][1] is None or got[1][0] is None


def test_regex_ranges():
    assert regexes.possible_range("ab[cd]") == ("ab", "ac") and regexes.possible_range("[a]")[0] == "" and regexes.literal_prefix("ab*c") == "a" and regexes.literal_prefix("a|b") == ""


def test_repair_counts_what_it_mends():
    clean, rows, warnings, errors = markup_trees.repair("<p>a<p>b<i>c</p></x><br><img a=1 a=2>&amp;&zz &")
    assert clean == '<p>a</p><p>b<i>c</i></p><br/><img a="1"/>&amp;&amp;zz &amp;' and (warnings, errors) == (3, 1)
    assert markup_trees.repair("")[0] == "" and rows[0]["parent_id"] == -1
    assert markup_trees.contrast("#ffffff", "#000000") == (255, 765)


def test_clusters_of_clear_groups(spark):
    points = [(i, [float(i % 3) * 10 + (i % 5) * 0.01, float(i % 3)]) for i in range(30)]
    df = spark.createDataFrame(points, "id BIGINT, vec ARRAY<DOUBLE>")
    got = dict(map(tuple, matrices.kmeans(df, 3).collect()))
    assert len(set(got.values())) == 3 and all(got[i] == got[i % 3] for i in range(30))
    parts = dict(map(tuple, matrices.principal_splits(df, 10).collect()))
    assert len(parts) == 30 and max(list(parts.values()).count(c) for c in parts.values()) <= 10


def test_nested_nodes_of_odd_pages(spark):
    rows = [(1, "== A ==\n{{x|{{y}}}}"), (1, "== A ==\n{{x|{{y}}}}"), (2, ""), (3, None), (None, "{{a}}"), (None, "{{a}}{{b|{{c}}}}")]
    df = spark.createDataFrame([(*r, "p", 3) for r in rows], "rev_id BIGINT, text STRING, path STRING, node_no INT")
    got = sorted(tuple(r) for r in dewey.node_links(df).where("rev_id IS NOT NULL").collect())
    assert got == [(1, 1, 0, 0), (1, 2, 1, 0), (1, 3, 2, 1)]
    assert dewey.node_links(df).where("rev_id IS NULL").count() == 4


@pytest.mark.parametrize("opener", ["<code>", "<pre>", "\\(", "<!--x", "\\begin{align}", "$$a", "```\n", "<math "])
def test_unclosed_openers_take_linear_time(opener):
    began = time.time()
    opaque_spans((opener + " x ") * 20_000)
    assert time.time() - began < 5


def test_scanner_equals_the_pattern():
    random.seed(1)
    bits = ["<code>", "</code>", "<pre>", "</pre >", "\\(", "\\)", "$", "$$", "`", "```\n", "\n```", "\n", "a", " ", "<nowiki/>", "<code x/>", "<math", ">", "\\begin{align}", "\\end{align}", "<!--", "-->", "1"]
    for _ in range(5000):
        text = "".join(random.choices(bits, k=random.randrange(1, 18)))
        assert [m.span() for m in lexer._opaque(text)] == [m.span() for m in lexer.OPAQUE.finditer(text)]


def test_corpus_is_written_and_read_again(spark, tmp_path):
    rows = [("A", 0, "'''A''' is [[b]].\n\n== H ==\nx"), ("List of x", 0, "* a"), ("R", 0, "#REDIRECT [[A]]"), ("D", 0, "{{dab}}"), ("T", 4, "talk"), ("B", 0, "[[broken"), ("N", 0, None)]
    records = spark.createDataFrame(rows, "title STRING, ns INT, text STRING")
    exports.write_corpus(exports.corpus(records, exports.ParseOptions()), str(tmp_path / "out"))
    lines = lambda name: sorted(r.value for r in exports.read_lines(spark, str(tmp_path / "out" / name)).collect())
    assert lines("titles") == ["A", "B"] and lines("redirects") == ["R\t\t-->\t\tA"]
    report = dict(r.rsplit("\t", 1) for r in lines("report"))
    assert report["pages\tarticle"] == "2" and report["errors\tsection: unmatched ["] == "1"
    exports.joined_xml(spark, str(tmp_path / "out"), str(tmp_path / "all.xml"))
    whole = (tmp_path / "all.xml").read_text()
    assert whole.startswith("<?xml") and whole.endswith("</pages>") and whole.count("<text>") == 2
    assert exports.page(spark, str(tmp_path / "out"), "A").head().plain.startswith("\n\n#Article: A\n#Type: article")


def test_options_and_tables_come_back(spark, tmp_path):
    path = str(tmp_path / "o.json")
    assert exports.ParseOptions.load(path) == exports.ParseOptions()
    exports.ParseOptions(captions=False, test_pages=3).save(path)
    assert exports.ParseOptions.load(path).test_pages == 3 and exports.estimated_output(110, True) == 400
    df = spark.createDataFrame([("a b", 1.5), ("c", None)], "k STRING, x DOUBLE")
    exports.write_tsv(df, str(tmp_path / "t"))
    assert sorted(map(tuple, exports.read_tsv(spark, str(tmp_path / "t"), "k STRING, x DOUBLE").collect())) == [("a b", 1.5), ("c", None)]
    (tmp_path / "crlf.txt").write_bytes(b"a\r\nb\r\n")
    assert [r.value for r in exports.read_lines(spark, str(tmp_path / "crlf.txt")).collect()] == ["a", "b"]
    assert exports.read_whole(spark, str(tmp_path / "crlf.txt")).head().content == b"a\r\nb\r\n"


def test_nouns_need_boundaries_and_a_link(spark):
    pages = spark.createDataFrame([(1, "The red house, a red housefly; red house"), (2, "red house"), (3, None)], "id BIGINT, text STRING")
    nouns = spark.createDataFrame([(1, "red house", 9), (1, "", 8), (3, "red house", 9)], "from_id BIGINT, noun STRING, page_id BIGINT")
    assert [tuple(r) for r in corpus.noun_index(pages, nouns).collect()] == [(1, "red house", 9, 2)]


def test_batches_of_long_texts_are_cut():
    import pyarrow as pa

    from foliospark.functions import arrow

    b = pa.RecordBatch.from_arrays([pa.array(["x" * (9 << 20)] * 5), pa.array(range(5))], ["t", "n"])
    parts = list(arrow.slices(b))
    assert [p.num_rows for p in parts] == [1] * 5 and [p.column("n")[0].as_py() for p in parts] == list(range(5))
    assert len(list(arrow.slices(b.slice(0, 0)))) == 0
