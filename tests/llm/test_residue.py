from foliospark.llm import residue


def found(spark, *texts):
    pages = spark.createDataFrame([(n, 0, t) for n, t in enumerate(texts, 1)], "rev_id BIGINT, ns INT, text STRING")
    return sorted(r.rev_id for r in residue.residue_pages(pages).collect())


def test_constant_placeholder_is_found_however_often_it_repeats(spark):
    for n in (1, 2, 3, 5):
        assert found(spark, *["Insert [TEXT] here."] * n) == list(range(1, n + 1))


def test_name_counts_as_filled_unless_it_is_constant(spark):
    filled = ["The town [TOWN] lies near Camiro.", "The town [TOWN] lies near Velda.", "The town [TOWN] lies near Orsk."]
    assert found(spark, *filled) == []
    assert found(spark, *filled[:1] * 3) == []
    assert found(spark, "The page of [NAME] on Folio.", "The page of [TITLE] on Folio.") == [1, 2]


def test_every_line_is_read_whatever_its_length_and_words():
    for line in (
        "400 Bad Request",
        "The connection was reset.",
        "The site is closed.",
        "The server can not process this.",
        "It only fills the space.",
        "The name is ___ here",
        "Lorem ipsum dolor sit amet. " * 200,
        "<html><body><p>404 Not Found</p>" + "<div></div>" * 400 + "</body></html>",
        "tempor magna ullam venit",
        "503 Service Paused",
    ):
        assert residue.has_residue(line), line[:40]


def test_gate_passes_all_that_the_patterns_match():
    for cue in ("PLEASE WAIT", "\u0130ncident", "reque\u017ft: please wait", "{{ a.b }}", "Ray 0f"):
        assert residue.may_match(cue), cue
