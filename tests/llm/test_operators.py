"""Small cases of the training-data operators: nulls, empty and long texts, ties, repeated rows, empty tables, other columns."""

import math
import random

import numpy as np
import pytest

from foliospark.llm import duplicates, leaks, markup, quality, queries, residue, sentences, split, subjects, tokens

PROSE = "The first lattice of Camiro was measured in 1848 after the isotope had been classified by Velda. Little is known about the plan before 1732, but it was not lost. "


def pages(spark, rows):
    """rev_id, text and clashing columns."""
    return spark.createDataFrame([(r, r, 0, t, "x", 1) for r, t in rows], "rev_id BIGINT, id BIGINT, ns INT, text STRING, class STRING, score INT")


# ------------------------------------------------------------------ splitting


@pytest.mark.parametrize("text", ["", "short", "a" * 50_000, "é" * 20_000, "。".join("文字" * 50 for _ in range(200)), PROSE * 400, "\n".join(["== A ==", PROSE] * 90), " " * 30_000, "x" * 5_990 + "\n\n" + "y" * 5_990])
def test_pieces_keep_limits_and_lose_nothing(text):
    raw = text.encode()
    cuts = split.balanced_cuts(text)
    assert b"".join(raw[f:e] for _, f, e, _ in cuts) == raw
    for start, fresh, end, _ in cuts:
        assert end - start <= split.LIMIT and 0 <= fresh - start <= split.OVERLAP
        raw[start:end].decode()
    assert len(cuts) <= 2 * (1 + max(0, math.ceil((len(raw) - split.LIMIT) / (split.LIMIT - split.OVERLAP)))) + 1


def test_oversized_counts_unbroken_stretches_once_per_revision(spark):
    df = pages(spark, [(1, "a" * 7000 + ". " + "b" * 7000), (1, "a" * 7000 + ". " + "b" * 7000), (2, "word " * 2000), (3, "fits"), (4, None), (5, "")])
    assert sorted(map(tuple, split.oversized(df).collect())) == [(1, 2), (2, 0)]
    assert split.split_pages(df).where("rev_id = 1").count() == len(split.balanced_cuts("a" * 7000 + ". " + "b" * 7000))


# ------------------------------------------------------------------ tokens


def test_words_of_any_text_come_back(spark):
    random.seed(3)
    signs = ["a", " ", "\n", "é", "文", "1", "'s", "<|endoftext|>", "　", "\U0001f600", "̀", "ß"]
    texts = ["".join(random.choices(signs, k=random.randrange(60))) for _ in range(200)] + ["", None, "x" * 30_000, " " * 5_000]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(7, texts[7]), (None, "no id")], "doc_id BIGINT, text STRING")
    got = tokens.token_ids(docs)
    rows = got.collect()
    assert len(rows) == len(texts) + 2
    enc = tokens.encoding()
    ids = {r.doc_id: list(r.ids) for r in rows}
    assert all(ids[i] == (enc.encode_ordinary(t) if t else []) for i, t in enumerate(texts))
    back = {r.doc_id: r.text for r in tokens.decoded(got).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts))


def test_blocks_are_cut_by_words_not_rows(spark):
    docs = spark.createDataFrame([(i, f"the word {i} again and the rest") for i in range(30)], "doc_id BIGINT, text STRING").coalesce(1)
    assert tokens.word_blocks(docs, 10).count() == 30


def test_empty_documents(spark):
    none = spark.createDataFrame([], "doc_id BIGINT, text STRING, lang STRING")
    items = spark.createDataFrame([], "item_id BIGINT, text STRING")
    assert tokens.token_ids(none).count() == leaks.leaked_items(none, items).count() == sentences.sentence_units(none).count() == 0


# ------------------------------------------------------------------ leaks


def test_phrases_equal_brute_force(spark):
    random.seed(5)
    vocabulary = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(random.choices(vocabulary, k=random.choice((3, 12, 14, 30))))) for i in range(12)] + [(90, None), (91, ""), (92, "w1 " * 40)]
    docs = []
    for i in range(60):
        words = random.choices(vocabulary, k=40)
        if i % 3 == 0:
            text = random.choice(items[:12])[1].split()
            at = random.randrange(30)
            words[at:at] = text[: random.choice((11, 12, 30))]
        docs.append((i, " ".join(words)))
    docs.append((99, "w1 " * 12))

    def runs(t):
        w = (t or "").split()
        return {tuple(w[i : i + 12]) for i in range(len(w) - 11)}

    want = sorted((d, i) for d, t in docs for i, x in items if runs(t) & runs(x))
    found = leaks.leaked_items(spark.createDataFrame(docs, "doc_id BIGINT, text STRING").repartition(3), spark.createDataFrame(items, "item_id BIGINT, text STRING"))
    assert sorted(map(tuple, found.collect())) == want and (99, 92) in want


def test_proximity_needs_distinct_words_in_a_span(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, "ten nine eight x seven six five y four three two one"), (2, "one " * 30), (3, " gap gap gap ".join(item.split()))], "doc_id BIGINT, text STRING")
    items = spark.createDataFrame([(5, item)], "item_id BIGINT, text STRING")
    assert list(map(tuple, leaks.near_items(docs, items).collect())) == [(1, 5)]


# ------------------------------------------------------------------ near duplicates


def test_golay_near_holds_every_codeword_within_distance_four():
    g = duplicates._Golay()
    codewords = np.array([m << 11 | int(duplicates._syndromes(np.array([m << 11]))[0]) for m in range(4096)])
    assert min(int(x).bit_count() for x in codewords[1:]) == 7
    random.seed(2)
    for w in random.sample(range(1 << 23), 60):
        want = {int(c) >> 11 for c in codewords if (int(c) ^ w).bit_count() <= 4}
        got = g.near(np.array([w]))[0]
        assert set(got[got >= 0].tolist()) == want


def test_pairs_equal_brute_force_with_copies(spark):
    random.seed(8)
    rows = []
    for base in range(12):
        words = [f"b{base}x{random.randrange(400)}" for _ in range(120)]
        for k in range(4):
            changed = words[:]
            for _ in range(k * 4):
                changed[random.randrange(len(changed))] = f"e{random.random()}"
            rows.append((base * 10 + k, " ".join(changed)))
        rows.append((base * 10 + 8, " ".join(words).upper()))
    rows += [(500, "too short"), (501, None), (502, ""), rows[0]]
    df = pages(spark, rows)
    sets = {r: set(duplicates.shingle_set(t).tolist()) for r, t in rows if duplicates.shingle_set(t) is not None}
    want = {(a, b) for a in sets for b in sets if a < b and 10 * len(sets[a] & sets[b]) >= 7 * len(sets[a] | sets[b])}
    got = [tuple(r) for r in duplicates.similar_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.97 * len(want)
    groups = {r.rev_id: r.group_id for r in duplicates.groups(df).collect()}
    assert set(groups) == set(sets) and all(groups[a] == groups[b] for a, b in got)
    assert groups[0] == groups[8] == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a BIGINT, b BIGINT")
    nodes = spark.createDataFrame([(i,) for i in [*range(41), 100, 101, 200]], "node BIGINT")
    got = {r.node: r.root for r in duplicates.components(edges, nodes).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100 and got[200] == 200


# ------------------------------------------------------------------ quality


def test_ranks_equal_sorting_with_ties(spark):
    random.seed(4)
    rows = [(random.choice("ab"), random.choice((0, 0, 0, 1, 2, 7, 9))) for _ in range(300)]
    df = spark.createDataFrame(rows, "g STRING, x INT").repartition(5)
    for r in quality.exact_ranks(df, ["g"], "x").collect():
        own = [x for g, x in rows if g == r.g]
        assert (r.n, r.at_most, r.total) == (own.count(r.x), sum(x <= r.x for x in own), len(own))


def test_shapes_of_plain_cases(spark):
    table = "{|\n|-\n" + "\n|-\n".join(f"| a{i} || b || {i}" for i in range(20)) + "\n|}"
    rows = [
        (1, PROSE * 4), (2, "\n".join(f"* item {i}" for i in range(20))), (3, table), (4, "\n".join(f"name{i}\tx\t{i}\t{i * 7}" for i in range(30))), (5, "qzxv wkrtp bcdfg jkhgf mnbvc " * 20),
        (6, "#REDIRECT [[X]]"), (7, ""), (8, None), (9, "'''X''' may refer to:\n\n{{disambig}}"), (10, " · ".join(f"red part {i}" for i in range(30))), (11, "\n".join(f"Velda part, {1900 + i}" for i in range(20))), (12, "12 34 5678 99 " * 40), (2, "\n".join(f"* item {i}" for i in range(20))),
    ]
    rows += [(100 + i, PROSE * 3 + f"It ended in {i}.") for i in range(60)]
    got = dict(map(tuple, quality.shapes(pages(spark, rows)).collect()))
    assert got == {2: "list", 3: "table", 4: "table", 5: "junk", 9: "list", 10: "list", 11: "list", 12: "junk"}


# ------------------------------------------------------------------ subjects


def test_subjects_of_held_out_pages(spark):
    words = {s: [f"{s}{i}" for i in range(12)] for s in subjects.SUBJECTS}
    random.seed(6)

    def text(*of):
        return "\n\n".join(". ".join(f"The {random.choice(words[s])} of Camiro has a {random.choice(words[s])}" for _ in range(5)) + "." for s in of)

    rows, labels = [], []
    for i in range(300):
        of = random.sample(subjects.SUBJECTS, 1 + (i % 4 == 0))
        rows.append((i, of, text(*of)))
        if i < 220:
            labels += [(i, f" {s.upper()} ") for s in of]
    labels += [(1, None), (2, "gardening")]
    df = spark.createDataFrame([(i, 0, "t", t, i, None) for i, _, t in rows] + [(900, 0, "r", "#REDIRECT [[X]]", 1, None), (901, 0, None, None, 2, None), (902, 10, "x", rows[0][2], 3, None)], "id BIGINT, ns INT, title STRING, text STRING, rev_id BIGINT, rev_ts TIMESTAMP")
    got = {}
    for r in subjects.page_subjects(df, spark.createDataFrame(labels, "id BIGINT, subject STRING")).collect():
        got.setdefault(r.id, set()).add(r.subject)
    right = sum(got.get(i) == set(of) for i, of, _ in rows[220:])
    assert right >= 0.9 * 80 and not {900, 901, 902} & set(got)


def test_without_labels_nothing_is_found(spark):
    df = spark.createDataFrame([(1, 0, "t", PROSE, 1, None)], "id BIGINT, ns INT, title STRING, text STRING, rev_id BIGINT, rev_ts TIMESTAMP")
    assert subjects.page_subjects(df, spark.createDataFrame([], "id BIGINT, subject STRING")).count() == 0


# ------------------------------------------------------------------ sentences


@pytest.mark.parametrize(
    "text",
    [
        "Dr. Vel left at 9 p.m. |What then?", "See fig. 3 and vol. 4 of it. |It cost 3.5 m.", "“Is it late?” asked Vel. |“Go. Now!” said Orsa.", "The firm Nel! of Vor sold it. |Then it ended... |Oh, Vel!", "It ended.|Then Vel left.", "Visit www.Vel.example now. |Done.",
        "Er schrieb z. B. am 2. Juni. |„Wer?“, fragte Vel, „und warum?“", "« Où ? » demanda Vel. |On lit : « Il pleut. Rentrons. » |En 1588, fin.", "¿Y Vel? |¡Vel volvió en 1930!", "«Кто там? Это ты?» — спросил Вел. |В 1739 г. Вел перешёл. |Это было давно…", "“走吧。”卡说。|长度为8.6公里。|卡说：“冷。回家！”|卡大！", "「誰？」とカが聞いた。|ノ（1445年築。今は無い。）は丘だ。",
        "ใครเคย |มีคน 86 คนออก |ความยาว", "डॉ. वेल ने 5.4 मीटर नापा। |\"चलो! देर हो गई।\" वेल ने कहा।", "كتب أ. د. فلمار. |قالت: «هيا بنا! بارد.» |هل رأى؟", "Ποιος είδε τη Ντ; |Ο κ. Μίλ έγραψε κ.λπ. μέσα.", "(It was moved.) |He (why not?) left.",
    ],
)
def test_sentences_of_many_scripts(text):
    whole = text.replace("|", "")
    assert [whole[a:b] for a, b in sentences.units(whole)] == [x.strip() for x in text.split("|")]


def test_blank_lines_always_end_a_unit(spark):
    docs = spark.createDataFrame([(1, "Title\n \nOne\nline. Two"), (2, None), (3, " \n "), (4, "x. " * 3000)], "doc_id BIGINT, text STRING")
    got = {}
    for r in sentences.sentence_units(docs).collect():
        got.setdefault(r.doc_id, []).append((r.sent_no, r.start_at, r.end_at))
    assert got[1] == [(1, 0, 5), (2, 8, 17), (3, 18, 21)] and set(got) == {1, 4}


# ------------------------------------------------------------------ residue


def test_lone_words_do_not_hide_residue(spark):
    rows = [(1, "Content coming soon. TODO"), (2, "TBD TODO"), (3, "Dummy copy for layout purposes only. Velda"), (4, "Velda"), (5, PROSE), (6, None), (7, ""), (1, "Content coming soon. TODO")]
    assert sorted(r.rev_id for r in residue.residue_pages(pages(spark, rows)).collect()) == [1, 2, 3]


def test_every_problem_has_its_queries():
    assert {f"p{n}" for n in (1, 2, 3, 4, 5, 6, 8, 9, 10)} == {q.split("_")[0] for q in queries.QUERIES}


def test_empty_pages(spark):
    none = spark.createDataFrame([], "id BIGINT, ns INT, title STRING, text STRING, rev_id BIGINT, rev_ts TIMESTAMP, contributor STRING")
    labels = spark.createDataFrame([(1, "law")], "id BIGINT, subject STRING")
    for f in (residue.residue_pages, residue.residue_templates, split.oversized, split.split_pages, markup.structural_units, markup.clean_pages, duplicates.similar_pairs, duplicates.groups, quality.shapes, lambda p: quality.outliers(quality.text_statistics(p)), lambda p: subjects.page_subjects(p, labels)):
        assert f(none).count() == 0


def test_very_long_texts(spark):
    long = PROSE * 6000
    df = pages(spark, [(1, long), (2, long), (3, "{{a|" * 3000 + "x"), (4, "word" * 200_000), (5, "\n".join("* x" for _ in range(60_000)))])
    assert markup.structural_units(df).where("rev_id = 5").count() == 60_000
    assert [tuple(r) for r in duplicates.similar_pairs(df).collect()] == [(1, 2)]
    assert dict(map(tuple, quality.shapes(df).collect())).get(5) == "list"
    assert {r.rev_id for r in split.oversized(df).collect()} == {1, 2, 3, 4, 5}
    docs = df.selectExpr("rev_id AS doc_id", "text")
    assert {r.doc_id: len(r.ids) for r in tokens.token_ids(docs).collect()}[1] == len(tokens.encoding().encode_ordinary(long))
    assert sentences.sentence_units(docs).where("doc_id = 1").count() == 12_000
