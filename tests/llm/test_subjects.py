"""What of a page's text speaks for a subject, and what only looks like it."""

import random

from foliospark.llm import subjects

SCHEMA = "id BIGINT, ns INT, title STRING, text STRING, rev_id BIGINT, rev_ts TIMESTAMP"


def test_code_links_headings_mentions_and_residue_give_no_subject(spark):
    random.seed(3)
    words = {s: [f"{s}{c}" for c in "abcdefghijklmnop"] for s in subjects.SUBJECTS}
    name = lambda: "".join(random.choice(("vel", "mor", "tan", "qui", "dra", "sel", "ba", "nor")) for _ in range(4)).title()
    word = lambda s: random.choice(words[s])
    about = lambda s: f"Each {word(s)} of {name()} has a {word(s)}."
    neutral = lambda: f"It lies near {name()} and {name()}. Little is known about {name()}."

    def text(of, other):
        parts = [about(s) + "\n\n" + neutral() + "\n\n" + about(s) for s in of for _ in range(2)]
        parts += ["<pre>\n" + "\n".join(about(other) for _ in range(4)) + "\n</pre>", "\n".join(f"* [[{word(other)} {name()}]]" for _ in range(4)), f"== {word(other).title()} ==", about(other), neutral()]
        return f"'''{name()}''' is a {word(of[0])}.\n\n" + "\n\n".join(parts)

    rows, labels = [], []
    for i in range(500):
        *of, other = random.sample(subjects.SUBJECTS, 2 + (i % 4 == 0))
        rows.append((i, of, text(of, other)))
        if i < 380:
            labels += [(i, s) for s in of]
    extra = [(900, 0, "r", "Please enable JavaScript to view this page, lawa.\n\nLorem ipsum dolor sit amet, consectetur adipiscing elit.", 900, None), (901, 0, "n", "Lawa/" + "x9QkZ7" * 20 + "+lawb", 901, None), (902, 0, "s", f"'''{name()}''' is a lawa.", 902, None)]
    df = spark.createDataFrame([(i, 0, "t", t, i, None) for i, _, t in rows] + extra, SCHEMA)
    got = {}
    for r in subjects.page_subjects(df, spark.createDataFrame(labels, "id BIGINT, subject STRING")).collect():
        got.setdefault(r.id, set()).add(r.subject)
    right = sum(got.get(i) == set(of) for i, of, _ in rows[380:])
    assert right >= 0.97 * 120
    assert got.get(902) == {"law"} and not {900, 901} & set(got)
