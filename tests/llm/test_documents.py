from foliospark.llm import leaks, tokens

ITEM = "Which of the nine rivers of Camiro reaches the sea first in spring?"


def test_token_ids_of_plain_empty_and_special_texts(spark):
    docs = spark.createDataFrame([(1, "Hello <|endoftext|>"), (2, ""), (3, None)], "doc_id BIGINT, text STRING")
    got = dict(tokens.token_ids(docs).collect())
    assert got[2] == got[3] == []
    assert 50256 not in got[1] and tokens.encoding().decode(got[1]) == "Hello <|endoftext|>"


def test_leaked_items_in_altered_form(spark):
    text = "x WHICH, of the n\u00ed\u00adne  ''rivers'' of Camiro | reaches the sea first in autumn"
    short = "of the nine rivers of Camiro reaches the sea first"
    docs = spark.createDataFrame([(1, text), (2, short), (3, None)], "doc_id BIGINT, text STRING")
    items = spark.createDataFrame([(7, ITEM), (8, ITEM), (9, None)], "item_id BIGINT, text STRING")
    assert sorted(map(tuple, leaks.leaked_items(docs, items).collect())) == [(1, 7), (1, 8)]
