"""Choices among readings of a page, order of answers, passages of a source: nulls, ties, repeats, empty tables."""

from lodestone.operators import html, retrieve, selection

READING = "struct<text_len:int,link_density:double,code_blocks:int,table_rows:int>"
PAGES = f"id long, reader {READING}, full {READING}, boundary {READING}"


def test_choice_of_reading(spark):
    rows = [
        (1, None, None, None),
        (2, (None, None, None, None), None, None),
        (3, (0, 0.0, 0, 0), (10, 0.0, 0, 0), None),
        (4, (900, 0.0, 2, 0), (900, 0.0, 8, 0), None),  # the same length: the full text is no gain
        (5, (500, 0.0, 1, 0), (900, 0.0, 2, 0), None),  # half of the code is enough
    ]
    got = {r.id: (r.choice, r.guard) for r in html.choose_candidate(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {1: (None, None), 2: ("reader", None), 3: ("full", "thin-article"), 4: ("reader", None), 5: ("reader", None)}
    assert html.choose_candidate(spark.createDataFrame([], PAGES)).count() == 0


def test_order_of_answers(spark):
    schema = "question long, accepted boolean, score int, id long"
    rows = [(1, None, 9, 1), (1, True, None, 2), (1, False, 9, 3), (1, None, -1, 4), (1, None, None, 5), (None, True, 1, 6)]
    got = selection.order_answers(spark.createDataFrame(rows, schema), "question", "id").orderBy("question", "position").collect()
    assert [r.id for r in got] == [6, 2, 1, 3, 5, 4]
    assert selection.order_answers(spark.createDataFrame([], schema), "question", "id").count() == 0


def test_passages_of_sources(spark):
    sources = spark.createDataFrame([("https://a.org/x/", 7), ("https://b.org/", 8), (None, 9)], "url string, best int")
    passages = spark.createDataFrame([("https://a.org/x#top", 3, 0.5), ("https://a.org/x", 1, 0.9), ("https://c.org/", 2, 1.0), (None, 4, 0.1)], "url string, index int, score double")
    got = {r.best: (r.passage_indices, r.best_score) for r in retrieve.passages_by_source(sources, passages).collect()}
    assert got == {7: ([1, 3], 0.9), 8: ([], None), 9: ([], None)}
    assert retrieve.passages_by_source(sources.limit(0), passages).count() == 0
