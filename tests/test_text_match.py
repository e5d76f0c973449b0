"""Text search on a few documents in two languages and without one."""

import pytest

from tessella.operators import textsearch as I


@pytest.fixture(scope="module")
def index(spark):
    rows = [(1, "en", "green houses"), (1, "und", "blue"), (1, "de", "rotes Haus"), (2, "en", "green"), (2, "de", "blue"), (3, "und", "green blue"), (4, "en", None)]
    return I.build_token_index(spark.createDataFrame(rows, "doc_id int, lang string, text string")).persist()


def found(df):
    return sorted(map(tuple, df.collect()))


def test_a_language_and_und_together(index):
    assert found(I.text_match(index, ["green", "blue"])) == [(1, "en"), (3, "und")]
    assert found(I.text_match(index, ["blue"], ["hous"])) == [(1, "en")]
    assert found(I.text_match(index, ["nowhere"])) == []


def test_ids_match_too(index):
    assert found(I.text_match(index, ["nowhere"], ids=[2, 9])) == [(2, "de"), (2, "en")]


def test_phrases_exact_and_stemmed(index):
    assert found(I.text_phrase(index, ["green", "house"])) == []
    stem = index.where("exact = 'houses'").first().token
    assert found(I.text_phrase(index, ["green", stem], stemmed=True)) == [(1, "en")]


def test_display_labels_count_threefold(spark):
    kind = "doc_id int, lang string, score double"
    scores, display = spark.createDataFrame([(1, "en", 2.0), (1, "de", 1.0), (2, "en", 4.0)], kind), spark.createDataFrame([(1, "de", 2.0), (3, "en", 1.0)], kind)
    assert found(I.best_language(scores, display=display)) == [(1, pytest.approx(7.2)), (2, 4.0), (3, 3.0)]
