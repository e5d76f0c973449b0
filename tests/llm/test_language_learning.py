"""What a language's dictionary is learned from: long texts too, and each different text once."""

import random

from tessella.llm import language


def words(seed, letters, n):
    r = random.Random(seed)
    return " ".join("".join(r.choices(letters, k=r.randint(2, 8))) for _ in range(n))


def test_languages_of_long_texts_and_of_many_copies(spark):
    long = words(1, "abcdef", 4_000)
    assert len(long) > 2 * language.BLOCK
    own = {words(k, "uvwxyz", 12) for k in range(2, 12)}
    # with 3,000 copies of one text, a sample cut before copies go holds next to nothing else
    rows = [("long", long)] + [("copies", t) for t in own] + [("copies", f"  {words(99, 'uvwxyz', 12).upper()}. ")] * 3_000
    df = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    known = language.learn(df)
    assert set(known) == {"long", "copies"}
    assert len(known["long"]) > 3 * language.BLOCK and language.plain(long[:400])[:-9] in known["long"]
    assert all(language.plain(t) in known["copies"] for t in own) and len(known["copies"]) < 3_000
    asked = spark.createDataFrame([(1, words(1, "abcdef", 90)), (2, sorted(own)[0])], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in language.identify(asked, known).collect()} == {1: "long", 2: "copies"}


def test_dictionary_is_the_same_however_rows_are_dealt(spark):
    rows = [("a", words(k, "abcdef", 150)) for k in range(900)]
    df = spark.createDataFrame(rows, "lang string, text string")
    few = language.learn(df.coalesce(1))
    assert few == language.learn(df.repartition(7)) and len(few["a"]) == language.DICTIONARY
