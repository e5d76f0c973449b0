"""What must not grow with the tables: rows of one value in one task, small tables that are sent whole, rows that nothing asks for."""

import duckdb
import pytest

from tessella.operators import hierarchy as H, quality as V, textsearch as I
from tessella.plans import catalog
from tessella.plans.q_search import ancestors
from tessella.plans.tables import claims

DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["permitted", "readable_roles"])
def test_roles_of_many_documents_are_dealt_over_tasks(spark, name):
    shown = plan(catalog.queries()[name](spark, DIR))
    assert "__part" in shown


@pytest.mark.parametrize("name", ["embedding_edges", "embedders_to_refresh", "affected_docs"])
def test_references_of_one_property_are_dealt_over_tasks(spark, name):
    assert "__part" in plan(catalog.queries()[name](spark, DIR))


def test_ancestors_are_not_sent_whole_to_every_task(spark):
    up = ancestors(spark, DIR)
    assert "Broadcast" not in plan(H.expand_refs(claims(spark, DIR, "orders", only={"CUSTOMER"}), up))
    assert "Broadcast" not in plan(H.mark_leaves(H.expand_refs(claims(spark, DIR, "orders", only={"CUSTOMER"}), up)))


def test_index_holds_what_a_search_asks_for(spark):
    docs = spark.createDataFrame([(1, "en", "The cats of Rome"), (2, "en", "idiocy offers THE"), (3, "en", "x y")], "doc_id long, lang string, text string")
    for folded in (False, True):
        got = lambda **k: sorted((r.doc_id, r.exact) for r in I.build_token_index(docs, folded=folded, **k).collect())  # noqa: B023, E731
        assert got(terms=["cat"]) == [(1, "cats")]
        assert got(terms=[], exact=["of", "the"]) == [(1, "The"), (1, "of"), (2, "THE")]
        assert got(terms=["cat"], prefixes=["idio"], ids=[3]) == [(1, "cats"), (2, "idiocy"), (3, "x"), (3, "y")]


def test_trigrams_are_not_read_by_place(spark):
    """A place in a text is found by reading all before it: long texts would take the square of their length."""
    assert "substr" not in plan(catalog.queries()["route_language"](spark, DIR)).lower()
    docs = spark.createDataFrame([(1, "abc\U0001F600def" * 9, "x"), (2, "", "x"), (3, None, "x"), (4, "ab", "y")], "doc_id long, text string, lang string")
    assert sorted(map(tuple, I.route_language(docs, docs).collect())) == [(1, "x"), (2, "und"), (3, "und"), (4, "und")]


def test_words_of_an_index_are_not_shuffled(spark, tmp_path):
    """Texts are dealt by document and language; their words are grouped and written where they are made."""
    docs = spark.createDataFrame([(1, "en", "a b a"), (1, "en", "b c"), (1, "de", "a"), (2, "en", None)], "doc_id long, lang string, text string")
    out = I.build_token_index(docs, folded=False)
    assert sorted((r.doc_id, r.lang, r.token, r.positions, r.n) for r in out.collect()) == [(1, "de", "a", [0], 1), (1, "en", "a", [0, 2], 2), (1, "en", "b", [0, 1], 2), (1, "en", "c", [1], 1)]
    shown = plan(catalog.queries()["token_index"](spark, DIR))
    shown = shown[shown.index("Initial Plan"):] if "Initial Plan" in shown else shown
    assert shown.count("Exchange") == 1 and shown.index("Generate") < shown.index("Exchange")


def test_sub_claims_are_counted_with_one_shuffle_of_claims(spark):
    rows = [("d1", "c1", None, "A", 0), ("d1", "s1", "c1", "X", 1), ("d1", "s2", "c1", "X", 1), ("d1", "c2", None, "A", 0), ("d2", "c3", None, "A", 0), ("d2", "t1", "c3", "Z", 1), ("d3", "c4", None, "A", 0), ("d1", "c5", None, "B", 0)]
    c = spark.createDataFrame(rows, "doc_id string, claim_id string, parent_claim_id string, prop string, depth int")
    fields = spark.createDataFrame([("k", "A", "X", 1, 1), ("m", "A", "X", 0, None), ("m", "A", "Z", 2, 3), ("m", "A", "Z", 5, None)], "class string, parent string, prop string, min int, max int")
    has_class = spark.createDataFrame([("d1", "k"), ("d2", "m"), ("d2", "m")], "doc_id string, class string")
    out = V.sub_cardinality_violations(c, fields, has_class)
    assert sorted(map(tuple, out.collect()), key=str) == [("d1", "c1", "X", 2, 1, 1), ("d1", "c2", "X", 0, 1, 1), ("d2", "c3", "Z", 1, 2, 3), ("d2", "c3", "Z", 1, 5, None)]
    shown = plan(out)
    shown = shown[shown.index("Initial Plan"):] if "Initial Plan" in shown else shown
    assert shown.index("Generate inline") < shown.index("Exchange")  # the rows of claims and fields are made after it and stay there


def test_embed_deep_makes_only_the_claims_it_needs(spark):
    shown = plan(catalog.queries()["embed_deep"](spark, DIR))
    assert "o_totalprice" not in shown and "l_quantity" not in shown


def test_no_row_is_made_for_each_place_of_a_text(spark, tmp_path):
    """Texts are counted where they are read and once; documents of several texts, short texts and odd characters as in SQL."""
    texts = ["the cat of the house and the dog", "le chat de la maison et le chien", "THE \U0001F600\U0001F600 cat é́ of the", "", None, "x", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "le chat de la maison and the dog of"]
    rows = [(i % 13, t, ["en", "fr", "en", "fr", None, "xx"][i % 6]) for i, t in enumerate(texts * 4)] + [(40 + i, t * 3, "en" if i % 2 else "fr") for i, t in enumerate(texts[:2])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df = catalog.queries()["route_language"](spark, str(tmp_path))
    want = con.execute(catalog.oracle_sql()["route_language"]).fetchall()
    assert sorted(map(tuple, df.select("doc_id", "lang").collect())) == sorted(want) and {x for _, x in want} > {"und"}
    shown = plan(df)
    assert "Generate" not in shown and shown.count("MapInArrow") == 2  # its documents, and again those of several texts
