"""Claims of three levels: made, pruned, nested and exploded, and records by their parent's property."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessella.operators import claims as K, edges as E
from tessella.operators.records import records
from tessella.operators.claims import Field


@pytest.fixture(scope="module")
def deep(spark):
    rows = spark.createDataFrame([(i, 1.0 - i / 10, 0.9, "2001-02-03" if i % 2 else "-12345-06") for i in range(6)], "k int, a double, b double, t string")
    low = Field("LOW", "time", {"raw": "t", "time_precision": "IF(k % 2 = 1, 'd', 'm')"})
    mid = Field("MID", "amount", {"raw": "CAST(k AS STRING)", "precision": "1.0D"}, confidence="b", subs=[low])
    return K.rows_to_claims(rows, "'x:' || k", [Field("TOP", "string", {"str_value": "'v' || k"}, confidence="a", subs=[mid, Field("SIDE", "has", when="k > 2")])]).persist()


def test_ids_and_parents(deep):
    rows = {r.claim_id: r for r in deep.collect()}
    assert len(rows) == 6 * 3 + 3
    for r in rows.values():
        up = rows.get(r.parent_claim_id)
        assert (up is None) == (r.depth == 0) and (up is None or (up.prop, up.depth, up.doc_id) == (r.parent_prop, r.depth - 1, r.doc_id))


def test_confident_goes_down_all_levels(deep):
    left = sorted((r.doc_id, r.prop) for r in K.confident(deep, 0.75).collect())
    assert left == sorted((f"x:{i}", p) for i in range(3) for p in ("TOP", "MID", "LOW"))
    assert K.confident(deep, 2.0).count() == 0 and K.confident(deep, 0.0).count() == deep.count()


def test_nesting_keeps_every_level(deep):
    assert sorted(map(repr, K.explode_claims(K.nest_claims(deep, 3)).collect())) == sorted(map(repr, deep.collect()))
    with pytest.raises(PySparkException):
        K.nest_claims(deep).collect()


def test_records_of_days_and_other_times(spark, deep):
    none = spark.createDataFrame([], "id string, ancestor string, min_depth int")
    got = {(r.doc_id, r.prop): r for r in records(deep, none).collect()}
    assert got["x:1", "LOW"].lo == 981158400.0 and got["x:1", "LOW"].hi == 981244800.0 and got["x:1", "LOW"].parent_prop == "MID"
    assert got["x:0", "LOW"].hi - got["x:0", "LOW"].lo == 30 * 86400 and got["x:0", "LOW"].lo < -4e11
    assert got["x:4", "MID"].lo == 3.5 and got["x:4", "SIDE"].collection == "rel" and got["x:2", "TOP"].text == "v2"


def tree(spark, name, values, order=1, mid="same"):
    """A chain of four claims with two leaves of the given values; ids differ by name."""
    rows = [("d", f"{name}{i}", f"{name}{i - 1}" if i else None, None, i, 0, "string", f"P{i}", 1.0, "top" if i == 0 else mid) for i in range(3)]
    rows += [("d", f"{name}leaf{k}", f"{name}2", "P2", 3, order * k, "string", "LEAF", 1.0, v) for k, v in enumerate(values)]
    df = spark.createDataFrame(rows, "doc_id string, claim_id string, parent_claim_id string, parent_prop string, depth int, ord int, type string, prop string, confidence double, str_value string")
    return df.select(*[df[c].cast(k).alias(c) if c in df.columns else F.lit(None).cast(k).alias(c) for c, k in K.CLAIM.items()])


def test_signatures_cover_whole_trees(spark):
    same = lambda a, b: E.claims_equivalent(a, b).first().equivalent
    assert same(tree(spark, "a", ["x", "y"]), tree(spark, "b", ["y", "x"], -1))
    assert not same(tree(spark, "a", ["x", "y"]), tree(spark, "b", ["x", "z"]))
    assert not same(tree(spark, "a", ["x", "y"]), tree(spark, "b", ["x"]))
    assert not same(tree(spark, "a", ["x"]), tree(spark, "b", ["x"], mid="other"))
    assert not same(tree(spark, "a", ["x", "x"]), tree(spark, "b", ["x"]))
    both = tree(spark, "a", ["x"]).unionByName(tree(spark, "b", ["x"])).unionByName(tree(spark, "c", ["y"]))
    assert [(r.prop, r.n) for r in E.duplicate_claims(both).collect()] == [("P0", 2)]
    assert {r.n for r in E.duplicate_claims(both, with_sub=False).collect()} == {3}
    ids = K.claim_signature(both, with_id=True)
    assert ids.select("signature").distinct().count() == ids.count() == 12
    assert K.claim_signature(both.limit(0)).collect() == [] and E.claims_equivalent(both, both.limit(0)).first().equivalent is False


def test_paths_of_any_depth(spark, deep):
    four = K.with_paths(tree(spark, "a", ["x", "y"]))
    assert sorted(r.path for r in four.collect()) == ["P0", "P0.P1", "P0.P1.P2", "P0.P1.P2.LEAF", "P0.P1.P2.LEAF"]
    assert K.match_paths(tree(spark, "a", ["x", "y"]), ["**"]).count() == 5
    assert {r.path for r in K.match_paths(tree(spark, "a", ["x"]), ["P0.*.P2.**"]).collect()} == {"P0.P1.P2", "P0.P1.P2.LEAF"}
    assert K.with_paths(deep).count() == deep.count() and K.with_paths(deep, 2).where("depth > 1").count() == 0
    assert K.with_paths(deep.limit(0)).collect() == []


def test_floor_in_the_projection_is_confident(spark):
    rows = spark.createDataFrame([(i, 1.0 - i / 10, 0.3 + i / 10) for i in range(8)], "k int, a double, b double")
    fields = [Field("TOP", "has", confidence="a", subs=[Field("MID", "has", confidence="b", subs=[Field("LOW", "has")])]), Field("ONE", "has", confidence="b")]
    for floor in (0.0, 0.5, 0.75, 2.0):
        pruned = K.rows_to_claims(rows, "'x:' || k", fields, floor)
        kept = K.confident(K.rows_to_claims(rows, "'x:' || k", fields), floor).select(pruned.columns)
        assert sorted(map(repr, pruned.collect())) == sorted(map(repr, kept.collect()))
