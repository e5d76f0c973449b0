"""Operators on a few rows, with results worked out by hand."""

import random

import pytest

from tessella.operators import access, claims as K, duplicates as J, edges as E, facets as A, grouping as G, hierarchy as H, store as S
from tessella.sources import io
from tessella.streaming import maintenance as M


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_commit_log(spark, tmp_path):
    spark.createDataFrame([(3, "main"), (1, "main"), (2, "side"), (4, "main")], "seq int, view string").write.parquet(f"{tmp_path}/log")
    assert [r.seq for r in io.commit_log(spark, f"{tmp_path}/log", 1, "main").collect()] == [3, 4]
    assert io.commit_log(spark, f"{tmp_path}/log").count() == 4


def test_write_index(spark, tmp_path):
    io.write_index(spark.createDataFrame([("a", "P", "public"), ("b", "Q", "secret")], "doc_id string, prop string, level string"), f"{tmp_path}/index", 4)
    back = spark.read.parquet(f"{tmp_path}/index")
    assert rows(back.where("level = 'secret'").select("doc_id", "prop")) == [("b", "Q")]
    assert {p.name for p in (tmp_path / "index").iterdir() if p.is_dir()} == {"level=public", "level=secret"}


RECORD = "doc_id string, prop string, collection string, claim_type string, depth int, parent_prop string, unit string, lo double, hi double, hi_incl boolean"


def windows(spark, spans):
    return spark.createDataFrame([(f"d{i}", "P", "amount", "amount", 0, None, None, float(lo), float(hi), incl) for i, (lo, hi, incl) in enumerate(spans)], RECORD)


def test_histogram_of_a_selection(spark):
    r = windows(spark, [(i, i + 1, False) for i in range(100)])
    got = A.histogram(r, "P", gte=20.0, lte=40.0, bins=10).orderBy("bin").collect()
    assert got[0].lo == 18.0 and len(got) == 10 and abs(got[1].lo - 20.4) < 1e-9  # 18 to 42: a tenth wider on either side
    assert got[0].docs == 3 and sum(x.docs > 0 for x in got) == 10
    one = A.histogram(r, "P", gte=20.0, lte=20.0).collect()
    assert len(one) == 1 and one[0].docs == 1
    assert A.histogram(r, "P", gte=-50.0, lte=5.0, bins=2).orderBy("bin").first().lo == 0.0


def test_bounds_of_points_and_open_ends(spark):
    b = A.value_bounds(windows(spark, [(5, 5, True), (7, 7, True)]), "P").first()
    assert (b.least, b.most, b.start_is_end, b.open_start, b.open_end) == (5.0, 7.0, True, False, False)
    h = A.histogram(windows(spark, [(5, 5, True), (7, 7, True)]), "P", bins=3).orderBy("bin").collect()
    assert h[0].lo == 4.0 and [x.docs for x in h] == [0, 1, 1]  # stepped down by one
    b = A.value_bounds(windows(spark, [(-1.8e308, 3, False), (1, 1.7976931348623157e308, False)]), "P").first()
    assert b.open_end and b.most == 3.0


def test_limit_groups_by_different_documents(spark):
    r = spark.createDataFrame([("x", "a", 1), ("x", "b", 2), ("y", "a", 1), ("y", "c", 2), (None, "d", 1)], "g string, doc_id string, position int")
    assert rows(G.limit_groups(r, None, ["g"], 3).select("g", "doc_id", "position")) == [("x", "a", 1), ("x", "b", 2), ("y", "a", 1)]
    assert rows(G.limit_groups(r, None, ["g"], 3, unique=True).select("g", "doc_id", "position")) == [("x", "a", 1), ("x", "b", 2), ("y", "a", 1), ("y", "c", 2)]


def test_order_values(spark):
    values = spark.createDataFrame([("a", 5), ("b", 5), ("c", 9), ("d", 1)], "to string, docs long")
    paths = spark.createDataFrame([("a", ["r", "m", "a"]), ("b", ["r", "b"]), ("b", ["b"])], "id string, id_path array<string>")
    assert [(r.to, r.depth, r.position) for r in A.order_values(values, paths, 3).orderBy("position").collect()] == [("c", 1, 1), ("b", 2, 2), ("a", 3, 3)]


def test_merge_paths(spark):
    kind = "target string, embedder string, paths array<string>"
    a = spark.createDataFrame([("t", "e", ["p", "q"]), ("t", "f", ["p"])], kind)
    b = spark.createDataFrame([("t", "e", ["q"]), ("t", "f", ["r"]), ("u", "g", ["p"])], kind)
    assert rows(E.merge_paths(a, b)) == [("t", "e", ["p", "q"], False), ("t", "f", ["p", "r"], True), ("u", "g", ["p"], True)]


def test_distinct_documents_are_no_duplicates(spark):
    kind = "doc_id string, claim_id string, depth int, confidence double, type string, prop string, str_value string, to string, raw string, unit string"
    claim = lambda d, i, t, p, v, to=None: (d, f"{d}{i}", 0, 1.0, t, p, v, to, None, None)
    c = spark.createDataFrame([claim(d, 0, "id", "ISBN", "1") for d in "abc"] + [claim("c", 1, "ref", "NOT", None, "a")], kind)
    assert {(r.a, r.b) for r in J.find_duplicates(c, distinct_prop="NOT").collect()} == {("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")}


@pytest.mark.parametrize("width", [1.0, 7.0])
def test_overlap_of_wide_and_open_windows(spark, width):
    r = random.Random(3)
    top = 1.7976931348623157e308
    spans = [(i, "k", lo := r.uniform(-50, 50), lo + r.choice([0.5, 3, 40, 5_000])) for i in range(60)] + [(60, "k", 0.0, top), (61, "k", -top, 0.0), (62, "k", -top, top), (63, "other", 0.0, top), (64, "k", None, 3.0)]
    df = spark.createDataFrame(spans, "id int, prop string, lo double, hi double")
    want = [(a, b, "k") for a, k, lo, hi in spans for b, m, x, y in spans if k == m and None not in (lo, x) and lo < y and x < hi and k == "k"] + [(63, 63, "other")]
    assert rows(J.overlap_join(df, df, width)) == sorted(want, key=repr)


def test_store_readers(spark):
    views = spark.createDataFrame([("main", 1, ["main"], "old"), ("main", 2, ["main"], "new"), ("side", 1, ["side", "main"], None)], "view string, revision int, path array<string>, name string")
    assert rows(S.view_paths(views, "side", "leaf")) == [("leaf", ["leaf", "side", "main"])]
    assert rows(S.released_names(views)) == [("old",)]
    changes = spark.createDataFrame([("x", "c1", 1), ("x", "c1", 2), ("y", "c2", 1)], "id string, changeset string, revision int")
    assert rows(S.changes_of(changes, "c1").select("id", "revision")) == [("x", 2)]
    committed = spark.createDataFrame([("main", "c1"), ("side", "c1"), ("main", "c2"), ("main", "c1")], "view string, changeset string")
    assert rows(S.views_of(committed, "c1")) == [("main",), ("side",)]


def test_validate_patches(spark):
    p = spark.createDataFrame([("s", 1, "s/1", "a", "add", "v"), ("s", 2, "s/9", "b", "set", None), ("s", 4, "s/4", "c", "add", "v"), ("t", 1, "t/1", "d", "add", None)], "session string, op int, base string, claim_id string, kind string, value string")
    assert {r.claim_id: r.error for r in S.validate_patches(p).collect()} == {"a": None, "b": "base", "c": "number", "d": "incomplete"}


def test_tombstones_expire(spark):
    df = spark.sql("SELECT * FROM VALUES ('a', true, TIMESTAMP '2026-01-01 00:00:00'), ('b', true, TIMESTAMP '2026-01-02 12:00:00'), ('c', false, TIMESTAMP '2020-01-01 00:00:00') AS t(doc_id, deleted, at)")
    assert rows(M.expire_tombstones(df, "2026-01-03 00:00:00").select("doc_id")) == [("b",), ("c",)]


def test_finalize_runs_hooks_in_order(spark):
    df = spark.createDataFrame([(1,)], "x int")
    assert rows(access.finalize(df, [lambda d: d.selectExpr("x + 1 AS x"), lambda d: d.selectExpr("x * 10 AS x")])) == [(20,)]


def test_earliest_interval_of_years_of_any_length(spark):
    line = K.Field("LINE", "ref", {"to": "t"}, ord="n", key="t", subs=[K.Field("FROM", "time", {"raw": "r", "time_precision": "p"}, when="r IS NOT NULL")])
    made = lambda *x: spark.createDataFrame(x, "d string, n int, t string, r string, p string")
    c = K.rows_to_claims(made(("a", 1, "x", "-0500", "y"), ("a", 2, "y", "-10000", "y"), ("a", 3, "z", "0100", "y"), ("b", 1, "x", "12000-01", "m"), ("b", 2, "y", "2001-05-06", "d"), ("c", 1, "x", None, None)), "d", [line])
    assert rows(H.earliest_sub_interval(c, "LINE", "FROM").select("doc_id", "to")) == [("a", "y"), ("b", "y"), ("c", "x")]


def test_affected_documents(spark):
    edge = "target string, source string"
    before = spark.createDataFrame([("t1", "s1"), ("t2", "s2"), ("v", "s3")], edge)
    now = spark.createDataFrame([("t1", "s1"), ("t3", "s2"), ("v", "s3")], edge)
    embedding = spark.createDataFrame([("x", "e1", ["NAME"]), ("x", "e2", ["OTHER"]), ("v", "e3", ["OTHER"])], "target string, embedder string, paths array<string>")
    changed, props, flipped = (spark.createDataFrame(r, k) for r, k in (([("x",)], "doc_id string"), ([("x", "NAME")], "doc_id string, prop string"), ([("v",)], "doc_id string")))
    assert rows(M.affected_docs(changed, now, before, embedding, props, flipped)) == [("e1",), ("e3",), ("s3",), ("t2",), ("t3",), ("x",)]


def test_specials_come_after_values_of_equal_count(spark):
    values = spark.createDataFrame([("z", 5), ("a", 5), ("b", 2)], "to string, docs long")
    paths = spark.createDataFrame([("z", ["z"]), ("a", ["z", "a"])], "id string, id_path array<string>")
    counts = spark.createDataFrame([(5, 0, 2, 2)], "has long, unknown long, none long, missing long")
    got = A.order_values(values, paths, specials=A.special_entries(counts)).orderBy("position").collect()
    assert [r.to for r in got] == ["z", "HAS", "a", "b", "NONE", "MISSING"]
    assert {r.to: r.paths for r in A.value_paths(values, paths).collect()} == {"z": [["z"]], "a": [["z", "a"]], "b": []}


def test_paths_below(spark):
    views = spark.createDataFrame([("main", 1, ["main"]), ("side", 1, ["side", "main"])], "view string, revision int, path array<string>")
    new = spark.createDataFrame([("leaf", "side"), ("lost", "nowhere")], "view string, parent string")
    assert rows(S.paths_below(views, new)) == [("leaf", ["leaf", "side", "main"])]
