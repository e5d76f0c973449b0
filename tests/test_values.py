"""Values, folding, tokens, hierarchies with diamonds and cycles, incremental upkeep."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tessella.functions import text as T, values as V
from tessella.operators import hierarchy as H
from tessella.plans import catalog
from tessella.streaming import maintenance as M


def test_amounts(spark):
    df = spark.createDataFrame([("3,14", 0.01), ("180", 60.0), ("4.0", 0.5), ("x", 1.0), ("1.5", 1.0)], "raw string, precision double")
    got = {r.raw: (r.value, r.error) for r in V.parse_amounts(df).collect()}
    assert got["3,14"][0] == pytest.approx(3.14) and got["180"] == (180.0, None) and got["4.0"] == (4.0, None)
    assert got["x"][1] == "not a number" and got["1.5"][1] == "not a multiple"


@pytest.mark.parametrize("raw,precision,lo,hi", [("1970-01-01", "d", 0.0, 86400.0), ("1970-02", "m", 31 * 86400.0, 59 * 86400.0), ("1972", "y", 730 * 86400.0, 1096 * 86400.0), ("0000", "y", -62167219200.0, -62135596800.0)])
def test_times(raw, precision, lo, hi):
    assert V._time(raw, precision)[2:4] == (lo, hi)


@pytest.mark.parametrize("raw,precision,error", [("1970-13", "m", "out of range"), ("1970", "d", "too few parts"), ("1970-02", "y", "too many parts"), ("soon", "d", "not a time"), ("1970", "week", "bad precision")])
def test_bad_times(raw, precision, error):
    assert V._time(raw, precision)[0] == error


def test_deep_time_is_widened():
    _, seconds, lo, hi, _ = V._time("-13800000000", "1Gy")
    assert lo < seconds < hi


@pytest.mark.parametrize("text,want", [("STRASSE", "strasse"), ("Máos", "maos"), ("čšž", "csz"), ("øđłħ", "odlh"), ("æ", "ae"), ("x²", "x2"), ("Ⅸ", "ix"), ("٣٤", "34"), ("a—b", "a-b")])
def test_fold(text, want):
    assert T._fold(text) == want


def test_tokens(spark):
    cases = {"  has,  property! ": ["has", "property"], "don't": ["don't"], "3.14": ["3.14"], "U.S.A.": ["U.S.A"], "中文": ["中", "文"]}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.x for r in df.select("t", T.tokens(F.col("t")).alias("x")).collect()} == cases


def test_diamond_and_cycle(spark):
    e = spark.createDataFrame([("leaf", "a"), ("leaf", "b"), ("a", "root"), ("b", "root"), ("x", "y"), ("y", "x")], "id string, parent string")
    paths = H.id_paths(e, spark.createDataFrame([("leaf",), ("x",)], "id string")).collect()
    assert sorted(r.id_path for r in paths if r.id == "leaf") == [["root", "a", "leaf"], ["root", "b", "leaf"]]
    assert all(len(r.id_path) <= 2 for r in paths if r.id == "x")
    up = {(r.id, r.ancestor): r.min_depth for r in H.value_ancestors(e).collect()}
    assert up[("leaf", "root")] == 2 and ("x", "y") in up and ("x", "x") not in up


def test_first_paths_of_wide_diamonds(spark):
    layers = [["root"], list("abcdef"), [f"m{i}" for i in range(6)], [f"n{i}" for i in range(5)], ["leaf"]]
    pairs = [(x, y) for above, below in zip(layers, layers[1:]) for x in below for y in above] + [("leaf", "a"), ("m0", "root"), ("n1", "c"), ("a", "other"), ("leaf", "leaf")]
    up = {}
    for x, y in pairs:
        if x != y:
            up.setdefault(x, []).append(y)

    def every(x):
        return [[*p, x] for y in up[x] for p in every(y)] if x in up else [[x]]

    e = spark.createDataFrame(pairs, "id string, parent string")
    for cap in (1, 7, 100, 1000):
        got = H.id_paths(e, spark.createDataFrame([("leaf",), ("n1",), ("root",), ("elsewhere",)], "id string"), cap).collect()
        for x in ("leaf", "n1", "root", "elsewhere"):
            assert sorted(r.id_path for r in got if r.id == x) == sorted(every(x))[:cap]
    assert len(every("leaf")) > 200


def test_children_in_stated_order(spark):
    e = spark.createDataFrame([("b", "r"), ("a", "r"), ("c", "r"), ("d", "r"), ("a", "q"), ("r", "r"), ("a", "r")], "id string, parent string")
    o = spark.createDataFrame([("c", 1.0), ("b", 2.0), ("b", 0.5)], "id string, order double")
    assert sorted(map(tuple, H.ordered_children(e, o).collect())) == [("q", "a", 1), ("r", "a", 3), ("r", "b", 1), ("r", "c", 2), ("r", "d", 4)]
    assert H.ordered_children(e.limit(0), o).collect() == []


def test_stream_equals_rebuild(spark, tmp_path):
    rows = [(f"d{i % 7}", i, i % 11 == 0, float(i)) for i in range(60)]
    log = spark.createDataFrame(rows, "doc_id string, seq long, deleted boolean, value double")
    for k in range(3):
        log.where(F.col("seq") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    double = lambda df: df.withColumn("value", F.col("value") * 2)
    M.index_stream(spark, str(tmp_path / "log"), str(tmp_path / "out"), double, str(tmp_path / "at")).awaitTermination(120)
    got = sorted(map(tuple, M.current(spark, str(tmp_path / "out")).collect()))
    assert got == sorted(map(tuple, M.rebuild_index(log, double).collect()))


def test_late_write_does_not_revive(spark):
    old = spark.createDataFrame([("d", 10, True)], "doc_id string, seq long, deleted boolean")
    late = spark.createDataFrame([("d", 8, False)], "doc_id string, seq long, deleted boolean")
    assert M.versioned_upsert(old, late).first().deleted


def test_page_data_of_structured_pages(spark):
    page = '<html><script type="application/ld+json">{"@type": "Person"}</script><p class="a-x b">t</p><SCRIPT id="s" type="application/ld+json">\n[1]\n</SCRIPT><script>var x</script><article class="a-y">'
    df = spark.createDataFrame([(1, page), (2, None), (3, "<p>none</p>")], "page_id int, html string")
    got = {r.page_id: r for r in T.extract_page_data(df, ["article", "video"], "a-").collect()}
    assert got[1].page_json == ['{"@type": "Person"}', "\n[1]\n"] and got[1].class_values == ["a-x", "a-y"] and got[1].has_article and not got[1].has_video
    assert got[2].page_json is None and got[3].page_json == [] and got[3].class_values == []


def test_intervals_of_odd_rows_are_those_of_their_sql(spark, tmp_path):
    """Lines without a quantity, a line number or a known flag; where the line number is there, quantities that are no number."""
    rows = [(i, flag, q, n) for i, (flag, q, n) in enumerate((f, q, n) for f in ("N", "R", "A", "X", None) for q in (None, 7.0, float("nan"), -2.0) for n in (None, 1, 3) if n or q == q)]
    spark.createDataFrame(rows, "l_orderkey long, l_returnflag string, l_quantity double, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    con.execute(f"CREATE TABLE want AS {catalog.oracle_sql()['interval_windows']}")
    catalog.queries()["interval_windows"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/got")
    got = f"SELECT doc_id, lo, hi, hi_incl, kind FROM '{tmp_path}/got/*.parquet'"
    for a, b in (("FROM want", got), (got, "FROM want")):
        assert con.execute(f"{a} EXCEPT ALL {b}").fetchall() == []
