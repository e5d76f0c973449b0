"""Files, exports to disk and the session stream."""

import json

import pytest
from pyspark.sql import functions as F, types as T

from tessella.sources import io as X
from tessella.streaming import maintenance as M, sessions

SCHEMA = T.StructType().add("id", "string").add("name", "string")


def test_read_documents(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "x.json").write_text(json.dumps({"id": "1", "name": "one"}))
    (tmp_path / "a" / "b" / "y.json").write_text(json.dumps({"id": "2"}, indent=1))
    (tmp_path / "a" / "z.txt").write_text("no document")
    assert sorted((r.id, r.name) for r in X.read_documents(spark, str(tmp_path / "a"), SCHEMA).collect()) == [("1", "one"), ("2", None)]
    assert X.read_documents(spark, str(tmp_path / "none"), SCHEMA).count() == 0
    (tmp_path / "a" / "w.json").write_text(json.dumps({"id": "3", "odd": 1}))
    with pytest.raises(ValueError, match="odd"):
        X.read_documents(spark, str(tmp_path / "a"), SCHEMA)


def test_file_inventory(spark, tmp_path):
    for name, data in (("a", b"x"), ("b", b"x"), ("c", b"y")):
        (tmp_path / name).write_bytes(data)
    rows = {r.path[-1]: r for r in X.file_inventory(spark, str(tmp_path)).collect()}
    assert rows["a"].hash == rows["b"].hash != rows["c"].hash and [rows[n].first for n in "abc"] == [True, False, True]


def test_chunk_coverage(spark):
    chunks = spark.createDataFrame([("gap", 1, 0, 4), ("gap", 2, 6, 4), ("over", 1, 0, 12), ("short", 1, 0, 5), ("twice", 1, 0, 10), ("twice", 2, 0, 10)], "session string, chunk long, start long, length long")
    files = chunks.select("session", F.lit(10).cast("long").alias("size")).distinct()
    got = {r.session: (r.gaps, r.overrun, r.short, r.redundant) for r in X.chunk_coverage(chunks, files).collect()}
    assert got == {"gap": (1, False, False, 0), "over": (0, True, False, 0), "short": (0, False, True, 0), "twice": (0, False, False, 1)}


def test_sessions(spark, tmp_path):
    ops = spark.createDataFrame([("s", 1, "append", "a"), ("s", 1, "append", "stale"), ("s", 2, "append", "b"), ("s", 3, "end", None), ("s", 4, "append", "late"), ("s", 5, "complete", None)], "session string, expected long, kind string, data string")
    ops.coalesce(1).write.parquet(str(tmp_path / "ops"))
    out = sessions.session_stream(spark.readStream.schema(ops.schema).parquet(str(tmp_path / "ops")))
    query = out.writeStream.format("memory").queryName("fates").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    rows = [(r.kind, r.data, r.operation, r.status) for r in spark.table("fates").collect()]
    assert [r[3] for r in rows] == ["accepted", "conflict", "accepted", "accepted", "rejected", "accepted"]
    assert [r[2] for r in rows if r[0] == "append"] == [1, None, 2, None]


def test_late_writes_stream(spark, tmp_path):
    rows = spark.sql("SELECT 'd' AS doc_id, 1L AS seq, TIMESTAMP '2024-01-01' AS at UNION ALL SELECT 'd', 1L, TIMESTAMP '2024-01-01 05:00:00'")
    rows.coalesce(1).write.parquet(str(tmp_path / "w"))
    out = M.late_writes(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "w")))
    query = out.writeStream.format("memory").queryName("writes").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("writes").count() == 1


def test_nested_export_keeps_every_level(spark):
    rows = [
        ("d", "a", None, 0, 2, "P", 'say "hi"'), ("d", "b", None, 0, 1, "P", None), ("d", "c", "a", 1, 0, "Q", "x"), ("d", "e", "c", 2, 0, "R", "y"), ("d", "f", "e", 3, 1, "S", "2"), ("d", "g", "e", 3, 0, "S", "1"),
        ("d", "h", "a", 1, 0, "A", "z"), ("o", "i", None, 0, 0, 'odd"p', "v"),
    ]
    df = spark.createDataFrame(rows, "doc_id string, claim_id string, parent_claim_id string, depth int, ord int, prop string, str_value string")
    df = df.selectExpr("*", "CAST(NULL AS STRING) AS raw", "CAST(NULL AS STRING) AS to", "'has' AS type")
    got = {r.doc_id: json.loads(r.value) for r in X.export_nested(df).collect()}
    deep = {"value": "y", "sub": {"S": [{"value": "1"}, {"value": "2"}]}}
    assert got["d"] == {"P": [{"value": "HAS"}, {"value": 'say "hi"', "sub": {"A": [{"value": "z"}], "Q": [{"value": "x", "sub": {"R": [deep]}}]}}]}
    assert got["o"] == {'odd"p': [{"value": "v"}]} and X.export_nested(df.limit(0)).collect() == []


def test_exports_of_paths_below_three_levels(spark):
    rows = [("d", f"c{i}", f"c{i - 1}" if i else None, i, 0, f"P{i}", f"v{i}") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id string, claim_id string, parent_claim_id string, depth int, ord int, prop string, str_value string")
    df = df.selectExpr("*", "CAST(NULL AS STRING) AS raw", "CAST(NULL AS STRING) AS to", "'string' AS type")
    assert json.loads(X.export_jsonl(df, ["**.P4", "P0.P1"]).first().value) == {"P0.P1": ["v1"], "P0.P1.P2.P3.P4": ["v4"]}
    assert X.export_csv(df, ["**"]).first()["P0.P1.P2.P3"] == "v3"


def test_each_row_is_a_file_and_files_are_opened_once(spark, tmp_path):
    rows = spark.range(40).selectExpr("CAST(id AS string) AS id", "CAST(NULL AS string) AS name").coalesce(1)
    X.write_files(rows, str(tmp_path / "a"), parts=8)
    names = [p.name for p in (tmp_path / "a").rglob("part-*.json")]
    # dealt over tasks: one task would write all files of a small table
    assert len(names) == 40 and len({n.split("-")[1] for n in names}) == 8
    (tmp_path / "a" / "more.json").write_text('[{"id": "x"}, {"id": "y", "name": "n"}]')
    (tmp_path / "a" / "none.json").write_text("")
    (tmp_path / "a" / "mark.json").write_text('﻿{"id": "z"}')
    docs = X.read_documents(spark, str(tmp_path / "a"), SCHEMA)
    X.file_inventory(spark, str(tmp_path / "a"))
    for p in (tmp_path / "a").rglob("*.json"):
        p.unlink()
    assert sorted(r.id for r in docs.collect()) == sorted([*map(str, range(40)), "x", "y", "z"])
    (tmp_path / "a" / "bad.json").write_text('{"id": ')
    with pytest.raises(Exception, match="(?i)malformed"):
        X.read_documents(spark, str(tmp_path / "a"), SCHEMA).collect()


def test_nested_exports_shuffle_claims_once(spark):
    rows = [("a", "1", None, 0, "P", 0, "x"), ("a", "2", "1", 1, "Q", 0, "y"), ("a", "3", "2", 2, "R", 1, "z"), ("a", "4", "2", 2, "R", 0, None), ("a", "5", "9", 1, "Q", 0, "lost"), ("b", "6", None, 0, 'p"', 0, "w")]
    df = spark.createDataFrame(rows, "doc_id string, claim_id string, parent_claim_id string, depth int, prop string, ord int, str_value string")
    df = df.select("*", F.lit(None).cast("string").alias("raw"), F.lit(None).cast("string").alias("to"), F.lit("has").alias("type"))
    out = X.export_nested(df)
    assert {r.doc_id: r.value for r in out.collect()} == {"a": '{"P":[{"sub":{"Q":[{"sub":{"R":[{"value":"HAS"},{"value":"z"}]},"value":"y"}]},"value":"x"}]}', "b": '{"p\\"":[{"value":"w"}]}'}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1 and "Join" not in plan
