"""Sessions as a stream and as a whole log; the bucketed index: replays, touched buckets, old versions, rendering anew."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tessella.streaming import maintenance as M, sessions

OPS = "session string, seq long, at timestamp, kind string, expected long, data string"


def plain(ops, idle=None, implicit=True, now=None):
    """The rules, one operation after the other."""
    out, state = [], {}
    for s, seq, at, kind, expected, data in sorted(ops, key=lambda o: o[1]):
        phase, last, seen = state.get(s, ("open" if implicit else None, 0, None))
        if idle is not None and phase == "open" and seen is not None and at - seen > idle:
            out.append((s, None, "expire", None, "accepted", None))
            phase = "expired"
        number, status, reason = None, "accepted", None
        if kind == "begin":
            if phase is None:
                phase = "open"
            else:
                status, reason = "rejected", "already begun"
        elif phase is None:
            status, reason = "rejected", "not found"
        elif kind in ("append", "end") and phase != "open":
            status, reason = "rejected", "already ended"
        elif kind == "append":
            if expected in (None, last + 1):
                number = last = last + 1
            else:
                status, reason = "conflict", f"next is {last + 1}"
        elif kind == "end":
            phase = "ended"
        elif kind == "complete" and phase == "complete":
            status, reason = "rejected", "already completed"
        elif kind == "complete" and phase == "open":
            status, reason = "rejected", "not ended"
        elif kind == "complete":
            phase = "complete"
        else:
            status, reason = "rejected", "unknown kind"
        state[s] = (phase, last, at if seen is None else max(at, seen))
        out.append((s, number, kind, data, status, reason))
    if idle is not None and now is not None:
        out += [(s, None, "expire", None, "accepted", None) for s, (phase, _, seen) in state.items() if phase == "open" and now - seen > idle]
    return sorted(out, key=repr)


def log(seed, n=160):
    r = random.Random(seed)
    at, rows = 1_000_000.0, []
    for seq in range(n):
        at += r.choice([1, 5, 30, 200])
        rows.append((f"s{r.randrange(12)}", seq, at, r.choices(["begin", "append", "end", "complete", "odd"], [3, 12, 2, 2, 1])[0], r.choice([None, 1, 1, 2, 2, 3, 4]), f"d{seq}"))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "session string, seq long, at double, kind string, expected long, data string").withColumn("at", F.timestamp_seconds("at"))


@pytest.mark.parametrize("idle,implicit", [(None, True), (300.0, False), (100.0, True)])
def test_fates_of_a_log(spark, idle, implicit):
    rows = log(4)
    got = sessions.session_fates(frame(spark, rows), idle, implicit, now=None if idle is None else rows[-1][2] + 50)
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows, idle, implicit, rows[-1][2] + 50)
    assert sessions.session_fates(frame(spark, rows).limit(0), idle, implicit).collect() == []


def run(spark, tmp_path, name, idle, implicit):
    stream = spark.readStream.schema(OPS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "ops"))
    out = sessions.session_stream(stream, idle, implicit, "0 seconds")
    out.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"at-{name}")).trigger(availableNow=True).start().awaitTermination(300)


def test_stream_expires_restarts_and_equals_the_log(spark, tmp_path):
    rows = log(9, 90)
    late = ("clock", 10_000, rows[-1][2] + 5_000.0, "begin", None, None)
    last = ("clock", 10_001, rows[-1][2] + 5_001.0, "append", None, "x")
    for part in (rows[:40], rows[40:], [late]):
        frame(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "ops"))
    run(spark, tmp_path, "out", 300.0, False)
    frame(spark, [last]).coalesce(1).write.mode("append").parquet(str(tmp_path / "ops"))
    run(spark, tmp_path, "out", 300.0, False)  # goes on where it stopped
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=repr)
    want = plain([*rows, late, last], 300.0, False, late[2])
    assert got == want and [x for x in got if x[2] == "expire"] and sum(x[4] == "conflict" for x in got) >= 2


def changes(rows):
    return "doc_id string, seq long, deleted boolean, value double", rows


def folders(path):
    return sorted(f"{v}/{b}" for v in os.listdir(path / "data") for b in os.listdir(path / "data" / v) if b.startswith("bucket="))


def test_batches_touch_their_buckets_only(spark, tmp_path):
    out = tmp_path / "index"
    make = lambda rows: spark.createDataFrame(rows, "doc_id string, seq long, deleted boolean, value double")
    truth = {}
    r = random.Random(2)
    for n in range(8):
        docs = [f"d{i}" for i in range(60)] if n == 0 else r.sample([f"d{i}" for i in range(70)], 3)
        rows = [(d, 100 * n + i, r.random() < 0.2, r.random()) for i, d in enumerate(docs)]
        rows += [("d1", 5 if n else 1, False, -1.0)] if n else []  # a late write changes nothing
        for x in rows:
            if x[1] >= truth.get(x[0], (0, -1))[1]:
                truth[x[0]] = x
        touched = M.merge_batch(spark, str(out), n, make(rows), buckets=16)
        assert len(touched) <= len({x[0] for x in rows})
        assert {f for f in folders(out) if f.startswith(f"v{n}/")} == {f"v{n}/bucket={b}" for b in touched}
        if n in (0, 3):  # the batch runs again, as after a failure
            before = M.manifests(spark, str(out))
            M.merge_batch(spark, str(out), n, make(rows), buckets=16)
            assert M.manifests(spark, str(out)) == before
        assert sorted(map(tuple, M.current(spark, str(out)).collect())) == sorted(truth.values())
    kept = M.manifests(spark, str(out))
    assert sorted(kept) == [5, 6, 7]
    assert folders(out) == sorted({f"v{v}/bucket={b}" for m in kept.values() for b, v in m.items()})
    some = M.current(spark, str(out), [3, 4]).select(M.bucket_of("doc_id", 16).alias("b")).distinct()
    assert {x.b for x in some.collect()} <= {3, 4}
    assert M.merge_batch(spark, str(out), 8, make([]), buckets=16) == [] and M.current(spark, str(out)).count() == len(truth)
    assert M.current(spark, str(tmp_path / "none")) is None
    # an unpublished batch is not seen
    spark.range(1).write.parquet(str(out / "data" / "v99" / "bucket=0"))
    assert M.current(spark, str(out)).count() == len(truth)


def test_several_rows_a_document_and_rendering(spark, tmp_path):
    out = str(tmp_path / "index")
    base = spark.createDataFrame([("a", 1, False, "x y"), ("b", 1, False, "z")], "doc_id string, seq long, deleted boolean, text string")
    words = lambda df: df.select("doc_id", "seq", "deleted", F.explode(F.split("text", " ")).alias("text"))
    M.merge_batch(spark, out, 0, words(base), buckets=4)
    M.merge_batch(spark, out, 1, words(spark.createDataFrame([("a", 2, False, "q")], base.schema)), buckets=4)
    assert sorted((x.doc_id, x.text) for x in M.current(spark, out).collect()) == [("a", "q"), ("b", "z")]
    M.rerender(spark, out, lambda df: df.withColumn("text", F.upper("text")), 2, group=1, buckets=4)
    assert sorted((x.doc_id, x.seq, x.text) for x in M.current(spark, out).collect()) == [("a", 2, "Q"), ("b", 1, "Z")]
