"""Hard negatives against SQL and plain loops; intervals against exact scores."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tessella.llm import hard_negatives, queries

DIR = "/root/testdata/sf0.01"


def brute(rows, every=100, positives=5, negatives=10):
    """rows: (id, label, integers)."""
    out = []
    for i, (a, label, q) in enumerate(rows):
        if a % every:
            continue
        score = [(-sum(x * y for x, y in zip(q, v)), b, other) for j, (b, other, v) in enumerate(rows) if j != i]
        for s, p, _ in sorted(x[:2] + (0,) for x in score if x[2] == label)[:positives]:
            inside = sorted(x[:2] for x in score if x[2] != label and -30 * s <= -100 * x[0] <= -90 * s)
            out += [(a, p, k + 1, b, -s, -t) for k, (t, b) in enumerate(inside[:negatives])]
    return sorted(out)


def test_intervals_hold_scores():
    r = np.random.default_rng(2)
    for dims in (1, 3, 64, 100):
        vectors = np.concatenate([r.integers(-300, 300, (80, dims)), np.zeros((2, dims), int), r.integers(-3, 3, (20, dims))]).astype(np.int32)
        bits = hard_negatives._bits(dims)
        turn, v = hard_negatives.isometry(dims, bits), vectors.astype(float)
        ones = v @ turn.T > 0
        inside = (2.0 * ones - 1) @ turn / bits**0.5
        reach = np.sqrt((inside**2).sum(1))
        along = (v * inside).sum(1) / reach
        rest = np.sqrt(np.maximum((v**2).sum(1) - along**2, 0))
        code = np.packbits(ones, axis=1, bitorder="little")
        n = len(v)
        t = pa.table({"row": np.arange(n), "id": np.arange(n), "label": np.arange(n) % 3, "vector": [x.tobytes() for x in vectors], "code": [x.tobytes() for x in code], "reach": reach, "along": along, "rest": rest})
        codes = hard_negatives.Codes(t, dims)
        low, high = codes.intervals(vectors.astype(np.int64), turn)
        exact = vectors.astype(np.int64) @ vectors.T.astype(np.int64)
        assert (low <= exact).all() and (exact <= high).all()
        if dims >= 64:  # the bounds say something
            assert np.median((high - low)[:80, :80] / np.sqrt(np.outer((v[:80] ** 2).sum(1), (v[:80] ** 2).sum(1)))) < 0.9


@pytest.mark.parametrize("d", [DIR, "/root/testdata/sf0.1"])
def test_query_equals_sql(spark, d):
    got = sorted(map(tuple, queries.queries()["op11_hard_negatives"](spark, d).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet'")
    want = sorted(con.execute(queries.oracle_sql()["op11_hard_negatives"]).fetchall())
    assert got == want and len(got) > 100


def test_odd_rows_against_loops(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "SHARD", 2_000)
    monkeypatch.setattr(hard_negatives, "BLOCK", 1_500)
    r = random.Random(5)
    rows = [(i, r.randrange(3), [r.choice([-0.5, 0.0, 0.25, 0.5, 0.75]) for _ in range(6)]) for i in range(240)]
    rows += [(i, 1, [0.5] * 6) for i in range(240, 300)]  # ties
    rows += [rows[0], rows[0], rows[7], (100, 2, [0.5]), (500, 1, []), (600, 1, [0.0] * 6), (700, 9, [0.1] * 6), (800, 2, [1e6, -1e6] * 3)]
    out = [(1, None, [0.5] * 6), (None, 1, [0.5] * 6), (2, 1, None), (3, 1, [0.5, None]), (4, 1, [float("nan")] * 6), (5, 1, [float("inf")] * 6), (6, 1, [float("-inf")] * 6)]
    df = spark.createDataFrame(rows + out, "vec long, kind int, x array<float>").selectExpr("*", "1 AS id", "2 AS row", "'c' AS code", "3 AS label").repartition(3)
    got = sorted(map(tuple, hard_negatives.mine(df, "vec", "kind", "x").collect()))
    cut = lambda x: max(-(2**24), min(2**24, int(np.floor(256 * float(np.float32(x))))))
    plain = [(a, k, [cut(x) for x in v] + [0] * (6 - len(v))) for a, k, v in rows]
    assert got == brute(plain) and len({x[0] for x in got}) > 3


def test_few_or_no_rows(spark):
    empty = spark.createDataFrame([], "vec_id long, label string, embedding array<double>")
    assert hard_negatives.mine(empty, "vec_id", "label", "embedding").collect() == []
    one = spark.createDataFrame([(0, "a", [1.0])], empty.schema)
    assert hard_negatives.mine(one, "vec_id", "label", "embedding").collect() == []
    three = spark.createDataFrame([(0, "a", [1.0]), (1, "a", [1.0]), (2, "b", [0.5])], empty.schema)
    assert list(map(tuple, hard_negatives.mine(three, "vec_id", "label", "embedding").collect())) == [(0, 1, 1, 2, 65536, 32768)]
