"""What larger tables bring up: halves that round to even, and joins of claims that must not be sent whole to every task."""

import re

import duckdb
import pytest

from tessella.operators import duplicates as J
from tessella.plans import catalog

DIR = "/root/testdata/sf0.001"


def test_halves_of_chunk_lengths_round_as_in_sql(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT i % 3 AS user_id, i AS event_id, (i % 60 - 0.5)::DOUBLE AS value FROM range(1, 400) t(i)) TO '{tmp_path}/events.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = sorted(con.execute(catalog.oracle_sql()["chunk_coverage"]).fetchall())
    assert sorted(map(tuple, catalog.queries()["chunk_coverage"](spark, str(tmp_path)).collect())) == want


@pytest.mark.parametrize("name", ["claim_grants", "match_paths", "sort_min_max"])
def test_joins_of_claims_are_shuffled(spark, name):
    """Spark takes claims for small tables; at size each of them would be sent whole through the driver."""
    plan = catalog.queries()[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_bodies_agree_without_a_copy_for_each_token(spark, tmp_path):
    """A text meets what asks for it once: rows that carry whole texts must not be made for each of their tokens."""
    words = "concat_ws(' ', transform(sequence(1, 300), i -> 'w' || (i + id * 7)))"
    b = spark.range(40).selectExpr("'d' || id AS id", f"split({words}, ' ') AS tokens")
    a = spark.createDataFrame([("x", ["w150", "w200"]), ("y", ["w5", "w900"]), ("z", [])], "id string, tokens array<string>")
    out = J.body_agreement(a, b)
    want = sorted(("x", f"d{k}") for k in range(40) if 1 <= 150 - 7 * k and 200 - 7 * k <= 300)
    assert want and sorted(map(tuple, out.collect())) == want
    made = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate explode" in line]
    # each explode names the columns that it drops: the list of tokens itself
    assert made and all(re.search(r"\), \[[0-9]", line) for line in made)
    twice = J.body_agreement(a, b.unionByName(b))
    assert sorted(map(tuple, twice.collect())) == sorted(want * 2)
