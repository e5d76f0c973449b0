"""Queries that select by key, against their SQL on tables whose keys lie above those of the given ones."""

import duckdb
import pytest

from tessella.plans import catalog

DIR = "/root/testdata/sf0.001"
UP = {"lineitem": ["l_suppkey", "l_partkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"]}


@pytest.mark.parametrize("name", ["correlated_lines", "parent_constraint"])
def test_keys_above_the_given_tables(spark, tmp_path, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        up = ", ".join(f"{c} + 1000000 AS {c}" for c in UP.get(t, []))
        con.execute(f"COPY (SELECT * {f'REPLACE ({up})' if up else ''} FROM '{DIR}/{t}.parquet') TO '{tmp_path}/{t}.parquet'")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    want = sorted(con.execute(catalog.oracle_sql()[name]).fetchall())
    assert want and sorted(map(tuple, catalog.queries()[name](spark, str(tmp_path)).collect())) == want
