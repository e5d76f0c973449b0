"""Registered queries against their SQL in DuckDB at sf0.001: a few of each module, all with ALL_QUERIES=1."""

import os

import duckdb
import pytest

from tessella.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FEW = ["best_claim", "confident_subtree", "interval_windows", "filter_and_or", "correlated_lines", "sub_missing_group", "ref_values", "histogram_amount", "group_cap", "reference_counts", "snapshot", "replay_patches", "readable_roles", "strip_html", "bm25", "duplicates_all", "export_csv", "late_writes"]


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v if v is None or isinstance(v, (str, int, bool)) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def test_every_oracle_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()) if os.environ.get("ALL_QUERIES") else FEW)
def test_query_matches_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    cursor = duck.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cursor.fetchall()), key=repr)
    assert got == want
