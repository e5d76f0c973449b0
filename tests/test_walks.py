"""Walks over the levels of claims shuffle each claim once, by document, and write nothing between levels."""

import os

import pytest

from tessella.operators import claims as C
from tessella.plans import catalog
from tessella.plans.tables import claims
from tessella.sources.settle import shared_dir

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["claims_equivalent_deep", "duplicate_claims_deep", "claim_signatures_deep", "confident_levels", "match_paths_deep", "claims_flatten"])
def test_levels_are_walked_without_joins_or_files(spark, name):
    folder = shared_dir(spark).removeprefix("file:")
    before = os.listdir(folder)
    df = catalog.queries()[name](spark, DIR)
    assert df.count() > 0 and os.listdir(folder) == before
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()


def test_facets_are_discovered_without_joins_or_files(spark):
    folder = shared_dir(spark).removeprefix("file:")
    before = os.listdir(folder)
    df = catalog.queries()["discover_facets"](spark, DIR)
    assert df.count() == 8 and os.listdir(folder) == before
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()


def test_ids_move_as_bytes_and_come_back(spark):
    ids = ["", "0", "0a", "0a1", "00", "000", "0A", "xyz", "é", "3f" * 11, "3f" * 11 + "b", None]
    df = spark.createDataFrame([(x,) for x in ids], "id string").withColumn("id", C._short("id"))
    assert df.distinct().count() == len(ids) and len(df.where("length(id) = 12").collect()) == 1
    assert [r.id for r in df.select(C._long("id").alias("id")).collect()] == ids


def test_nested_claims_are_read_once(spark):
    shown = catalog.queries()["claims_flatten"](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert shown.count("RepartitionByExpression") == 1


def test_claims_that_nothing_lies_below_move_without_an_id(spark):
    rows = C.claim_signature(claims(spark, DIR, "shipments"), levels=4, top=True)
    shown = rows._jdf.queryExecution().executedPlan().toString()
    assert rows.where("depth > 0").isEmpty() and rows.where("claim_id IS NULL").isEmpty()
    every = C.claim_signature(claims(spark, DIR, "shipments"), levels=4).where("depth = 0")
    assert rows.exceptAll(every).isEmpty() and every.exceptAll(rows).isEmpty() and "depth#" in shown
