"""All registered queries of the claims engine, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.operators import facets as A, filters as P
from tessella.plans.q_search import order_records, orders
from tessella.plans import q_claims, q_io, q_search, q_store, q_text

MODULES = [q_claims, q_io, q_search, q_store, q_text]


def entry(spark: SparkSession, sf_dir: str = "/root/testdata/sf0.001") -> DataFrame:
    """Orders by customers of one region with a line of some suppliers shipped in a year, on that same line; the facet of the
    values that these orders' customers belong to, with counts and direct entries."""
    rows = order_records(spark, sf_dir, "lineitem")
    found = P.apply_filters(orders(spark, sf_dir), rows, [P.to("CUSTOMER", "r:2"), P.to("SUPPLIER", "s:1", "s:2", "s:3", parent="LINE"), P.time("SHIPPED", 788918400, 915148799, parent="LINE")])
    return A.ref_values(rows.join(found, "doc_id", "left_semi"), "CUSTOMER")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
