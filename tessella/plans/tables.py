"""The driver's tables as claims. One spec for each table; its expressions are plain SQL, which Spark and DuckDB read alike."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessella.operators.claims import CLAIM, Field, VALUES, rows_to_claims

MONEY = "CAST(CAST({} AS DECIMAL(18, 2)) AS STRING)"
DAY = "CAST(CAST({} AS DATE) AS STRING)"


def _named(key: str, up: str | None = None) -> list[Field]:
    out = [Field("NAME", "string", {"str_value": f"{key}_name", "lang": "'en'"})]
    return [*out, Field("SUBENTITY", "ref", {"to": up})] if up else out


def _money(prop: str, column: str) -> Field:
    return Field(prop, "amount", {"raw": MONEY.format(column), "precision": "0.01D"})


SPECS: dict[str, tuple[str, list[Field]]] = {
    "region": ("'r:' || r_regionkey", _named("r")),
    "nation": ("'n:' || n_nationkey", _named("n", "'r:' || n_regionkey")),
    "customer": ("'c:' || c_custkey", [*_named("c", "'n:' || c_nationkey"), _money("BALANCE", "c_acctbal"), Field("CREDIT", "none", when="c_acctbal < 0"), Field("SEGMENT", "has", prop_sql="'SEGMENT_' || c_mktsegment")]),
    "supplier": ("'s:' || s_suppkey", [*_named("s", "'n:' || s_nationkey"), _money("BALANCE", "s_acctbal")]),
    "part": ("'p:' || p_partkey", [*_named("p"), Field("BRAND", "id", {"str_value": "p_brand"}), Field("TYPE", "string", {"str_value": "p_type", "lang": "'en'"}), Field("SIZE", "amount", {"raw": "CAST(p_size AS STRING)", "precision": "1.0D", "unit": "'CM'"}), _money("PRICE", "p_retailprice")]),
    "orders": ("'o:' || o_orderkey", [
        Field("CUSTOMER", "ref", {"to": "'c:' || o_custkey"}), _money("TOTAL", "o_totalprice"), Field("ORDERED", "time", {"raw": DAY.format("o_orderdate"), "time_precision": "'d'"}),
        Field("STATUS", "has", prop_sql="'STATUS_' || o_orderstatus"), Field("PRIORITY", "unknown", when="o_orderpriority = '4-NOT SPECIFIED'"),
        Field("PRIORITY", "string", {"str_value": "o_orderpriority", "lang": "'en'"}, when="o_orderpriority <> '4-NOT SPECIFIED'", key="'s'"),
    ]),
    "lineitem": ("'o:' || l_orderkey", [Field(
        "LINE", "ref", {"to": "'p:' || l_partkey"}, ord="l_linenumber", key="l_partkey || '/' || l_suppkey || '/' || CAST(CAST(l_shipdate AS DATE) AS STRING) || '/' || CAST(CAST(l_extendedprice AS DECIMAL(18, 2)) AS STRING)", confidence="1.0D - 5 * l_discount",
        subs=[
            Field("SUPPLIER", "ref", {"to": "'s:' || l_suppkey"}), Field("QUANTITY", "amount", {"raw": "CAST(CAST(l_quantity AS BIGINT) AS STRING)", "precision": "1.0D"}),
            Field("SHIPPED", "time", {"raw": DAY.format("l_shipdate"), "time_precision": "'d'"}), Field("RETURNED", "has", when="l_returnflag = 'R'"),
        ],
    )]),
    "shipments": ("'s:' || l_suppkey", [Field(
        "SHIPMENT", "string", {"str_value": "CAST(l_linenumber AS STRING)", "lang": "'en'"}, ord="l_linenumber", key="l_orderkey || '/' || l_partkey || '/' || CAST(CAST(l_shipdate AS DATE) AS STRING) || '/' || CAST(CAST(l_extendedprice AS DECIMAL(18, 2)) AS STRING)",
        subs=[Field("STATE", "string", {"str_value": "l_linestatus"}, confidence="1.0D - 5 * l_discount", subs=[Field("FLAG", "has", prop_sql="'FLAG_' || l_returnflag", subs=[
            Field("QUANTITY", "amount", {"raw": "CAST(CAST(l_quantity AS BIGINT) AS STRING)", "precision": "1.0D"}),
        ])])],
    )]),
    "dossiers": ("'o:' || o_orderkey", [
        Field("CODE", "id", {"str_value": "'a' || o_custkey || CASE WHEN o_orderkey % 3 = 0 THEN ' x' || (o_orderkey % 5) ELSE '' END"}),
        Field("SITE", "link", {"str_value": "'http://h/' || (o_custkey % 400)"}), Field("TITLE", "string", {"str_value": "o_orderpriority || CASE WHEN o_orderkey % 11 = 0 THEN 'x' ELSE '' END", "lang": "'en'"}),
        Field("BODY", "html", {"str_value": "'<p>' || o_orderpriority || '</p> ' || CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE '' END"}),
        Field("CUSTOMER", "ref", {"to": "CASE WHEN o_orderkey % 20 = 0 THEN 'n:' || (o_orderkey % 25) ELSE 'c:' || o_custkey END"}),
        Field("TOTAL", "amount", {"raw": "CAST(CAST(floor(o_totalprice / 1000) * 1000 AS BIGINT) AS STRING)", "precision": "CASE WHEN o_orderkey % 7 = 0 THEN 10000.0D ELSE 1000.0D END"}),
        Field("ORDERED", "time", {"raw": "CASE WHEN o_orderkey % 9 = 0 THEN substr(" + DAY.format("o_orderdate") + ", 1, 7) ELSE " + DAY.format("o_orderdate") + " END", "time_precision": "CASE WHEN o_orderkey % 9 = 0 THEN 'm' ELSE 'd' END"}),
        Field("STATUS", "has", prop_sql="'STATUS_' || o_orderstatus"), Field("DISTINCT_FROM", "ref", {"to": "'o:' || (o_orderkey + 7)"}, when="o_orderkey % 10 = 3 OR o_orderkey % 50 = 0"),
    ]),
    "documents": ("'d:' || doc_id", [Field("BODY", "string", {"str_value": "text", "lang": "lang"})]),
    "pages": ("'g:' || page_id", [Field("BODY", "html", {"str_value": "html"}), Field("URL", "link", {"str_value": "url"})]),
    "benchmark": ("'b:' || item_id", [Field("BODY", "string", {"str_value": "text"})]),
}


#: Tables of specs that are not named like their table.
TABLES = {"shipments": "lineitem", "dossiers": "orders"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pruned(fields: list[Field], only: set[str]) -> list[Field]:
    """The fields of the properties, and those above them. A property that is made by SQL is known by the text that it starts with."""
    out = []
    for f in fields:
        subs = pruned(f.subs, only)
        named = f.prop in only if f.prop_sql is None else any(p.startswith(f.prop_sql.split("'")[1]) for p in only)
        if named or subs:
            out.append(replace(f, subs=subs))
    return out


def levels(*names: str) -> int:
    """How many levels of claims the tables' specs have."""
    def below(fields: list[Field]) -> int:
        return max((1 + below(f.subs) for f in fields), default=0)
    return max(below(SPECS[n][1]) for n in names)


def types(fields: list[Field]) -> set[str]:
    return {t for f in fields for t in (f.type, *types(f.subs))}


def claims(spark: SparkSession, sf_dir: str, *names: str, floor: float | None = None, only: set[str] | None = None, top: bool = False) -> DataFrame:
    """The claims of the named tables; with a floor those at it or above, below claims that are so too; with only, those of these
    properties and of the ones above them; with top, those of documents alone: what else the tables hold is not even made."""
    out = None
    for name in names:
        doc, fields = SPECS[name]
        if only is not None and not (fields := pruned(fields, only)):
            continue
        fields = [replace(f, subs=[]) for f in fields] if top else fields
        part = rows_to_claims(table(spark, sf_dir, TABLES.get(name, name)), doc, fields, floor)
        out = part if out is None else out.unionByName(part)
    return out


def claims_sql(*names: str) -> str:
    """A DuckDB query with the rows of claims()."""
    def one(name: str, doc: str, f: Field, base: str | None, up: str, depth: int, on: str) -> list[str]:
        prop = f.prop_sql or f"'{f.prop}'"
        parent = f"left(sha256({base}), 22)" if base else "NULL"
        here = f"{base or doc} || chr(0) || {prop} || chr(0) || {f.key} || chr(0) || {f.ord}"
        when = f"{on} AND {f.when}"
        made = {"doc_id": doc, "claim_id": f"left(sha256({here}), 22)", "parent_claim_id": parent, "parent_prop": up, "depth": str(depth), "ord": f.ord, "type": f"'{f.type}'", "prop": prop, "confidence": f.confidence.replace("D", ""), **{v: f.values.get(v, "NULL").replace("1D", "1").replace("0D", "0") for v in VALUES}}
        kind = {"string": "VARCHAR", "int": "INT", "double": "DOUBLE"}
        row = ", ".join(f'CAST({made[c]} AS {kind[k]}) AS "{c}"' for c, k in CLAIM.items())
        return [f"SELECT {row} FROM {TABLES.get(name, name)} WHERE {when}", *[x for s in f.subs for x in one(name, doc, s, here, prop, depth + 1, when)]]

    return " UNION ALL ".join(x for name in names for f in SPECS[name][1] for x in one(name, SPECS[name][0], f, None, "NULL", 0, "true"))


def fixed(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small constant table."""
    return spark.createDataFrame(rows, schema)
