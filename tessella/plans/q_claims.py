"""Queries of claims and values, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import values as V
from tessella.operators import claims as K, edges as E
from tessella.plans.tables import claims, claims_sql, fixed, levels, table

C = {n: f"WITH c AS MATERIALIZED ({claims_sql(*n.split('_'))}) " for n in ("orders_lineitem", "lineitem", "orders", "customer", "part", "documents", "shipments", "customer_nation_region")}
Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return add


@query(C["orders_lineitem"] + "SELECT * FROM c")
def claims_flatten(s, d):
    return K.explode_claims(K.nest_claims(claims(s, d, "orders", "lineitem")))


@query(C["orders_lineitem"] + "SELECT * FROM c")
def rows_to_claims(s, d):
    return claims(s, d, "orders", "lineitem")


@query(C["lineitem"] + "SELECT doc_id, claim_id, \"to\", confidence FROM c WHERE prop = 'LINE' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, ord, claim_id) = 1")
def best_claim(s, d):
    return K.best_claim(claims(s, d, "lineitem"), "ref", "LINE").select("doc_id", "claim_id", "to", "confidence")


@query(C["lineitem"] + "SELECT doc_id, claim_id, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, ord, claim_id)::INT AS position FROM c WHERE prop = 'LINE' AND confidence >= 0.7")
def claims_of(s, d):
    return K.claims_of(claims(s, d, "lineitem"), "ref", "LINE", 0.7).select("doc_id", "claim_id", "position")


@query(C["lineitem"] + "SELECT doc_id, claim_id, prop FROM c LEFT JOIN (SELECT DISTINCT claim_id AS gone FROM c WHERE confidence < 0.75 AND depth = 0) g ON parent_claim_id = gone WHERE confidence >= 0.75 AND gone IS NULL")
def confident_subtree(s, d):
    return claims(s, d, "lineitem", floor=0.75).select("doc_id", "claim_id", "prop")


@query(C["shipments"] + """, k AS (SELECT claim_id, parent_claim_id, confidence >= 0.75 AS ok FROM c)
SELECT a.claim_id FROM k a LEFT JOIN k b ON a.parent_claim_id = b.claim_id LEFT JOIN k e ON b.parent_claim_id = e.claim_id LEFT JOIN k f ON e.parent_claim_id = f.claim_id
WHERE a.ok AND coalesce(b.ok, true) AND coalesce(e.ok, true) AND coalesce(f.ok, true)""")
def confident_levels(s, d):
    return K.confident(claims(s, d, "shipments"), 0.75, levels("shipments")).select("claim_id")


@query(C["orders"] + "SELECT doc_id, prop, type, left(sha256(doc_id || chr(0) || prop || chr(0) || '1'), 22) AS claim_id FROM c")
def with_ids(s, d):
    return K.with_ids(claims(s, d, "orders")).select("doc_id", "prop", "type", "claim_id")


@query(C["orders"] + """, x AS (SELECT doc_id FROM c GROUP BY doc_id), m(prop, n, def) AS (VALUES ('PRIORITY', 1, 'unknown'), ('NOTE', 2, 'none')),
h AS (SELECT doc_id, prop, count(*) AS k FROM c GROUP BY ALL), l AS (SELECT x.doc_id, m.prop, def, unnest(range(1, (n - coalesce(k, 0) + 1)::BIGINT)) AS i FROM x CROSS JOIN m LEFT JOIN h ON h.doc_id = x.doc_id AND h.prop = m.prop)
SELECT doc_id, prop, type FROM c UNION ALL SELECT doc_id, prop, def FROM l""")
def fill_defaults(s, d):
    c = claims(s, d, "orders")
    spec = fixed(s, [("PRIORITY", 1, "unknown"), ("NOTE", 2, "none")], "prop string, min int, default string")
    return K.fill_defaults(c, c.select("doc_id"), spec).select("doc_id", "prop", "type")


@query(C["lineitem"] + """, o AS (SELECT doc_id, claim_id, ord, CASE WHEN EXISTS (SELECT 1 FROM c r WHERE r.parent_claim_id = c.claim_id AND r.prop = 'RETURNED') THEN 'back' ELSE '' END AS list,
(SELECT max(q.raw::DOUBLE) FROM c q WHERE q.parent_claim_id = c.claim_id AND q.prop = 'QUANTITY') AS place FROM c WHERE prop = 'LINE')
SELECT doc_id, list, claim_id, row_number() OVER (PARTITION BY doc_id, list ORDER BY place NULLS LAST, ord, claim_id)::INT AS position FROM o""")
def claim_lists(s, d):
    c = claims(s, d, "lineitem")
    marked = c.withColumn("str_value", F.when(F.col("prop") == "RETURNED", "back").otherwise(F.col("str_value")))
    return K.claim_lists(marked, "LINE", "RETURNED", "QUANTITY")


@query(C["lineitem"] + """, a AS MATERIALIZED (SELECT doc_id, claim_id FROM c WHERE prop = 'LINE' AND confidence >= 0.75), b AS MATERIALIZED (SELECT parent_claim_id, claim_id, raw FROM c WHERE prop = 'SHIPPED' AND confidence >= 0.75)
SELECT a.doc_id, a.claim_id AS start_id, b.claim_id, b.raw FROM a JOIN b ON b.parent_claim_id = a.claim_id""")
def navigate(s, d):
    return K.navigate(claims(s, d, "lineitem"), ["LINE", "SHIPPED"], 0.75).select("doc_id", "start_id", "claim_id", "raw")


@query(C["shipments"] + """, p AS (SELECT claim_id, parent_claim_id, prop FROM c)
SELECT a.claim_id, concat_ws('.', f.prop, e.prop, b.prop, a.prop) AS path FROM p a JOIN p b ON a.parent_claim_id = b.claim_id LEFT JOIN p e ON b.parent_claim_id = e.claim_id LEFT JOIN p f ON e.parent_claim_id = f.claim_id
WHERE a.prop IN ('QUANTITY', 'FLAG_R')""")
def match_paths_deep(s, d):
    return K.match_paths(claims(s, d, "shipments"), ["**.QUANTITY", "SHIPMENT.*.FLAG_R"], levels=levels("shipments")).select("claim_id", "path")


@query(C["orders_lineitem"] + """, p AS (SELECT claim_id, prop AS path FROM c WHERE depth = 0 UNION ALL SELECT c.claim_id, u.prop || '.' || c.prop FROM c JOIN c u ON c.parent_claim_id = u.claim_id)
SELECT claim_id, path FROM p WHERE path LIKE 'LINE.%' OR path = 'TOTAL' OR path = 'LINE'""")
def match_paths(s, d):
    return K.match_paths(claims(s, d, "orders", "lineitem"), ["LINE.**", "TOTAL"], levels=levels("orders", "lineitem")).select("claim_id", "path")


@query(C["lineitem"] + """SELECT claim_id, CASE type WHEN 'amount' THEN raw WHEN 'time' THEN raw WHEN 'ref' THEN "to" ELSE upper(type) END AS text FROM c""")
def claim_text(s, d):
    return K.claim_text(claims(s, d, "lineitem")).select("claim_id", "text")


@query(C["part"] + """, g AS (SELECT prop, type, str_value, raw, unit, count(*) AS n FROM c GROUP BY ALL) SELECT prop, n::BIGINT AS n, count(*)::BIGINT AS signatures FROM g GROUP BY ALL""")
def claim_signatures(s, d):
    sig = K.claim_signature(claims(s, d, "part"), with_sub=False)
    return sig.groupBy("prop", "signature").agg(F.count("*").alias("n")).groupBy("prop", "n").agg(F.count("*").alias("signatures"))


@query("""WITH g AS (
  SELECT 'SHIPMENT' AS prop, count(*) AS n FROM lineitem GROUP BY l_linenumber, l_linestatus, l_discount, l_returnflag, l_quantity
  UNION ALL SELECT 'STATE', count(*) FROM lineitem GROUP BY l_linestatus, l_discount, l_returnflag, l_quantity
  UNION ALL SELECT 'FLAG_' || l_returnflag, count(*) FROM lineitem GROUP BY l_returnflag, l_quantity
  UNION ALL SELECT 'QUANTITY', count(*) FROM lineitem GROUP BY l_quantity)
SELECT prop, n::BIGINT AS n, count(*)::BIGINT AS signatures FROM g GROUP BY ALL""")
def claim_signatures_deep(s, d):
    sig = K.claim_signature(claims(s, d, "shipments"), levels=levels("shipments"))
    return sig.groupBy("prop", "signature").agg(F.count("*").alias("n")).groupBy("prop", "n").agg(F.count("*").alias("signatures"))


@query("SELECT 's:' || l_suppkey AS doc_id, NOT (l_suppkey % 10 = 7 AND bool_or(l_quantity = 13)) AS equivalent FROM lineitem GROUP BY l_suppkey")
def claims_equivalent_deep(s, d):
    a = claims(s, d, "shipments")
    changed = (F.col("prop") == "QUANTITY") & (F.col("raw") == "13") & F.col("doc_id").endswith("7")
    b = a.withColumns({"ord": -F.col("ord"), "raw": F.when(changed, "1300").otherwise(F.col("raw")), "claim_id": F.concat("claim_id", F.lit("b")), "parent_claim_id": F.concat("parent_claim_id", F.lit("b"))})
    return E.claims_equivalent(a, b, levels("shipments"))


@query("SELECT 's:' || l_suppkey AS doc_id, 'SHIPMENT' AS prop, count(*) AS n FROM lineitem GROUP BY l_suppkey, l_linenumber, l_linestatus, l_discount, l_returnflag, l_quantity HAVING count(*) > 1")
def duplicate_claims_deep(s, d):
    return E.duplicate_claims(claims(s, d, "shipments"), levels=levels("shipments"))


@query("SELECT 'd:' || doc_id AS doc_id, text AS str_value, lang FROM documents WHERE lang IN ('fr', 'de', 'en')")
def select_by_language(s, d):
    return K.select_by_language(claims(s, d, "documents"), ["BODY"], "fr", {"fr": ["de", "en"]})


@query(C["part"] + "SELECT claim_id, CASE WHEN EXISTS (SELECT 1 FROM c x WHERE x.parent_claim_id = c.claim_id) THEN ['x'] ELSE ['und'] END AS langs, NULL::VARCHAR AS in_unit FROM c")
def with_lang_unit(s, d):
    return K.with_lang_unit(claims(s, d, "part"), fixed(s, [("l:en", "en")], "id string, code string")).select("claim_id", "langs", "in_unit")


@query("SELECT 'o:' || o_orderkey AS doc_id, round(o_totalprice / 0.01) * 0.01 AS value, round(o_totalprice / 0.01) * 0.01 - 0.005 AS lo, round(o_totalprice / 0.01) * 0.01 + 0.005 AS hi, false AS hi_incl, NULL::VARCHAR AS error FROM orders")
def amount_windows(s, d):
    c = claims(s, d, "orders").where("prop = 'TOTAL'")
    return V.amount_windows(V.parse_amounts(c)).select("doc_id", "value", "lo", "hi", "hi_incl", "error")


@query("SELECT 'o:' || l_orderkey AS doc_id, epoch(l_shipdate)::DOUBLE AS lo, epoch(l_shipdate)::DOUBLE + 86400 AS hi, epoch(date_trunc('month', l_shipdate))::DOUBLE AS m_lo, epoch(date_trunc('month', l_shipdate) + INTERVAL 1 MONTH)::DOUBLE AS m_hi FROM lineitem")
def time_windows(s, d):
    c = claims(s, d, "lineitem").where("prop = 'SHIPPED'").select("doc_id", "raw", "time_precision")
    days = V.time_windows(c).drop("error", "seconds", "hi_incl")
    months = days.withColumns({"month": F.substring("raw", 1, 7), "p": F.lit("m")}).withColumnsRenamed({"lo": "d_lo", "hi": "d_hi"})
    return V.time_windows(months, "month", "p").select("doc_id", F.col("d_lo").alias("lo"), F.col("d_hi").alias("hi"), F.col("lo").alias("m_lo"), F.col("hi").alias("m_hi"))


@query("""SELECT 'o:' || l_orderkey AS doc_id, least(l_quantity, l_linenumber * 5.0) - 0.5 AS lo, greatest(l_quantity, l_linenumber * 5.0) + 0.5 AS hi, false AS hi_incl, 'range' AS kind FROM lineitem WHERE l_returnflag = 'N'
UNION ALL SELECT 'o:' || l_orderkey, l_quantity - 0.5, 1.7976931348623157e308, false, 'range' FROM lineitem WHERE l_returnflag = 'R'
UNION ALL SELECT 'o:' || l_orderkey, NULL, NULL, NULL, 'unknown' FROM lineitem WHERE l_returnflag = 'A'""")
def interval_windows(s, d):
    one, none = F.lit(1.0), F.lit(None).cast("string")
    rows = table(s, d, "lineitem").where("l_returnflag IN ('N', 'R', 'A')").select(
        F.expr("'o:' || l_orderkey").alias("doc_id"), F.col("l_quantity").alias("from_v"), one.alias("from_p"), F.lit(False).alias("from_open"), F.when(F.col("l_returnflag") == "A", "unknown").alias("from_state"),
        (F.col("l_linenumber") * 5.0).alias("to_v"), one.alias("to_p"), F.lit(False).alias("to_open"), F.when(F.col("l_returnflag") == "A", "unknown").when(F.col("l_returnflag") == "R", "none").alias("to_state"),
    )
    return V.interval_windows(rows).select("doc_id", "lo", "hi", "hi_incl", "kind")


@query("SELECT o_orderkey, epoch(o_orderdate)::DOUBLE AS seconds, NULL::VARCHAR AS error, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y-%m') AS month, strftime(o_orderdate, '%Y') AS year FROM orders")
def parse_times(s, d):
    rows = table(s, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("raw"), F.lit("d").alias("time_precision"))
    return V.format_times(V.parse_times(rows), "seconds", {"day": "d", "month": "m", "year": "y"}).drop("raw", "time_precision")


@query("SELECT p_partkey, 0.01::DOUBLE AS precision, printf('%.2f', p_retailprice) AS text, printf('%.0f', round(p_retailprice / 10) * 10) AS tens FROM part")
def format_values(s, d):
    rows = table(s, d, "part").withColumn("raw", F.format_string("%.2f", "p_retailprice"))
    v = F.col("p_retailprice")
    return rows.select("p_partkey", F.round(V.detect_precision(F.col("raw")), 6).alias("precision"), V.format_amount(v, F.lit(0.01)).alias("text"), V.format_amount(v, F.lit(10.0)).alias("tens"))


@query("""SELECT p_type AS prop, CASE WHEN p_size % 100 = 0 THEN 100.0 WHEN p_size % 10 = 0 THEN 10.0 ELSE 1.0 END::DOUBLE AS precision, count(*) AS n FROM part GROUP BY ALL""")
def precision_profile(s, d):
    return V.precision_profile(table(s, d, "part").select(F.col("p_type").alias("prop"), F.col("p_size").cast("double").alias("lo")))


@query("""WITH t AS (SELECT l_returnflag AS prop, CASE WHEN l_linenumber % 3 = 0 THEN date_trunc('month', l_shipdate) WHEN l_linenumber % 3 = 1 THEN date_trunc('year', l_shipdate) ELSE l_shipdate END AS t FROM lineitem)
SELECT prop, CASE WHEN day(t) <> 1 THEN 'd' WHEN month(t) <> 1 THEN 'm' WHEN year(t) % 1000 = 0 THEN '1ky' WHEN year(t) % 100 = 0 THEN '100y' WHEN year(t) % 10 = 0 THEN '10y' ELSE 'y' END AS precision, count(*) AS n FROM t GROUP BY ALL""")
def time_profile(s, d):
    n = F.col("l_linenumber") % 3
    t = F.when(n == 0, F.date_trunc("month", "l_shipdate")).when(n == 1, F.date_trunc("year", "l_shipdate")).otherwise(F.col("l_shipdate"))
    return V.precision_profile(table(s, d, "lineitem").select(F.col("l_returnflag").alias("prop"), t.cast("timestamp").cast("double").alias("lo")), kind="time")


@query("""SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN '(' ELSE '[' END || CASE WHEN l_linenumber = 1 THEN '?' WHEN l_linenumber = 2 THEN '-' ELSE CAST(l_quantity AS BIGINT)::VARCHAR END || ', ' || (CAST(l_quantity AS BIGINT) + 5) || CASE WHEN l_linestatus = 'F' THEN ')' ELSE ']' END AS text FROM lineitem""")
def interval_text(s, d):
    q, none = F.col("l_quantity").cast("bigint"), F.lit(None).cast("string")
    rows = table(s, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", q.cast("string").alias("from_raw"), (q + 5).cast("string").alias("to_raw"), (F.col("l_returnflag") == "R").alias("from_open"), (F.col("l_linestatus") == "F").alias("to_open"),
        F.when(F.col("l_linenumber") == 1, "unknown").when(F.col("l_linenumber") == 2, "none").alias("from_state"), none.alias("to_state"),
    )
    return rows.select("l_orderkey", "l_partkey", "l_linenumber", K.interval_text(rows).alias("text"))


@query("""SELECT 'p:' || p_partkey AS doc_id, list_sort(list_distinct(list_filter([CASE WHEN p_partkey % 2 = 0 THEN 'en' END, CASE WHEN p_partkey % 3 = 0 THEN 'de' END], lambda x: x IS NOT NULL))) AS l, CASE WHEN p_partkey % 5 = 0 THEN 'u:' || (p_partkey % 4) END AS in_unit,
CASE WHEN len(l) = 0 THEN ['und'] ELSE l END AS langs FROM part""")
def claim_languages(s, d):
    """Names with languages and units as sub-claims; a third language is not known."""
    c = claims(s, d, "part", only={"NAME"})
    key = F.substring("doc_id", 3, 20).cast("long")
    sub = lambda prop, to, name: c.where(to.isNotNull()).withColumns({"parent_claim_id": F.col("claim_id"), "claim_id": F.concat("claim_id", F.lit(name)), "parent_prop": F.col("prop"), "depth": F.lit(1), "type": F.lit("ref"), "prop": F.lit(prop), "to": to})
    more = [sub("IN_LANGUAGE", F.when(key % 2 == 0, "l:en"), "e"), sub("IN_LANGUAGE", F.when(key % 3 == 0, "l:de"), "d"), sub("IN_LANGUAGE", F.when(key % 7 == 0, "l:xx"), "x"), sub("IN_UNIT", F.when(key % 5 == 0, F.concat(F.lit("u:"), (key % 4).cast("string"))), "u")]
    for x in more:
        c = c.unionByName(x)
    out = K.with_lang_unit(c, fixed(s, [("l:en", "en"), ("l:de", "de")], "id string, code string")).where("depth = 0")
    return out.select("doc_id", F.when(F.col("langs") == F.array(F.lit("und")), F.expr("CAST(array() AS array<string>)")).otherwise(F.col("langs")).alias("l"), "in_unit", "langs")
