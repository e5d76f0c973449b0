"""Queries of exports, chunks and upkeep over the driver's tables, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window, functions as F

from tessella.plans.q_search import order_records
from tessella.plans.tables import claims, claims_sql, table
from tessella.sources import io as X
from tessella.sources.settle import shared_dir
from tessella.streaming import maintenance as M, sessions

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return add


MONEY = "CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR)"


@query(f"SELECT 'o:' || o_orderkey AS id, 'c:' || o_custkey AS \"CUSTOMER\", {MONEY} AS \"TOTAL\", 'STATUS_' || o_orderstatus AS \"__HAS__\" FROM orders")
def export_csv(s, d):
    return X.export_csv(claims(s, d, "orders"), ["CUSTOMER", "TOTAL"]).drop("__doc", "rep")


@query(f"SELECT 'o:' || o_orderkey AS doc_id, '{{\"CUSTOMER\":[\"c:' || o_custkey || '\"],\"TOTAL\":[\"' || {MONEY} || '\"]}}' AS value FROM orders")
def export_jsonl(s, d):
    return X.export_jsonl(claims(s, d, "orders"), ["CUSTOMER", "TOTAL"])


@query("SELECT 'o:' || o_orderkey AS doc_id, 'c:' || o_custkey AS customer, CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS DOUBLE) AS total, CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN [o_orderpriority] ELSE ['true'] END AS priority FROM orders")
def export_typed(s, d):
    return X.export_typed(claims(s, d, "orders"), {"customer": ("CUSTOMER", "string", False), "total": ("TOTAL", "double", False), "priority": ("PRIORITY", "string", True)})


@query("SELECT 'o:' || o_orderkey AS doc_id FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3")
def document_ids(s, d):
    return X.document_ids(order_records(s, d), ["n:3"], "CUSTOMER")


@query("""WITH c AS (SELECT user_id AS session, event_id AS chunk, (event_id % 50)::BIGINT AS start, CAST(1 + value AS BIGINT) AS length FROM events), b AS (SELECT *, start + length AS e, coalesce(max(start + length) OVER (PARTITION BY session ORDER BY start, chunk DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
SELECT session, 60::BIGINT AS size, count(*) FILTER (start > before)::BIGINT AS gaps, max(e) > 60 AS overrun, max(e) < 60 AS short, count(*) FILTER (e <= before)::BIGINT AS redundant FROM b GROUP BY session""")
def chunk_coverage(s, d):
    c = table(s, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("chunk"), (F.col("event_id") % 50).alias("start"), F.rint(1 + F.col("value")).cast("long").alias("length"))
    return X.chunk_coverage(c, c.select("session", F.lit(60).cast("long").alias("size")).distinct())


def _log(s, d):
    return table(s, d, "events").select(F.expr("'u' || user_id").alias("doc_id"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), (F.col("event_type") == "error").alias("deleted"), "value")


@query("SELECT 'u' || user_id AS doc_id, max(event_id)::BIGINT AS seq, arg_max(event_type, event_id) = 'error' AS deleted, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def late_writes(s, d):
    """The older half arrives after the newer one and changes nothing that is newer."""
    log = _log(s, d)
    index = M.versioned_upsert(log.where("seq % 2 = 1"), log.where("seq % 2 = 0"))
    return M.versioned_upsert(index, log.where("seq < 1000")).drop("at")


@query("SELECT 'u' || user_id AS doc_id, max(event_id)::BIGINT AS seq FROM events WHERE event_id <= 500 GROUP BY user_id")
def refresh_queue(s, d):
    return M.refresh_queue(_log(s, d).select("doc_id", "seq"), 500)


@query("SELECT 'u' || user_id AS doc_id, max(event_id)::BIGINT AS seq, arg_max(value, event_id) * 2 AS value FROM events GROUP BY user_id")
def rebuild_index(s, d):
    return M.rebuild_index(_log(s, d), lambda df: df.withColumn("value", F.col("value") * 2)).select("doc_id", "seq", "value")


@query("SELECT max(event_id) FILTER (event_id <= 700)::BIGINT AS indexed, min(event_id) FILTER (event_id > 700)::BIGINT AS queued, count(*) FILTER (event_id > 700)::BIGINT AS remaining FROM events")
def progress(s, d):
    log = _log(s, d)
    return M.progress(log.where("seq <= 700"), log.where("seq > 700"), log)


@query("WITH n AS (SELECT 'o:' || o_orderkey AS source, 'c:' || o_custkey AS target FROM orders) SELECT source, CASE WHEN o_orderkey % 3 = 0 THEN 'c:0' ELSE target END AS target FROM n JOIN orders ON source = 'o:' || o_orderkey WHERE o_orderkey % 5 <> 1 OR o_orderkey % 3 = 0")
def merge_edges(s, d):
    o = table(s, d, "orders")
    state = o.select(F.expr("'o:' || o_orderkey").alias("source"), F.expr("'c:' || o_custkey").alias("target"))
    added = o.where("o_orderkey % 3 = 0").select(F.expr("'o:' || o_orderkey").alias("source"), F.lit("c:0").alias("target"))
    return M.merge_edges(state, added, o.where("o_orderkey % 5 = 1").select(F.expr("'o:' || o_orderkey").alias("source")), ["source"])


@query("SELECT conv_id AS session, count(*)::BIGINT AS n, string_agg(text, chr(10) ORDER BY turn) AS data FROM conversations WHERE conv_id % 3 > 0 GROUP BY conv_id")
def complete_sessions(s, d):
    c = table(s, d, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("operation"), F.col("text").alias("data"))
    return M.complete_sessions(c, c.select("session", (F.col("session") % 3 == 0).alias("discarded")).distinct())


def _folder(s, name):
    return f"{shared_dir(s)}/{name}-{uuid.uuid4().hex}"


@query("SELECT 's:' || s_suppkey AS id, s_name AS name, s_nationkey AS nation FROM supplier")
def read_documents(s, d):
    """Suppliers written as one JSON file each and read as documents."""
    path = _folder(s, "documents")
    rows = table(s, d, "supplier").select(F.expr("'s:' || s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    X.write_files(rows, path)
    return X.read_documents(s, path, rows.schema)


@query("SELECT sha256(r_name || chr(10)) AS hash, count(*) AS files, 1::BIGINT AS firsts, sum(strlen(r_name) + 1)::BIGINT AS bytes FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def file_inventory(s, d):
    """A file for each supplier with its region's name: equal files have one first."""
    path = _folder(s, "files")
    t = table(s, d, "supplier").join(table(s, d, "nation"), F.expr("s_nationkey = n_nationkey")).join(table(s, d, "region"), F.expr("n_regionkey = r_regionkey"))
    X.write_files(t.select(F.col("r_name").alias("value")), path, "text")
    rows = X.file_inventory(s, path).where(F.col("path").contains("/part-"))
    return rows.groupBy("hash").agg(F.count("*").alias("files"), F.count_if("first").alias("firsts"), F.sum("length").alias("bytes"))


@query("WITH o AS (SELECT o_orderkey FROM orders), l AS (SELECT unnest(['public', 'secret']) AS level) SELECT level, count(*) * 1 AS n FROM orders, l WHERE level = 'secret' OR o_orderkey % 2 = 0 GROUP BY level")
def write_index(s, d):
    """Totals of two levels written to the index and read back by level and bucket of the property."""
    path = _folder(s, "index")
    rows = order_records(s, d, only={"TOTAL", "ORDERED"})
    key = F.substring("doc_id", 3, 20).cast("long")
    X.write_index(rows.withColumn("level", F.lit("secret")).unionByName(rows.where(key % 2 == 0).withColumn("level", F.lit("public"))), path)
    bucket = F.pmod(F.hash(F.lit("TOTAL")), F.lit(16))
    return s.read.parquet(path).where((F.col("prop_bucket") == bucket) & (F.col("prop") == "TOTAL")).groupBy("level").agg(F.count("*").alias("n"))


@query("""SELECT 'o:' || o_orderkey AS doc_id, '{"LINE":[' || string_agg('{"sub":{"QUANTITY":[{"value":"' || CAST(l_quantity AS BIGINT) || '"}],"SUPPLIER":[{"value":"s:' || l_suppkey || '"}]},"value":"p:' || l_partkey || '"}', ',' ORDER BY l_linenumber, left(sha256('o:' || l_orderkey || chr(0) || 'LINE' || chr(0) || l_partkey || '/' || l_suppkey || '/' || CAST(CAST(l_shipdate AS DATE) AS STRING) || '/' || CAST(CAST(l_extendedprice AS DECIMAL(18, 2)) AS STRING) || chr(0) || l_linenumber), 22)) || '],"TOTAL":[{"value":"' || any_value(CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR)) || '"}]}' AS value
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def export_nested(s, d):
    """Orders that have lines, lines with their sub-claims inside them."""
    c = claims(s, d, "orders", "lineitem", only={"TOTAL", "LINE", "QUANTITY", "SUPPLIER"})
    return X.export_nested(c).where(F.col("value").contains('"LINE"'))


@query("SELECT conv_id::VARCHAR AS session, turn::BIGINT AS operation, 'append' AS kind, 'accepted' AS status FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE turn < n OR n = 1 UNION ALL SELECT conv_id::VARCHAR, NULL, 'append', 'conflict' FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) WHERE n > 1 UNION ALL SELECT DISTINCT conv_id::VARCHAR, NULL, 'begin', 'accepted' FROM conversations UNION ALL SELECT DISTINCT conv_id::VARCHAR, NULL, 'end', 'accepted' FROM conversations")
def session_fates(s, d):
    """Conversations as sessions: each turn appends under the next number, but for the last of several, which repeats the one before."""
    c = table(s, d, "conversations").select(F.col("conv_id").cast("string").alias("session"), "turn", F.col("text").alias("data"))
    w = Window.partitionBy("session")
    n = F.row_number().over(w.orderBy("turn"))
    last = (n == F.count("*").over(w)) & (n > 1)
    none = F.lit(None).cast("string")
    appends = c.select("session", (n * 10).alias("seq"), F.lit("append").alias("kind"), F.when(last, n - 1).otherwise(n).alias("expected"), "data")
    edge = lambda kind, seq: c.select("session").distinct().select("session", F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), F.lit(None).cast("int").alias("expected"), none.alias("data"))
    ops = appends.unionByName(edge("begin", 0)).unionByName(edge("end", 1 << 30))
    return sessions.session_fates(ops, implicit=False).select("session", "operation", "kind", "status")


@query("SELECT 'u' || user_id AS doc_id, max(event_id)::BIGINT AS seq, arg_max(event_type, event_id) = 'error' AS deleted, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def index_batches(s, d):
    """The log in three batches, the last one twice, merged into a bucketed index; then read as its manifest names it."""
    path, log = _folder(s, "bucketed"), _log(s, d).drop("at")
    for n, part in enumerate((log.where("seq % 3 = 0"), log.where("seq % 3 = 2"), log.where("seq % 3 = 1"))):
        M.merge_batch(s, path, n, part, buckets=8)
    M.merge_batch(s, path, 2, log.where("seq % 3 = 1"), buckets=8)
    return M.current(s, path)
