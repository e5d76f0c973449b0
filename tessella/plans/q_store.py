"""Queries of edges, versions and sessions over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tessella.functions.values import time_windows
from tessella.operators import access as N, claims as K, edges as E, store as S
from tessella.plans.q_search import BASE, ancestors, edges as up_edges
from tessella.plans.tables import claims, claims_sql, fixed, table
from tessella.operators import hierarchy as H
from tessella.sources import io as X
from tessella.streaming import maintenance as M

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return add


CUST = f"WITH c AS ({claims_sql('orders')}) "


@query(BASE + ", x AS (SELECT doc_id, cust, nat, reg FROM o) SELECT t.target, 'top' AS level, x.doc_id AS source FROM x, LATERAL (SELECT unnest([cust, nat, reg]) AS target) t")
def reference_edges(s, d):
    return E.reference_edges(claims(s, d, "orders"), ancestors(s, d), "top").select("target", "level", "source")


@query("SELECT 'c:' || o_custkey AS doc_id, 'ORDERS' AS prop, 'o:' || o_orderkey AS \"to\" FROM orders")
def inverse_claims(s, d):
    return E.inverse_claims(claims(s, d, "orders"), fixed(s, [("CUSTOMER", "ORDERS")], "prop string, inverse string")).select("doc_id", "prop", "to")


@query("SELECT 'o:' || o_orderkey AS doc_id, 'NAME' AS prop, c_name AS str_value, 1::INT AS depth FROM orders JOIN customer ON o_custkey = c_custkey")
def embed_claims(s, d):
    c = claims(s, d, "orders", "customer")
    return E.embed_claims(c, fixed(s, [("CUSTOMER", "NAME")], "prop string, source_prop string")).select("doc_id", "prop", "str_value", "depth")


@query("SELECT 'c:' || o_custkey AS doc_id, 'RETURN' AS prop, count(*)::BIGINT AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND 1.0::DOUBLE - 5 * l_discount >= 0.75 GROUP BY ALL")
def embed_deep(s, d):
    """Customers refer back to their orders and get the returns of these orders' lines."""
    back = E.inverse_claims(claims(s, d, "orders", only={"CUSTOMER"}), fixed(s, [("CUSTOMER", "ORDERS")], "prop string, inverse string"))
    out = E.embed_claims(back.unionByName(claims(s, d, "lineitem", only={"LINE", "RETURNED"})), fixed(s, [("ORDERS", "LINE.RETURNED", "RETURN")], "prop string, source_prop string, dest string"), depth=2, floor=0.75)
    return out.groupBy("doc_id", "prop").agg(F.count("*").alias("n"))


@query("SELECT 'c:' || o_custkey AS target, 'o:' || o_orderkey AS embedder, ['BALANCE', 'NAME'] AS paths FROM orders")
def embedding_edges(s, d):
    return E.embedding_edges(claims(s, d, "orders"), fixed(s, [("CUSTOMER", "NAME"), ("CUSTOMER", "BALANCE")], "prop string, source_prop string"))


@query("SELECT 'o:' || o_orderkey AS source FROM orders WHERE o_custkey IN (1, 2)")
def referrers(s, d):
    return E.referrers(E.reference_edges(claims(s, d, "orders"), ancestors(s, d), "top"), ["c:1", "c:2"], ["top"])


@query(BASE + ", x AS (SELECT doc_id, unnest([cust, nat, reg]) AS target FROM o WHERE o_orderstatus <> 'P') SELECT target, count(DISTINCT doc_id)::BIGINT AS refs FROM x GROUP BY ALL")
def reference_counts(s, d):
    c = claims(s, d, "orders")
    return E.reference_counts(E.reference_edges(c, ancestors(s, d), "top"), "top", c.where("prop = 'STATUS_P'").select("doc_id"))


@query("WITH c AS (" + claims_sql("customer") + "), r AS (SELECT 'c:' || o_custkey AS doc_id, count(*) AS n FROM orders GROUP BY ALL) SELECT doc_id, count(*)::BIGINT AS n_claims, coalesce(any_value(n), 0)::BIGINT AS n_refs, (count(*) + coalesce(any_value(n), 0))::BIGINT AS score FROM c LEFT JOIN r USING (doc_id) GROUP BY doc_id")
def doc_counts(s, d):
    refs = E.reference_counts(E.reference_edges(claims(s, d, "orders"), ancestors(s, d), "top"), "top")
    return E.doc_counts(claims(s, d, "customer"), refs)


@query("SELECT 'o:' || k AS doc_id, min(t) AS time FROM (SELECT o_orderkey AS k, epoch(o_orderdate)::DOUBLE AS t FROM orders UNION ALL SELECT l_orderkey, epoch(l_shipdate)::DOUBLE FROM lineitem) GROUP BY k")
def earliest_time(s, d):
    return E.earliest_time(time_windows(claims(s, d, "orders", "lineitem").where("type = 'time'")))


OLD = "SELECT 'o:' || o_orderkey AS source, 'c:' || o_custkey AS target FROM orders"
NEW = "SELECT 'o:' || o_orderkey AS source, CASE WHEN o_orderkey % 10 = 0 THEN 'c:0' ELSE 'c:' || o_custkey END AS target FROM orders WHERE o_orderkey % 7 > 0"


@query(f"SELECT 'added' AS change, * FROM ({NEW} EXCEPT ALL {OLD}) UNION ALL SELECT 'removed', * FROM ({OLD} EXCEPT ALL {NEW})")
def edge_diff(s, d):
    o = table(s, d, "orders")
    old = o.select(F.expr("'o:' || o_orderkey").alias("source"), F.expr("'c:' || o_custkey").alias("target"))
    new = o.where("o_orderkey % 7 > 0").select(F.expr("'o:' || o_orderkey").alias("source"), F.expr("CASE WHEN o_orderkey % 10 = 0 THEN 'c:0' ELSE 'c:' || o_custkey END").alias("target"))
    added, removed = E.diff_rows(new, old)
    return added.select(F.lit("added").alias("change"), "*").unionByName(removed.select(F.lit("removed").alias("change"), "*"))


def _changed(s, d):
    c = claims(s, d, "customer")
    odd = F.substring("doc_id", 3, 20).cast("long") % 3 == 0
    return c.withColumn("raw", F.when(odd & (F.col("prop") == "BALANCE"), "0.00").otherwise(F.col("raw"))), c


@query("SELECT 'c:' || c_custkey AS doc_id, 'BALANCE' AS prop FROM customer WHERE c_custkey % 3 = 0 AND CAST(c_acctbal AS DECIMAL(18, 2)) <> 0")
def changed_props(s, d):
    return E.changed_props(*_changed(s, d))


@query("SELECT DISTINCT 'o:' || o_orderkey AS embedder FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 3 = 0 AND CAST(c_acctbal AS DECIMAL(18, 2)) <> 0")
def embedders_to_refresh(s, d):
    e = E.embedding_edges(claims(s, d, "orders"), fixed(s, [("CUSTOMER", "BALANCE")], "prop string, source_prop string"))
    return E.embedders_to_refresh(e, E.changed_props(*_changed(s, d)))


@query("SELECT 'c:' || c_custkey AS doc_id, NOT (c_custkey % 3 = 0 AND CAST(c_acctbal AS DECIMAL(18, 2)) <> 0) AS equivalent FROM customer")
def claims_equivalent(s, d):
    return E.claims_equivalent(*_changed(s, d))


@query("SELECT prop, count(*)::BIGINT AS n FROM (" + claims_sql("nation", "region") + ") GROUP BY prop")
def merge_docs(s, d):
    return E.merge_docs(claims(s, d, "nation"), claims(s, d, "region")).groupBy("prop").agg(F.count("*").alias("n"))


@query("SELECT 'o:' || l_orderkey AS doc_id, 'LINE' AS prop, count(*)::BIGINT AS n FROM lineitem GROUP BY l_orderkey, l_partkey, l_discount HAVING count(*) > 1")
def duplicate_claims(s, d):
    return E.duplicate_claims(claims(s, d, "lineitem").where("depth = 0"), with_sub=False)


# --- versions: each user's events are versions of one value; version i descends from version i // 2 ---
EV = """v AS (SELECT 'e' || event_id AS changeset, 'u' || user_id AS id, event_id, user_id, event_type, props, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
ch AS (SELECT v.*, p.changeset AS parent, CASE WHEN v.event_type <> 'error' THEN v.props END AS data FROM v LEFT JOIN v p ON p.user_id = v.user_id AND p.i = v.i // 2 AND v.i > 1)"""


def changes(s, d):
    e = table(s, d, "events").select(F.expr("'e' || event_id").alias("changeset"), F.expr("'u' || user_id").alias("id"), "event_id", "event_type", "props")
    v = e.withColumn("i", F.row_number().over(Window.partitionBy("id").orderBy("event_id")))
    p = v.select("id", F.col("i").alias("__i"), F.col("changeset").alias("parent"))
    rows = v.join(p.withColumnRenamed("id", "__id"), (F.col("id") == F.col("__id")) & (F.expr("i DIV 2") == F.col("__i")), "left")
    empty = F.expr("CAST(array() AS array<string>)")
    return rows.select("changeset", "id", F.lit(1).alias("revision"), F.when(F.col("parent").isNull(), empty).otherwise(F.array("parent")).alias("parents"), F.when(F.col("event_type") != "error", F.col("props")).alias("data"), "i", "event_id")


@query("SELECT user_id, max(event_id)::BIGINT AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def current_revisions(s, d):
    e = table(s, d, "events").select("user_id", "event_id", "event_type", F.col("event_id").alias("revision"))
    return S.current_revisions(e, ["user_id"]).drop("revision")


def _heads(c):
    return c.groupBy("id").agg(F.max_by("changeset", "i").alias("changeset"))


REACH = f"WITH RECURSIVE {EV}, h AS (SELECT id, arg_max(changeset, i) AS changeset FROM ch GROUP BY id), r AS (SELECT id, changeset, 0 AS depth FROM h UNION ALL SELECT r.id, ch.parent, r.depth + 1 FROM r JOIN ch ON ch.changeset = r.changeset AND ch.id = r.id WHERE ch.parent IS NOT NULL) "


@query(REACH + "SELECT id, changeset, depth::INT AS depth FROM r")
def committed_values(s, d):
    c = changes(s, d)
    return S.committed_values(c, _heads(c))


@query(REACH + "SELECT id, changeset, depth::INT AS depth FROM r WHERE id = 'u7'")
def history(s, d):
    c = changes(s, d)
    return S.history(S.committed_values(c, _heads(c)), "u7")


@query(REACH + "SELECT changeset FROM r WHERE id IN ('u1', 'u2', 'u3')")
def commit_plan(s, d):
    c = changes(s, d)
    return S.commit_plan(c, _heads(c).where("id IN ('u1', 'u2', 'u3')"), fixed(s, [("none",)], "changeset string"))


SHOWN = f"WITH {EV}, h AS (SELECT id, arg_max(changeset, i) AS m, arg_max(changeset, i) FILTER (i % 3 = 0) AS c FROM ch GROUP BY id), x AS (SELECT h.id, coalesce(c, m) AS changeset FROM h) "


def _views(s, d):
    """The child view has each user's last third version, the main view the last of all; the child is nearer."""
    c = changes(s, d)
    main = _heads(c).withColumn("view", F.lit("main"))
    child = _heads(c.where("i % 3 = 0")).withColumn("view", F.lit("child"))
    return c, fixed(s, [("child", 0), ("main", 1)], "view string, position int"), main.unionByName(child)


@query(SHOWN + "SELECT x.id, x.changeset, data, data IS NULL AS deleted FROM x JOIN ch USING (changeset)")
def snapshot(s, d):
    c, path, heads = _views(s, d)
    return S.snapshot(path, heads, c)


@query(SHOWN + "SELECT 'live' AS kind, count(data)::BIGINT AS n FROM x JOIN ch USING (changeset) UNION ALL SELECT 'all', count(*) FROM x")
def live_count(s, d):
    c, path, heads = _views(s, d)
    shown = S.snapshot(path, heads, c)
    return S.count_values(shown).select(F.lit("live").alias("kind"), "n").unionByName(S.count_values(shown, True).select(F.lit("all").alias("kind"), "n"))


@query(f"WITH {EV} SELECT changeset, id, data FROM ch WHERE i = 5")
def at_version(s, d):
    c = changes(s, d)
    return S.at_version(c, c.where("i = 5").select("id", "changeset")).select("changeset", "id", "data")


@query("SELECT 'main' AS view, 'u' || user_id AS id, 2::BIGINT AS heads FROM events GROUP BY user_id HAVING count(*) >= 4")
def conflicts(s, d):
    v = S.committed_values(changes(s, d), _heads(changes(s, d))).withColumn("view", F.lit("main"))
    # the second newest version as a further head
    c = changes(s, d).withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("i"))))
    more = c.where("r = 2 AND i >= 3").select("id", "changeset", F.lit(0).alias("depth"), F.lit("main").alias("view"))
    return S.head_conflicts(v.unionByName(more))


@query(f"WITH {EV}, k AS (SELECT changeset FROM ch WHERE event_id % 5 = 0) SELECT changeset FROM ch WHERE event_id % 5 > 0 AND changeset NOT IN (SELECT parent FROM ch WHERE parent IS NOT NULL)")
def discardable(s, d):
    c = changes(s, d)
    return S.discardable(c, c.where("event_id % 5 = 0").select("changeset"))


@query(f"WITH {EV} SELECT changeset, id, CASE WHEN event_id % 4 = 0 THEN 'committed' WHEN event_id % 6 = 1 THEN 'no parent' ELSE 'duplicate' END AS error FROM ch")
def check_changes(s, d):
    c = changes(s, d)
    new = c.withColumn("parents", F.when(F.col("event_id") % 6 == 1, F.array(F.lit("nowhere"))).otherwise(F.col("parents")))
    return S.check_changes(c, c.where("event_id % 4 = 0").select("changeset"), new).select("changeset", "id", "error")


@query("SELECT 'u' || user_id AS id, CASE WHEN user_id % 2 = 0 THEN 'x' END AS old FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 4 <> 0")
def upsert(s, d):
    users = table(s, d, "events").select(F.expr("'u' || user_id").alias("id"), F.col("user_id")).distinct()
    latest = users.where("user_id % 2 = 0").select("id", F.lit("x").alias("changeset"), F.when(F.col("user_id") % 4 == 0, "same").otherwise("old").alias("data"))
    return S.upsert_documents(latest, users.select("id", F.lit("same").alias("data")), "new").select("id", F.get("parents", F.lit(0)).alias("old"))


@query("""WITH e AS (SELECT user_id, (event_id % 3)::BIGINT AS k, event_id, event_type, value FROM events), g AS (SELECT user_id, k, arg_max(event_type, event_id) AS t, arg_max(value, event_id) FILTER (event_type <> 'signup') AS v FROM e GROUP BY ALL)
SELECT 'u' || user_id AS doc_id, 'k' || k AS claim_id, v AS value FROM g WHERE t <> 'error' AND NOT (k > 0 AND EXISTS (SELECT 1 FROM g h WHERE h.user_id = g.user_id AND h.k = 0 AND h.t = 'error'))""")
def replay_patches(s, d):
    e = table(s, d, "events")
    patches = e.select(F.expr("'u' || user_id").alias("doc_id"), F.expr("'k' || event_id % 3").alias("claim_id"), F.col("event_id").alias("op"), F.expr("CASE event_type WHEN 'error' THEN 'remove' WHEN 'view' THEN 'cast' ELSE 'set' END").alias("kind"), F.when(F.col("event_id") % 3 > 0, "k0").alias("parent_claim_id"), F.when(F.col("event_type") != "signup", F.col("value")).alias("value"))
    base = fixed(s, [], "doc_id string, claim_id string, parent_claim_id string, value double")
    return S.replay_patches(base, patches.withColumn("op", F.col("op").cast("int"))).select("doc_id", "claim_id", "value")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS operation FROM events")
def session_numbering(s, d):
    return S.number_operations(table(s, d, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "operation")


@query("SELECT conv_id AS session, max(turn)::BIGINT AS operation FROM conversations WHERE conv_id % 2 = 0 GROUP BY conv_id")
def open_sessions(s, d):
    c = table(s, d, "conversations")
    sessions = c.select(F.col("conv_id").alias("session")).distinct().select("session", F.to_json(F.struct((F.col("session") % 2).cast("string").alias("odd"))).alias("begin_metadata"), F.lit(None).cast("string").alias("end_metadata"))
    ops = c.select(F.col("conv_id").alias("session"), F.col("turn").alias("operation"), F.col("text").alias("data"))
    return S.open_sessions(sessions, ops, {"odd": "0"}).drop("data")


@query("SELECT conv_id AS session, list_sort(list(DISTINCT role)) AS contributors FROM conversations WHERE role IS NOT NULL GROUP BY conv_id")
def contributors(s, d):
    return S.contributors(table(s, d, "conversations").select(F.col("conv_id").alias("session"), F.col("role").alias("user")))


@query("SELECT event_id AS seq, event_type AS view, user_id FROM events WHERE event_id > 500 AND event_type = 'error'")
def commit_log(s, d):
    log = table(s, d, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("view"), "user_id")
    return X.log_after(log, 500, "error")


def _nation_views(s, d):
    """Each nation is a view below its region; those of an even number have given up their name."""
    n = table(s, d, "nation").select(F.expr("'n:' || n_nationkey").alias("view"), F.expr("array('n:' || n_nationkey, 'r:' || n_regionkey)").alias("path"), F.col("n_name").alias("name"), "n_nationkey")
    later = n.where("n_nationkey % 2 = 0").withColumn("name", F.lit(None).cast("string")).withColumn("revision", F.lit(2))
    return n.withColumn("revision", F.lit(1)).unionByName(later).select("view", "revision", "path", "name")


@query("SELECT 'c:' || c_custkey AS view, ['c:' || c_custkey, 'n:' || n_nationkey, 'r:' || n_regionkey] AS path FROM customer JOIN nation ON c_nationkey = n_nationkey")
def view_paths(s, d):
    return S.paths_below(_nation_views(s, d), table(s, d, "customer").select(F.expr("'c:' || c_custkey").alias("view"), F.expr("'n:' || c_nationkey").alias("parent")))


@query("SELECT DISTINCT n_name AS name FROM nation WHERE n_nationkey % 2 = 0 AND n_name NOT IN (SELECT n_name FROM nation WHERE n_nationkey % 2 = 1)")
def released_names(s, d):
    return S.released_names(_nation_views(s, d))


@query("SELECT 'u' || user_id AS changeset, event_type AS id, max(event_id)::BIGINT AS revision FROM events WHERE user_id = 7 GROUP BY ALL")
def changes_of(s, d):
    rows = table(s, d, "events").select(F.expr("'u' || user_id").alias("changeset"), F.col("event_type").alias("id"), F.col("event_id").alias("revision"))
    return S.changes_of(rows, "u7")


@query("SELECT DISTINCT event_type AS view FROM events WHERE user_id = 7")
def views_of(s, d):
    return S.views_of(table(s, d, "events").select(F.col("event_type").alias("view"), F.expr("'u' || user_id").alias("changeset")), "u7")


@query("SELECT event_id::VARCHAR AS claim_id, CASE WHEN i >= 5 THEN 'number' WHEN event_id % 7 = 0 THEN 'base' WHEN event_type = 'view' AND event_id % 5 = 0 THEN 'incomplete' END AS error FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events)")
def validate_patches(s, d):
    """From each session's fifth operation on the numbers are one too high."""
    e = S.number_operations(table(s, d, "events"), "user_id", ["event_id"]).withColumn("op", F.col("operation") + F.when(F.col("operation") >= 5, 1).otherwise(0))
    session = F.expr("'u' || user_id")
    patches = e.select(session.alias("session"), "op", F.when(F.col("event_id") % 7 == 0, "elsewhere").otherwise(F.concat_ws("/", session, F.col("op").cast("string"))).alias("base"), F.col("event_id").cast("string").alias("claim_id"), F.when(F.col("event_type") == "view", "add").otherwise("set").alias("kind"), F.when(F.col("event_id") % 5 > 0, "v").alias("value"))
    return S.validate_patches(patches).select("claim_id", "error")


@query("SELECT 'c:' || o_custkey AS target, 'o:' || o_orderkey AS embedder, CASE WHEN o_orderkey % 2 = 0 THEN ['BALANCE', 'NAME'] ELSE ['NAME'] END AS paths, o_orderkey % 2 = 0 AS changed FROM orders")
def merge_paths(s, d):
    c = claims(s, d, "orders")
    name, balance = (E.embedding_edges(c, fixed(s, [("CUSTOMER", p)], "prop string, source_prop string")) for p in ("NAME", "BALANCE"))
    return E.merge_paths(name, balance.where("CAST(substring(embedder, 3) AS BIGINT) % 2 = 0"))


@query("""WITH n AS (SELECT 'o:' || o_orderkey AS source, 'c:' || o_custkey AS target, o_orderkey AS k, o_custkey AS c FROM orders)
SELECT source AS doc_id FROM n WHERE k % 50 = 0 OR c % 97 = 0 OR c % 89 = 0 UNION SELECT target FROM n WHERE k % 10 = 0 UNION SELECT 'c:new' FROM n WHERE k % 10 = 0""")
def affected_docs(s, d):
    """Every tenth order refers to another customer than before; some customers have a new name, some change their visibility."""
    o = table(s, d, "orders")
    before = o.select(F.expr("'o:' || o_orderkey").alias("source"), F.expr("'c:' || o_custkey").alias("target"))
    now = o.select(F.expr("'o:' || o_orderkey").alias("source"), F.expr("IF(o_orderkey % 10 = 0, 'c:new', 'c:' || o_custkey)").alias("target"))
    embedding = E.embedding_edges(claims(s, d, "orders"), fixed(s, [("CUSTOMER", "NAME")], "prop string, source_prop string"))
    c = table(s, d, "customer")
    changed, flipped = (c.where(w).select(F.expr("'c:' || c_custkey").alias("doc_id")) for w in ("c_custkey % 97 = 0", "c_custkey % 89 = 0"))
    return M.affected_docs(o.where("o_orderkey % 50 = 0").select(F.expr("'o:' || o_orderkey").alias("doc_id")), now, before, embedding, changed.withColumn("prop", F.lit("NAME")), flipped)


@query('''WITH x AS (SELECT 'u' || user_id AS doc_id, max(event_id)::BIGINT AS seq, arg_max(event_type, event_id) = 'error' AS deleted, arg_max(ts, event_id) AS "at" FROM events GROUP BY user_id) SELECT doc_id, seq, deleted FROM x WHERE NOT deleted OR "at" >= TIMESTAMP '2024-01-27 00:00:00' ''')
def expire_tombstones(s, d):
    log = table(s, d, "events").select(F.expr("'u' || user_id").alias("doc_id"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), (F.col("event_type") == "error").alias("deleted"))
    index = M.versioned_upsert(log.where("seq % 2 = 0"), log.where("seq % 2 = 1"))
    return M.expire_tombstones(index, "2024-01-28 00:00:00").drop("at")


@query("SELECT 'AMOUNT' AS prop, count(*)::BIGINT AS n FROM orders UNION ALL SELECT 'CUSTOMER', count(*) FROM orders")
def finalize(s, d):
    """Two hooks: one keeps references and amounts, one renames a property."""
    keep = lambda c: c.where("type IN ('ref', 'amount')")
    rename = lambda c: c.withColumn("prop", F.when(F.col("type") == "amount", "AMOUNT").otherwise(F.col("prop")))
    return N.finalize(claims(s, d, "orders"), [keep, rename]).groupBy("prop").agg(F.count("*").alias("n"))
