"""Queries of labels, access, text, quality and duplicates over the driver's tables, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import access as N, claims as K, duplicates as J, facets as A, hierarchy as H, quality as V, textsearch as I
from tessella.operators.records import records
from tessella.plans.q_search import ANC, BASE, ancestors, edges, order_records, orders
from tessella.sources.settle import settle, shared_dir
from tessella.plans.tables import claims, claims_sql, fixed, table

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return add


def nation_names(s, d, *names):
    return H.naming_strings(claims(s, d, *names), ["NAME"])


@query("SELECT 'n:' || n_nationkey AS id, 'r:' || n_regionkey AS descendant, 1 AS depth FROM nation WHERE false UNION ALL SELECT 'r:' || n_regionkey, 'n:' || n_nationkey, 1 FROM nation")
def property_closure(s, d):
    return H.property_closure(H.edges_of(claims(s, d, "nation"), ["SUBENTITY"]))


@query(f"WITH {ANC} SELECT ancestor AS id, id AS descendant, min_depth::INT AS depth FROM a")
def property_closure_deep(s, d):
    return H.property_closure(edges(s, d))


@query("""WITH o AS (SELECT 'c:' || c_custkey AS id, CASE WHEN c_custkey % 4 > 0 THEN c_acctbal END AS ord, 'n:' || c_nationkey AS parent FROM customer)
SELECT parent AS id, id AS child, (row_number() OVER (PARTITION BY parent ORDER BY ord NULLS LAST, id))::INT AS position FROM o""")
def ordered_children(s, d):
    """Customers below their nation, by balance; a fourth of them states no order."""
    orders = table(s, d, "customer").where("c_custkey % 4 > 0").select(F.expr("'c:' || c_custkey").alias("id"), F.col("c_acctbal").alias("order"))
    return H.ordered_children(H.edges_of(claims(s, d, "customer"), ["SUBENTITY"]), orders)


@query("SELECT 'n:' || n_nationkey AS prop FROM nation WHERE n_regionkey = 1 AND n_nationkey <> 1")
def hierarchy_props(s, d):
    return H.hierarchy_props(H.property_closure(H.edges_of(claims(s, d, "nation"), ["SUBENTITY"])), "r:1", ["n:1"])


@query("SELECT 'n:' || n_nationkey AS id, 'en' AS lang, [n_name] AS names FROM nation")
def naming_strings(s, d):
    return nation_names(s, d, "nation")


@query("SELECT 'n:' || n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'Nation ' || n_name ELSE n_name END AS label FROM nation")
def display_labels(s, d):
    classes = table(s, d, "nation").select(F.expr("'n:' || n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 2 == 0, "even").otherwise("odd").alias("class"))
    return H.display_labels(nation_names(s, d, "nation"), "de", ["en"], {"even": F.concat(F.lit("Nation "), F.col("names")[0])}, classes)


@query("SELECT 'c:' || c_custkey AS id, c_name || ', ' || n_name || ', ' || r_name AS label FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def chain_labels(s, d):
    names = nation_names(s, d, "customer", "nation", "region").select("id", F.col("names")[0].alias("label"))
    return H.chain_label(names, edges(s, d), 2).where("id LIKE 'c:%'")


@query("SELECT prop, count(*)::BIGINT AS n FROM (SELECT 'TOTAL' AS prop FROM orders UNION ALL SELECT 'MONEY' FROM orders UNION ALL SELECT 'ORDERED' FROM orders UNION ALL SELECT 'WHEN' FROM orders) GROUP BY prop")
def propagate_props(s, d):
    closure = fixed(s, [("MONEY", "TOTAL", 1), ("WHEN", "ORDERED", 1)], "id string, descendant string, depth int")
    return H.propagate_props(claims(s, d, "orders").where("prop IN ('TOTAL', 'ORDERED')"), closure).groupBy("prop").agg(F.count("*").alias("n"))


@query("WITH c AS (" + claims_sql("lineitem") + ") SELECT l.doc_id, l.claim_id FROM c l JOIN c q ON q.parent_claim_id = l.claim_id AND q.prop = 'SHIPPED' WHERE l.prop = 'LINE' QUALIFY row_number() OVER (PARTITION BY l.doc_id ORDER BY q.raw, l.confidence DESC, l.ord, l.claim_id) = 1")
def earliest_sub_interval(s, d):
    return H.earliest_sub_interval(claims(s, d, "lineitem"), "LINE", "SHIPPED").select("doc_id", "claim_id")


@query("SELECT 'o:' || o_orderkey AS doc_id, c_name AS to_display FROM orders JOIN customer ON o_custkey = c_custkey")
def with_labels(s, d):
    names = nation_names(s, d, "customer", "nation", "region").select("id", "lang", F.col("names")[0].alias("label"))
    return H.with_labels(order_records(s, d).where("prop = 'CUSTOMER' AND direct"), names, "en").select("doc_id", "to_display")


@query("""SELECT 'c:' || c_custkey AS doc_id, unnest(['BALANCE', 'NAME', 'SEGMENT']) AS prop, unnest(['thing', 'thing', 'customer']) AS from_class FROM customer""")
def effective_fields(s, d):
    has = table(s, d, "customer").select(F.expr("'c:' || c_custkey").alias("doc_id"), F.lit("customer").alias("class"))
    up = fixed(s, [("customer", "party", 1), ("customer", "thing", 2), ("party", "thing", 1)], "id string, ancestor string, min_depth int")
    fields = fixed(s, [("thing", "NAME", 1, 1), ("thing", "BALANCE", 0, 1), ("customer", "SEGMENT", 1, 1), ("thing", "SEGMENT", 0, 9)], "class string, prop string, min int, max int")
    return H.effective_fields(has, up, fields).select("doc_id", "prop", "from_class")


# --- access ---
ROLES = "WITH sc AS (SELECT 'o:' || o_orderkey AS doc_id, o_orderstatus AS v FROM orders), rr AS (SELECT doc_id, 'admin' AS role FROM sc UNION ALL SELECT doc_id, 'clerk' FROM sc WHERE v = 'O') "


def _roles(s, d):
    o = table(s, d, "orders").select(F.expr("'o:' || o_orderkey").alias("doc_id"), F.col("o_orderstatus").alias("value"))
    scopes = o.select("doc_id", F.lit("STATUS").alias("prop"), "value")
    grants = fixed(s, [("admin", None, None), ("clerk", "STATUS", "O")], "role string, prop string, value string")
    return N.readable_roles(o.select("doc_id"), scopes, grants)


@query(ROLES + "SELECT * FROM rr")
def readable_roles(s, d):
    return _roles(s, d)


@query("WITH c AS (" + claims_sql("lineitem") + ") SELECT DISTINCT l.doc_id, l.\"to\" AS \"user\", CASE WHEN l.ord % 2 = 0 THEN 'read' ELSE 'update' END AS action FROM c l JOIN c q ON q.parent_claim_id = l.claim_id AND q.prop = 'RETURNED' WHERE l.prop = 'LINE'")
def claim_grants(s, d):
    c = claims(s, d, "lineitem")
    even = c.where("prop = 'LINE'").select(F.col("claim_id").alias("parent_claim_id"), (F.col("ord") % 2 == 0).alias("even"))
    marked = c.join(K.shuffled(even), "parent_claim_id", "left").withColumn("str_value", F.when(F.col("even"), "read").otherwise("update")).withColumn("prop", F.when(F.col("prop") == "RETURNED", "ACTION").otherwise(F.col("prop"))).drop("even")
    return N.claim_grants(marked, "LINE")


@query(ROLES + "SELECT 'ann' AS caller, doc_id FROM rr WHERE role = 'admin' UNION ALL SELECT 'bob', doc_id FROM rr WHERE role = 'clerk' AND doc_id IN (SELECT 'o:' || o_orderkey FROM orders WHERE o_orderkey % 2 = 0)")
def permitted(s, d):
    r = _roles(s, d)
    roles = r.withColumn("action", F.lit("read")).unionByName(r.where("role = 'admin'").withColumn("action", F.lit("update")))
    own = orders(s, d).where("CAST(substring(doc_id, 3) AS BIGINT) % 2 = 0").select("doc_id", F.lit("bob").alias("user"), F.lit("update").alias("action"))
    return N.permitted(fixed(s, [("ann", "admin"), ("bob", "clerk")], "caller string, role string"), roles, own, {"update": ["read"]}, "update")


@query("SELECT 'c:' || c_custkey AS caller, 'level_' || CASE WHEN c_acctbal > 0 THEN r_name ELSE c_mktsegment END AS level FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def caller_levels(s, d):
    """Each customer has the role of its segment, those with money that of their region too, whose levels rank above."""
    people = table(s, d, "customer").join(table(s, d, "nation"), F.expr("c_nationkey = n_nationkey")).join(table(s, d, "region"), F.expr("n_regionkey = r_regionkey"))
    roles = people.select(F.expr("'c:' || c_custkey").alias("caller"), F.explode(F.expr("IF(c_acctbal > 0, array(c_mktsegment, r_name), array(c_mktsegment))")).alias("role"))
    low = table(s, d, "customer").select(F.col("c_mktsegment").alias("role"), F.lit(1).alias("rank")).distinct()
    levels = low.unionByName(table(s, d, "region").select(F.col("r_name").alias("role"), F.lit(2).alias("rank"))).withColumn("level", F.concat(F.lit("level_"), "role"))
    return N.caller_levels(roles, levels)


@query("SELECT 'o:' || o_orderkey AS doc_id FROM orders WHERE o_orderstatus = 'O' OR o_custkey = 5")
def read_access(s, d):
    r = _roles(s, d).groupBy("doc_id").agg(F.collect_list("role").alias("readable_roles"))
    u = table(s, d, "orders").select(F.expr("'o:' || o_orderkey").alias("doc_id"), F.array(F.expr("'c:' || o_custkey")).alias("readable_users"))
    return N.read_access(r.join(u, "doc_id"), ["clerk"], "c:5").select("doc_id")


@query("SELECT 'o:' || o_orderkey AS doc_id, unnest(['public', 'secret']) AS level, unnest([o_orderstatus = 'O', true]) AS is_source FROM orders")
def source_flags(s, d):
    return N.source_flags(orders(s, d), _roles(s, d), fixed(s, [("secret", "admin"), ("public", "admin"), ("public", "clerk")], "level string, role string"))


@query("SELECT 'c:' || c_custkey AS doc_id, 'other' AS kind FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 = 1 AND CAST(c_acctbal AS DECIMAL(18, 2)) <> 0")
def audit_changes(s, d):
    c = claims(s, d, "customer")
    key = F.substring("doc_id", 3, 20).cast("long")
    after = c.withColumn("raw", F.when((key % 3 == 0) & (F.col("prop") == "BALANCE"), "0.00").otherwise(F.col("raw")))
    held = c.where(key % 2 == 0).select("doc_id", F.lit("other").alias("action")).distinct()
    return N.audit_changes(c, after, ["PERMISSION"], ["SUBENTITY"], held)


@query("WITH v AS (SELECT 'u' || user_id AS id, 'e' || event_id AS changeset, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) - 1 AS depth FROM events), l AS (SELECT id FROM v WHERE depth = 0 AND event_id % 3 > 0) SELECT 'ann' AS caller, id, changeset FROM v JOIN l USING (id) UNION ALL SELECT 'bob', id, changeset FROM v JOIN l USING (id) WHERE event_id % 3 > 0")
def readable_versions(s, d):
    from pyspark.sql import Window
    e = table(s, d, "events").select(F.expr("'u' || user_id").alias("id"), F.expr("'e' || event_id").alias("changeset"), "event_id")
    v = e.withColumn("depth", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("event_id"))) - 1)
    who = fixed(s, [("ann",), ("bob",)], "caller string")
    can = e.where("event_id % 3 > 0").select("id", "changeset").join(F.broadcast(who), F.lit(True))
    return N.readable_versions(v.select("id", "changeset", "depth"), can, who.where("caller = 'ann'"))


@query("SELECT 'd:' || doc_id AS doc_id, level, CASE WHEN level = 'public' THEN n_chars // 2 ELSE n_chars END AS n_chars, lang = 'en' AS is_source FROM documents, (SELECT unnest(['public', 'secret']) AS level) WHERE level = 'secret' OR doc_id % 2 = 0")
def level_versions(s, d):
    docs = table(s, d, "documents").select(F.expr("'d:' || doc_id").alias("doc_id"), "lang", "n_chars", (F.col("doc_id") % 2 == 0).alias("even"))
    hide = lambda df, level: df if level == "secret" else df.where("even")
    change = lambda df, level: df if level == "secret" else df.withColumn("n_chars", F.expr("n_chars DIV 2"))
    return N.level_versions(docs, ["public", "secret"], [hide, change], F.col("lang") == "en").select("doc_id", "level", "n_chars", "is_source")


# --- text ---
def plain_sql(h: str) -> str:
    out = rf"regexp_replace(regexp_replace({h}, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g')"
    out = rf"regexp_replace(regexp_replace(regexp_replace({out}, '(?s)<!--.*?-->', '', 'g'), '(?i)</?({T.BLOCKS})\b[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g')"
    for k, v in T.ENTITIES.items():
        out = "replace({}, '{}', '{}')".format(out, k.replace("'", "''"), v.replace("'", "''"))
    return rf"trim(regexp_replace({out}, '[\x20\t\n\f\r]+', ' ', 'g'), ' ')"


@query(f"SELECT page_id, {plain_sql('html')} AS text FROM pages")
def strip_html(s, d):
    return table(s, d, "pages").select("page_id", T.strip_html(F.col("html")).alias("text"))


@query(r"SELECT page_id, regexp_matches(html, '(?i)<article[\s/>]') AS has_article, regexp_matches(html, '(?i)<video[\s/>]') AS has_video, list_filter(flatten(list_transform(regexp_extract_all(html, '(?i)\bclass=\"([^\"]*)\"', 1), lambda c: regexp_split_to_array(c, '\s+'))), lambda c: starts_with(c, 'a')) AS class_values FROM pages")
def page_data(s, d):
    return T.extract_page_data(table(s, d, "pages"), ["article", "video"], "a").select("page_id", "has_article", "has_video", "class_values")


@query("SELECT page_id, CASE WHEN url IS NULL OR url = '' THEN 'empty' WHEN regexp_matches(url, '\\s') THEN 'space' WHEN NOT regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN 'no scheme' WHEN NOT regexp_matches(url, '^(?i)(https?|mailto):') THEN 'bad scheme' WHEN NOT regexp_matches(url, '^[A-Za-z]+://[^/?#]') THEN 'no host' END AS link_error FROM pages")
def link_report(s, d):
    return T.validate_links(table(s, d, "pages"), "url").select("page_id", "link_error")


def texts(s, d):
    return table(s, d, "documents").select("doc_id", F.coalesce("lang", F.lit("und")).alias("lang"), "text")


def index(s, d, terms=None, **more):
    return settle(I.build_token_index(texts(s, d), folded=False, terms=terms, **more))


def scores(s, d, postings=None):
    return I.bm25(index(s, d, FEW) if postings is None else postings, FEW, settle(I.text_lengths(texts(s, d))))


FEW = ["idiot", "scum"]
STEM = "regexp_replace(lower(x), '(ing|edly|ed|es|s|ly)$', '')"
INDEX = f"WITH k AS (SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(regexp_extract_all(coalesce(text, ''), '[\\p{{L}}\\p{{M}}\\p{{N}}]+(?:[.''’_][\\p{{L}}\\p{{M}}\\p{{N}}]+)*')) AS x, generate_subscripts(regexp_extract_all(coalesce(text, ''), '[\\p{{L}}\\p{{M}}\\p{{N}}]+(?:[.''’_][\\p{{L}}\\p{{M}}\\p{{N}}]+)*'), 1) - 1 AS p FROM documents), t AS (SELECT doc_id, lang, x AS exact, {STEM} AS token, p FROM k) "


@query(INDEX + "SELECT doc_id, lang, count(DISTINCT token)::BIGINT AS tokens, count(*)::BIGINT AS n, sum(p)::BIGINT AS places FROM t GROUP BY ALL")
def token_index(s, d):
    rows = I.build_token_index(texts(s, d), folded=False)
    return rows.groupBy("doc_id", "lang").agg(F.count_distinct("token").alias("tokens"), F.sum("n").alias("n"), F.sum(F.expr("aggregate(positions, 0L, (a, x) -> a + x)")).alias("places"))


@query(INDEX + "SELECT doc_id, lang FROM t GROUP BY ALL HAVING bool_or(token = 'the') AND bool_or(token = 'for') AND bool_or(token = 'idiot')")
def text_match(s, d):
    return I.text_match(index(s, d, ["the", "for", "idiot"]), ["the", "for", "idiot"])


@query(INDEX + "SELECT doc_id, lang FROM t GROUP BY ALL HAVING bool_or(token = 'the') AND bool_or(starts_with(lower(exact), 'idio'))")
def text_prefix(s, d):
    return I.text_match(index(s, d, ["the"], prefixes=["idio"]), ["the"], ["idio"])


@query(INDEX + "SELECT doc_id, lang FROM t GROUP BY ALL HAVING bool_or(token = 'idiot') AND bool_or(token = 'scum') OR doc_id IN (1, 2, 3)")
def text_match_ids(s, d):
    return I.text_match(index(s, d, ["idiot", "scum"], ids=[1, 2, 3]), ["idiot", "scum"], ids=[1, 2, 3])


@query(INDEX + "SELECT DISTINCT a.doc_id, a.lang FROM t a JOIN t b ON a.doc_id = b.doc_id AND b.p = a.p + 1 WHERE a.token = 'of' AND b.token = 'the'")
def text_phrase_stemmed(s, d):
    return I.text_phrase(index(s, d, ["of", "the"]), ["of", "the"], stemmed=True)


@query(INDEX + "SELECT DISTINCT a.doc_id, a.lang FROM t a JOIN t b ON a.doc_id = b.doc_id AND b.p = a.p + 1 WHERE lower(a.exact) = 'of' AND lower(b.exact) = 'the'")
def text_phrase(s, d):
    return I.text_phrase(index(s, d, [], exact=["of", "the"]), ["of", "the"])


BM = INDEX + """, tf AS (SELECT doc_id, lang, token, count(*) AS tf FROM t GROUP BY ALL), ln AS (SELECT doc_id, lang, count(*) AS len FROM t GROUP BY ALL), st AS (SELECT count(*) AS n, avg(len) AS mean FROM ln),
h AS (SELECT * FROM tf WHERE token IN ('idiot', 'scum')), df AS (SELECT token, count(*) AS df FROM h GROUP BY ALL),
sc AS (SELECT doc_id, lang, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS score FROM h JOIN df USING (token) JOIN ln USING (doc_id, lang), st GROUP BY ALL) """


@query(BM + "SELECT * FROM sc")
def bm25(s, d):
    return scores(s, d)


@query(BM + "SELECT * FROM sc")
def bm25_stored(s, d):
    """The index of all documents written to the shared folder, then searched: the buckets of two terms are read."""
    path = f"{shared_dir(s)}/tokens-{uuid.uuid4().hex}"
    I.write_token_index(texts(s, d), path, folded=False)
    postings, lengths, totals = I.read_token_index(s, path, FEW)
    return I.bm25(postings, FEW, lengths, totals)


@query(BM + "SELECT doc_id, max(score) + 0.1 * (sum(score) - max(score)) AS score FROM sc GROUP BY doc_id")
def best_language(s, d):
    return I.best_language(scores(s, d))


@query(BM + ", nr AS (SELECT DISTINCT a.doc_id FROM t a JOIN t b ON a.doc_id = b.doc_id AND abs(a.p - b.p) <= 6 WHERE a.token = 'idiot' AND b.token = 'scum') SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM nr) THEN 2 * score ELSE score END AS score FROM sc")
def phrase_bonus(s, d):
    i = index(s, d, FEW)
    return I.phrase_bonus(I.best_language(scores(s, d, i)), i, FEW)


@query(BM + "SELECT doc_id, score * log10(2 + 0.5 * n_chars) AS score FROM sc JOIN documents USING (doc_id)")
def boosted(s, d):
    return I.boost(I.best_language(scores(s, d)), table(s, d, "documents").select("doc_id", F.col("n_chars").alias("score")), 0.5)


@query(INDEX + "SELECT lower(strip_accents(replace(exact, 'ß', 'ss'))) AS term, count(*)::BIGINT AS n FROM t GROUP BY ALL")
def folded_terms(s, d):
    rows = table(s, d, "documents").select(F.explode(T.tokens(F.coalesce("text", F.lit("")))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return rows.groupBy(T.fold(F.col("w")).alias("term")).agg(F.sum("n").alias("n"))


@query("""WITH x AS (SELECT doc_id, lang, lower(coalesce(text, '')) AS t, length(text) >= 20 AS long FROM documents),
g AS (SELECT doc_id, lang, long, unnest(list_transform(range(1, (greatest(length(t) - 2, 1) + 1)::BIGINT), lambda i: substr(t, i, 3))) AS g FROM x),
p AS (SELECT lang, g, count(*) AS n FROM g WHERE doc_id % 4 > 0 AND lang IS NOT NULL GROUP BY ALL), u AS (SELECT lang, g, n / sqrt(sum(n * n) OVER (PARTITION BY lang)) AS w FROM p),
o AS (SELECT doc_id, g, count(*) AS n FROM g WHERE long GROUP BY ALL), s AS (SELECT doc_id, sqrt(sum(n * n)) AS size FROM o GROUP BY ALL),
c AS (SELECT doc_id, u.lang, sum(n * w) / any_value(size) AS c FROM o JOIN u USING (g) JOIN s USING (doc_id) GROUP BY ALL),
b AS (SELECT doc_id, lang, c - lead(c) OVER (PARTITION BY doc_id ORDER BY c DESC, lang DESC) AS margin, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, lang DESC) AS place FROM c)
SELECT x.doc_id, CASE WHEN b.margin IS NULL OR b.margin >= 0.05 THEN coalesce(b.lang, 'und') ELSE 'und' END AS lang FROM x LEFT JOIN b ON x.doc_id = b.doc_id AND place = 1""")
def route_language(s, d):
    docs = table(s, d, "documents")
    return I.route_language(docs.select("doc_id", "text"), docs.where("doc_id % 4 > 0").select("text", "lang"))


@query("SELECT doc_id, lang, value FROM (SELECT 'o:' || o_orderkey AS doc_id, o_orderpriority AS value, 'und' AS lang FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED' UNION ALL SELECT 'o:' || o_orderkey, c_name, 'en' FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT 'o:' || o_orderkey, printf('%.2f', o_totalprice), 'und' FROM orders)")
def text_buckets(s, d):
    names = nation_names(s, d, "customer").select("id", "lang", F.col("names")[0].alias("label"))
    return I.text_buckets(order_records(s, d), names, ["STATUS_O", "STATUS_F", "STATUS_P"])


@query("SELECT 'c:' || c_custkey AS id, 'en' AS lang, [c_name, n_name, r_name] AS display FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def display_fields(s, d):
    names = nation_names(s, d, "customer", "nation", "region").select("id", "lang", F.col("names")[0].alias("label"))
    return I.display_fields(names, ancestors(s, d)).where("id LIKE 'c:%'")


# --- quality and duplicates ---
@query("SELECT 'o:' || o_orderkey AS doc_id, 'PRIORITY' AS prop, 1::INT AS missing FROM orders WHERE o_orderpriority = '4-NOT SPECIFIED'")
def cardinality(s, d):
    c = claims(s, d, "orders").where("type <> 'unknown'")
    fields = fixed(s, [("order", "PRIORITY", 1, 1), ("order", "CUSTOMER", 1, None)], "class string, prop string, min int, max int")
    out = V.cardinality_fills(V.cardinality_violations(c, fields, orders(s, d).select("doc_id", F.lit("order").alias("class"))))
    return out.withColumn("missing", F.col("missing").cast("int"))


@query("SELECT 'o:' || l_orderkey AS doc_id, 'RETURNED' AS prop, 0::BIGINT AS n, count(*)::BIGINT AS lines FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_orderkey")
def cardinality_sub(s, d):
    c = claims(s, d, "lineitem", only={"LINE", "RETURNED", "QUANTITY"})
    fields = fixed(s, [("order", "LINE", "RETURNED", 1, 1), ("order", "LINE", "QUANTITY", 1, None)], "class string, parent string, prop string, min int, max int")
    out = V.sub_cardinality_violations(c, fields, orders(s, d).select("doc_id", F.lit("order").alias("class")))
    return out.groupBy("doc_id", "prop", "n").agg(F.count("*").alias("lines"))


@query("""SELECT * FROM (SELECT l_orderkey, l_linenumber, list_filter([CASE WHEN l_linenumber = 2 THEN 'from value with state' END, CASE WHEN l_linenumber = 1 THEN 'from missing' END, CASE WHEN l_linenumber = 3 THEN 'from precision' END, CASE WHEN l_linenumber = 1 AND l_returnflag = 'R' THEN 'from open without value' END, CASE WHEN l_linenumber > 1 AND l_returnflag = 'R' THEN 'empty' END], lambda x: x IS NOT NULL) AS errors FROM lineitem) WHERE len(errors) > 0""")
def interval_validity(s, d):
    n = F.col("l_linenumber")
    rows = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(n > 1, F.col("l_quantity")).alias("from_v"), F.when(n == 3, 0.0).otherwise(1.0).alias("from_p"), (F.col("l_returnflag") == "R").alias("from_open"), F.when(n == 2, "unknown").alias("from_state"), F.col("l_quantity").alias("to_v"), F.lit(1.0).alias("to_p"), F.lit(False).alias("to_open"), F.lit(None).cast("string").alias("to_state"))
    return V.validate_intervals(rows, "l_orderkey", "l_linenumber")


@query("WITH c AS (" + claims_sql("part") + ") SELECT doc_id, claim_id, ['precision'] AS errors FROM c WHERE prop = 'SIZE' UNION ALL SELECT doc_id, claim_id, ['confidence'] FROM c WHERE prop = 'BRAND'")
def validity(s, d):
    c = claims(s, d, "part")
    broken = c.withColumn("precision", F.when(F.col("prop") == "SIZE", -1.0).otherwise(F.col("precision"))).withColumn("confidence", F.when(F.col("prop") == "BRAND", 2.0).otherwise(F.col("confidence")))
    return V.validate_claims(broken)


@query("WITH c AS (" + claims_sql("part") + ") SELECT doc_id, ['reversed'] AS errors FROM c WHERE prop = 'PRICE'")
def range_validity(s, d):
    r = records(claims(s, d, "part").where("prop IN ('PRICE', 'SIZE')"), fixed(s, [], "id string, ancestor string, min_depth int"))
    swap = F.col("prop") == "PRICE"
    return V.validate_ranges(r.withColumns({"lo": F.when(swap, F.col("hi")).otherwise(F.col("lo")), "hi": F.when(swap, F.col("lo")).otherwise(F.col("hi"))})).select("doc_id", "errors")


@query("""WITH p AS (SELECT p_partkey AS k, p_name, p_brand, p_type, p_size, CAST(CAST(p_retailprice AS DECIMAL(18, 2)) AS VARCHAR) AS price FROM part),
m AS (SELECT a.k AS ka, b.k AS kb, CASE WHEN lower(a.p_name) = lower(b.p_name) THEN 5 ELSE 0 END + CASE WHEN a.p_brand = b.p_brand THEN 10 ELSE 0 END + CASE WHEN a.p_type = b.p_type THEN 5 ELSE 0 END + CASE WHEN a.p_size = b.p_size THEN 2 ELSE 0 END + CASE WHEN a.price = b.price THEN 2 ELSE 0 END AS score FROM p a JOIN p b ON a.k <> b.k WHERE a.k % 50 = 0)
SELECT 'p:' || ka AS a, 'p:' || kb AS b, score::BIGINT AS score, row_number() OVER (PARTITION BY ka ORDER BY score DESC, 'p:' || kb)::INT AS position FROM m WHERE score >= 4 QUALIFY position <= 20""")
def duplicates_all(s, d):
    """Queries: every row whose id is divisible by 50, against all rows."""
    c = claims(s, d, "part")
    ids = table(s, d, "part").where("p_partkey % 50 = 0").select(F.expr("'p:' || p_partkey").alias("doc_id"))
    return J.find_duplicates(c, ids, exact=True)


@query("""WITH d AS (
  SELECT o_orderkey AS k, 'o:' || o_orderkey AS id, o_custkey AS cust, o_orderstatus AS status, lower(o_orderpriority) AS priority,
    string_split('a' || o_custkey || CASE WHEN o_orderkey % 3 = 0 THEN ' x' || (o_orderkey % 5) ELSE '' END, ' ') AS code, o_custkey % 400 AS site,
    regexp_extract_all(lower(o_orderpriority) || CASE WHEN o_orderkey % 11 = 0 THEN 'x' ELSE '' END, '[a-z0-9]+') AS title,
    regexp_extract_all(lower(o_orderpriority) || ' ' || CASE WHEN o_orderkey % 2 = 0 THEN lower(o_orderstatus) ELSE '' END, '[a-z0-9]+') AS body,
    CASE WHEN o_orderkey % 20 = 0 THEN 'n:' || (o_orderkey % 25) ELSE 'c:' || o_custkey END AS ref, 'n:' || c_nationkey AS nation,
    CASE WHEN o_orderkey % 20 = 0 THEN NULL ELSE 'c:' || o_custkey END AS direct, floor(o_totalprice / 1000) * 1000 AS total, CASE WHEN o_orderkey % 7 = 0 THEN 5000 ELSE 500 END AS half,
    CASE WHEN o_orderkey % 9 = 0 THEN date_trunc('month', o_orderdate) ELSE date_trunc('day', o_orderdate) END AS t0,
    CASE WHEN o_orderkey % 9 = 0 THEN date_trunc('month', o_orderdate) + INTERVAL 1 MONTH ELSE date_trunc('day', o_orderdate) + INTERVAL 1 DAY END AS t1,
    o_orderkey % 10 = 3 OR o_orderkey % 50 = 0 AS apart
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey),
titles AS (SELECT DISTINCT title FROM d),
near AS (
  SELECT a.title AS x, b.title AS y FROM titles a, titles b
  WHERE len(list_filter(a.title, lambda p: len(list_filter(b.title, lambda q: levenshtein(p, q) <= CASE WHEN length(p) < 3 THEN 0 WHEN length(p) < 6 THEN 1 ELSE 2 END)) = 0)) = 0),
m AS (
  SELECT a.id AS a, b.id AS b,
    CASE WHEN a.code[1] = b.code[1] AND (len(a.code) = 1 OR (len(b.code) = 2 AND a.code[2] = b.code[2])) THEN 10 ELSE 0 END
    + CASE WHEN a.site = b.site THEN 6 ELSE 0 END + CASE WHEN near.x IS NOT NULL THEN 5 ELSE 0 END + CASE WHEN list_has_all(b.body, a.body) THEN 1 ELSE 0 END
    + CASE WHEN a.ref = b.ref OR (b.direct IS NOT NULL AND a.ref = b.nation) OR (b.ref[:2] = 'n:' AND a.ref = b.ref) THEN 2 ELSE 0 END
    + CASE WHEN a.total - a.half < b.total + b.half AND b.total - b.half < a.total + a.half THEN 2 ELSE 0 END
    + CASE WHEN a.t0 < b.t1 AND b.t0 < a.t1 THEN 2 ELSE 0 END + CASE WHEN a.status = b.status THEN 1 ELSE 0 END AS score
  FROM d a JOIN d b ON a.k % 50 = 0 AND a.k <> b.k LEFT JOIN near ON near.x = a.title AND near.y = b.title
  WHERE NOT (a.apart AND b.k = a.k + 7) AND NOT (b.apart AND a.k = b.k + 7))
SELECT a, b, score::BIGINT AS score, row_number() OVER (PARTITION BY a ORDER BY score DESC, b)::INT AS position FROM m WHERE score >= 4 QUALIFY position <= 20""")
def duplicates_whole(s, d):
    """Agreement of every kind at once, against documents whose identifiers, titles and states thousands of others share."""
    ids = table(s, d, "orders").where("o_orderkey % 50 = 0").select(F.expr("'o:' || o_orderkey").alias("doc_id"))
    return J.find_duplicates(claims(s, d, "dossiers"), ids, distinct_prop="DISTINCT_FROM", ancestors=ancestors(s, d))


@query("""WITH w AS (
  SELECT o_orderkey AS id, o_orderstatus AS prop, epoch(o_orderdate)::DOUBLE AS lo,
    CASE o_orderkey % 4 WHEN 0 THEN 1e300 WHEN 1 THEN epoch(o_orderdate) + 3e7 WHEN 2 THEN epoch(o_orderdate) ELSE epoch(o_orderdate) + 9e4 END::DOUBLE AS hi FROM orders)
SELECT a.id AS a_id, b.id AS b_id, a.prop FROM w a JOIN w b ON a.prop = b.prop AND greatest(a.lo, b.lo) < (CASE WHEN a.lo = a.hi THEN a.hi + 1 ELSE a.hi END) AND greatest(a.lo, b.lo) < (CASE WHEN b.lo = b.hi THEN b.hi + 1 ELSE b.hi END) WHERE a.id % 500 = 0""")
def overlap_any_length(s, d):
    """Points, days, years and open ends together; queries: every row whose id is divisible by 500, against all rows."""
    t = F.col("o_orderdate").cast("timestamp").cast("double")
    hi = F.when(F.col("o_orderkey") % 4 == 0, 1e300).when(F.col("o_orderkey") % 4 == 1, t + 3e7).when(F.col("o_orderkey") % 4 == 2, t).otherwise(t + 9e4)
    w = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("prop"), t.alias("lo"), hi.alias("hi"))
    return J.overlap_join(w.where("id % 500 = 0"), w, 86_400.0)


@query("WITH w AS (SELECT p_partkey AS id, p_brand AS prop, p_retailprice - 0.5 AS lo, p_retailprice + 0.5 AS hi FROM part) SELECT a.id AS a_id, b.id AS b_id, a.prop FROM w a JOIN w b ON a.prop = b.prop AND a.lo < b.hi AND b.lo < a.hi WHERE a.id % 50 = 0")
def duplicates_overlap(s, d):
    w = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("prop"), (F.col("p_retailprice") - 0.5).alias("lo"), (F.col("p_retailprice") + 0.5).alias("hi"))
    return J.overlap_join(w.where("id % 50 = 0"), w, 1.0)


BODY = "SELECT {k} AS id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{M}}\\p{{N}}]+(?:[.''’_][\\p{{L}}\\p{{M}}\\p{{N}}]+)*')) AS w FROM {t}"


@query(f"WITH b AS ({BODY.format(k='item_id', t='benchmark')}), x AS ({BODY.format(k='doc_id', t='documents')}) SELECT b.id AS item_id, x.id AS doc_id FROM b JOIN x ON list_has_all(x.w, b.w) WHERE len(b.w) > 0")
def duplicates_body(s, d):
    t = F.array_distinct(T.tokens(F.lower(F.coalesce("text", F.lit("")))))
    a = table(s, d, "benchmark").select(F.concat(F.lit("b"), F.col("item_id")).alias("id"), t.alias("tokens"))
    b = table(s, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id")).alias("id"), t.alias("tokens"))
    return J.body_agreement(a, b).select(F.substring("a_id", 2, 20).cast("long").alias("item_id"), F.substring("b_id", 2, 20).cast("long").alias("doc_id"))


@query("WITH p AS (SELECT DISTINCT p_name AS id, list_distinct(string_split(p_name, ' ')) AS t FROM part), q AS (SELECT id || '!' AS id, list_transform(t, lambda x: x || 'x') AS t FROM p), m AS (SELECT a.id AS a_id, b.id AS b_id, len(a.t) AS need, count(DISTINCT x) AS n FROM p a, q b, LATERAL (SELECT unnest(a.t) AS x), LATERAL (SELECT unnest(b.t) AS y) WHERE levenshtein(x, y) <= CASE WHEN length(x) < 3 THEN 0 WHEN length(x) < 6 THEN 1 ELSE 2 END GROUP BY ALL) SELECT a_id, b_id FROM m WHERE need = n")
def duplicates_fuzzy(s, d):
    p = table(s, d, "part").select(F.col("p_name").alias("id"), F.split("p_name", " ").alias("tokens")).distinct()
    return J.fuzzy_join(p, p.select(F.concat("id", F.lit("!")).alias("id"), F.transform("tokens", lambda x: F.concat(x, F.lit("x"))).alias("tokens")))
