"""Hierarchies and labels: closures, paths, expansion of references to ancestors, leaves, display labels.

An edge frame is (id, parent). Closures are frontier joins that stop when no pair is new, so cycles end; each round is written to
the shared folder, so its plan stays small and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessella.functions.values import time_starts
from tessella.operators.claims import FLOOR, shuffled
from tessella.sources.settle import settle


def edges_of(claims: DataFrame, props: list[str], floor: float = FLOOR) -> DataFrame:
    """(id, parent) of top-level references of the properties."""
    rows = claims.where((F.col("type") == "ref") & F.col("prop").isin(props) & (F.col("confidence") >= floor) & (F.col("depth") == 0))
    return rows.select(F.col("doc_id").alias("id"), F.col("to").alias("parent")).where("id <> parent").distinct()


def value_ancestors(edges: DataFrame) -> DataFrame:
    """(id, ancestor, min_depth): the transitive closure with the shortest distance; an id is not its own ancestor."""
    edges = settle(edges.select("id", "parent").distinct(), "edges")
    known = front = settle(edges.select("id", F.col("parent").alias("ancestor"), F.lit(1).alias("min_depth")), "closure")
    depth = 1
    while True:
        depth += 1
        up = edges.select(F.col("id").alias("ancestor"), "parent")
        step = front.select("id", "ancestor").join(shuffled(up), "ancestor").select("id", F.col("parent").alias("ancestor")).where("id <> ancestor").distinct()
        front = settle(step.join(shuffled(known), ["id", "ancestor"], "left_anti").withColumn("min_depth", F.lit(depth)), "front")
        if front.isEmpty():
            return known
        known = settle(known.unionByName(front), "closure")


def property_closure(edges: DataFrame) -> DataFrame:
    """(id, descendant, depth) of a property hierarchy given as (id, parent)."""
    return value_ancestors(edges).select(F.col("ancestor").alias("id"), F.col("id").alias("descendant"), F.col("min_depth").alias("depth"))


def ordered_children(edges: DataFrame, orders: DataFrame) -> DataFrame:
    """(id, child, position): the direct children of each property by the order that they state, orders(id, order), then by id; those
    that state none come last. A child of several parents has a place under each; loops are left out."""
    rows = edges.where("id <> parent").select(F.col("id").alias("child"), F.col("parent").alias("id")).distinct()
    stated = orders.groupBy(F.col("id").alias("child")).agg(F.min("order").alias("order"))
    w = Window.partitionBy("id").orderBy(F.asc_nulls_last("order"), "child")
    return rows.join(stated, "child", "left").withColumn("position", F.row_number().over(w)).select("id", "child", "position")


def hierarchy_props(closure: DataFrame, root: str, minus: list[str]) -> DataFrame:
    """Properties that are value hierarchies: those under root, without the ones named and what lies under these."""
    under = closure.where(F.col("id") == root).select(F.col("descendant").alias("prop"))
    out = closure.where(F.col("id").isin(minus)).select(F.col("descendant").alias("prop"))
    return under.join(out, "prop", "left_anti").where(~F.col("prop").isin(minus))


def _above(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, parent): the edges at or above ids."""
    seen = front = settle(ids.select("id").distinct(), "front")
    found = None
    while not front.isEmpty():
        step = settle(edges.join(front, "id", "left_semi"), "above")
        found = step if found is None else found.unionByName(step)
        front = settle(step.select(F.col("parent").alias("id")).distinct().join(seen, "id", "left_anti"), "front")
        seen = seen.unionByName(front)
    return edges.limit(0) if found is None else found


def id_paths(edges: DataFrame, ids: DataFrame, cap: int = 100) -> DataFrame:
    """(id, id_path): all paths from a root to each id of ids, at most cap for an id: the first ones in order.

    Paths grow from the roots down. A value whose parents all have their lists extends these by itself, merges them and keeps the
    first cap. Simple paths of one parent keep their order when they are extended, so the first cap of each parent are enough for
    the first cap of the value: lists stay bounded and the result is exact, however many paths there are.

    Values on a cycle, or below one, never have all parents done. Their paths are followed upwards, a parent that is on the path
    already is not followed again, and a cycle without a root keeps the cut paths; these are all made before the cap applies.
    """
    edges = settle(edges.where("id <> parent").select("id", "parent").distinct(), "edges")
    up = settle(_above(edges, ids), "edges")
    nodes = settle(ids.select("id").unionByName(up.select(F.col("parent").alias("id"))).distinct(), "nodes")
    new = settle(nodes.join(up, "id", "left_anti").select("id", F.array(F.array("id")).alias("paths")), "paths")
    lists, left = new, up
    while not new.isEmpty():
        # edges whose parent has no list yet hold their value back
        left = settle(left.join(new.select(F.col("id").alias("parent")), "parent", "left_anti"), "left")
        ready = up.select("id").distinct().join(left, "id", "left_anti").join(lists, "id", "left_anti")
        given = up.join(ready, "id", "left_semi").join(lists.select(F.col("id").alias("parent"), "paths"), "parent")
        merged = given.select("id", F.explode(F.transform("paths", lambda p: F.concat(p, F.array("id")))).alias("p")).withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("p"))).where(F.col("n") <= cap)
        new = settle(merged.groupBy("id").agg(F.sort_array(F.collect_list("p")).alias("paths")), "paths")
        lists = lists.unionByName(new)
    wanted = ids.select("id").distinct()
    out = lists.join(wanted, "id", "left_semi").select("id", F.explode("paths").alias("id_path"))
    rest = settle(wanted.join(lists, "id", "left_anti"), "cyclic")
    return out if rest.isEmpty() else out.unionByName(_cyclic_paths(up, rest, cap))


def _cyclic_paths(up: DataFrame, ids: DataFrame, cap: int) -> DataFrame:
    """id_paths() of values on or below cycles."""
    up = up.select(F.col("id").alias("top"), "parent")
    open_ = ids.select("id", F.col("id").alias("top"), F.array("id").alias("id_path"))
    done = None
    while True:
        rows = open_.join(up, "top", "left")
        more = F.col("parent").isNotNull() & ~F.array_contains("id_path", F.col("parent"))
        rows = settle(rows.withColumn("more", more), "paths")
        ended = rows.where("NOT more").select("id", "id_path").distinct()
        # a path that a cut parent ended is complete only where no other parent went on
        going = rows.where("more").select("id", "id_path").distinct()
        ended = ended.join(going, ["id", "id_path"], "left_anti")
        done = ended if done is None else done.unionByName(ended)
        open_ = rows.where("more").select("id", F.col("parent").alias("top"), F.concat(F.array("parent"), F.col("id_path")).alias("id_path"))
        if open_.isEmpty():
            break
    w = Window.partitionBy("id").orderBy("id_path")
    return done.withColumn("n", F.row_number().over(w)).where(F.col("n") <= cap).drop("n")


def label_paths(paths: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, id_path, lang, label_path): labels(id, lang, label) in step with the ids; an id without a label stands for itself."""
    steps = paths.select("id", "id_path", F.posexplode("id_path").alias("pos", "step"))
    langs = [r.lang for r in labels.select("lang").distinct().limit(1001).collect()]
    if len(langs) > 1000:
        raise ValueError("label_paths() takes labels of at most 1,000 languages")
    in_all = steps.withColumn("lang", F.explode(F.array(*[F.lit(x) for x in langs]).cast("array<string>")))
    named = in_all.join(labels.select(F.col("id").alias("step"), "lang", "label"), ["step", "lang"], "left")
    return named.groupBy("id", "id_path", "lang").agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("label", "step").alias("l")))).alias("s")).select("id", "id_path", "lang", F.expr("transform(s, x -> x.l)").alias("label_path"))


def expand_refs(claims: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Each reference once for its target and once for each ancestor of it; direct marks the first."""
    refs = claims.where("type = 'ref'").withColumn("direct", F.lit(True))
    up = refs.join(shuffled(ancestors.select(F.col("id").alias("to"), "ancestor")), "to").withColumns({"to": F.col("ancestor"), "direct": F.lit(False)}).drop("ancestor")
    return refs.unionByName(up)


def mark_leaves(records: DataFrame, scope: list[str] = ["doc_id", "parent_claim_id", "prop"]) -> DataFrame:  # noqa: B006
    """expand_refs() rows with is_leaf: no other value of the scope (document, or parent claim, and property) lies below it."""
    key = [F.coalesce(F.col(c), F.lit("")).alias(f"__{c}") for c in scope]
    inner = records.where("NOT direct").select(*key, F.col("to").alias("__to")).distinct().withColumn("__inner", F.lit(True))
    on = [F.coalesce(records[c], F.lit("")) == inner[f"__{c}"] for c in scope] + [records["to"] == inner["__to"]]
    return records.join(shuffled(inner), on, "left").withColumn("is_leaf", F.col("__inner").isNull()).drop("__inner", "__to", *[f"__{c}" for c in scope])


def with_labels(records: DataFrame, labels: DataFrame, lang: str) -> DataFrame:
    """records with to_display, the label of the target in a language."""
    return records.join(labels.where(F.col("lang") == lang).select(F.col("id").alias("to"), F.col("label").alias("to_display")), "to", "left")


def naming_strings(claims: DataFrame, props: list[str], floor: float = FLOOR) -> DataFrame:
    """(id, lang, names): the strings of naming properties of each document and language, surest first."""
    rows = claims.where(F.col("prop").isin(props) & (F.col("type") == "string") & (F.col("confidence") >= floor) & (F.col("depth") == 0))
    item = F.struct((-F.col("confidence")).alias("c"), "ord", F.col("str_value").alias("s"))
    return rows.groupBy(F.col("doc_id").alias("id"), F.coalesce("lang", F.lit("und")).alias("lang")).agg(F.sort_array(F.collect_list(item)).alias("x")).select("id", "lang", F.expr("transform(x, y -> y.s)").alias("names"))


def display_labels(names: DataFrame, lang: str, chain: list[str], rules: dict[str, Column] | None = None, classes: DataFrame | None = None) -> DataFrame:
    """(id, label): the rule of the document's class where it gives a label, else the best name in lang or its fallback chain.

    rules maps a class to a Column over naming_strings(); classes is (id, class).
    """
    order = [lang, *chain, "und"]
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("lang"))
    rows = names.withColumn("place", place).where("place > 0")
    if rules:
        rows = rows.join(classes, "id", "left")
        made = F.lit(None).cast("string")
        for name, column in rules.items():
            made = F.when(F.col("class") == name, column).otherwise(made)
    else:
        made = F.lit(None).cast("string")
    rows = rows.withColumn("label", F.coalesce(made, F.col("names")[0]))
    return rows.groupBy("id").agg(F.min_by("label", F.struct("place", "label")).alias("label"))


def chain_label(labels: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(id, label): "Name, Parent, Grandparent" up to depth containing documents; of several parents the smallest id."""
    up = edges.groupBy("id").agg(F.min("parent").alias("parent"))
    rows = labels.select("id", "label", F.col("id").alias("at"))
    for _ in range(depth):
        parent = up.select(F.col("id").alias("at"), "parent")
        name = labels.select(F.col("id").alias("parent"), F.col("label").alias("name"))
        rows = rows.join(parent, "at", "left").join(name, "parent", "left").select("id", F.concat_ws(", ", "label", "name").alias("label"), F.col("parent").alias("at"))
    return rows.select("id", "label")


def propagate_props(claims: DataFrame, closure: DataFrame) -> DataFrame:
    """claims with a copy for each ancestor of their property; closure is property_closure()."""
    up = claims.join(closure.select(F.col("descendant").alias("prop"), F.col("id").alias("__up")), "prop").withColumn("prop", F.col("__up")).drop("__up")
    return claims.unionByName(up)


def earliest_sub_interval(claims: DataFrame, prop: str, sub: str) -> DataFrame:
    """(doc_id, claim_id, to): of each document's references the one whose sub-claim starts first; without any, the surest."""
    subs = time_starts(claims.where((F.col("prop") == sub) & (F.col("depth") == 1)).select("parent_claim_id", "raw", "time_precision"))
    starts = subs.groupBy(F.col("parent_claim_id").alias("claim_id")).agg(F.min("lo").alias("start"))
    rows = claims.where((F.col("prop") == prop) & (F.col("type") == "ref") & (F.col("depth") == 0)).join(starts, "claim_id", "left")
    w = Window.partitionBy("doc_id").orderBy(F.asc_nulls_last("start"), F.desc("confidence"), "ord", "claim_id")
    return rows.withColumn("n", F.row_number().over(w)).where("n = 1").select("doc_id", "claim_id", "to")


def sort_keys(labelled: DataFrame) -> DataFrame:
    """label_paths() rows with sort_key: lower-cased labels joined, then the hexadecimal id path, so the key reads back to ids."""
    return labelled.withColumn("sort_key", F.concat(F.lower(F.array_join("label_path", "\x1f")), F.lit("\x1e"), F.hex(F.array_join("id_path", "\x1f").cast("binary"))))


def ids_of_sort_key(key: Column) -> Column:
    return F.split(F.unhex(F.element_at(F.split(key, "\x1e"), -1)).cast("string"), "\x1f")


def effective_fields(has_class: DataFrame, superclasses: DataFrame, fields: DataFrame) -> DataFrame:
    """(doc_id, prop, min, max, from_class): the fields of a document's classes and all their super-classes, each property once:
    the declaration nearest to the document (by walk depth, then class id)."""
    own = has_class.select("doc_id", F.col("class").alias("from_class"), F.lit(0).alias("d"))
    up = has_class.join(superclasses.select(F.col("id").alias("class"), F.col("ancestor").alias("from_class"), F.col("min_depth").alias("d")), "class").select("doc_id", "from_class", "d")
    rows = own.unionByName(up).join(fields.withColumnRenamed("class", "from_class"), "from_class")
    w = Window.partitionBy("doc_id", "prop").orderBy("d", "from_class")
    return rows.withColumn("n", F.row_number().over(w)).where("n = 1").select("doc_id", "prop", "min", "max", "from_class")
