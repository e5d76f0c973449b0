"""The versioned store as queries: changes, views, commits. A changes row is (changeset, id, revision, parents, data); data null
is a deletion. A views row is (view, revision, name, path): path from the view itself to its root."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tessella.sources.settle import settle


def current_revisions(changes: DataFrame, keys: list[str]) -> DataFrame:
    """The row with the highest revision of each key."""
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*changes.columns), "revision").alias("r")).select("r.*")


def check_changes(changes: DataFrame, committed: DataFrame, new: DataFrame) -> DataFrame:
    """new with error: its changeset is committed already, a parent lacks the id, or it is a duplicate; null when accepted."""
    done = committed.select("changeset").distinct().withColumn("__done", F.lit(True))
    have = changes.select("id", F.col("changeset").alias("parent")).distinct()
    lack = new.select("changeset", "id", F.explode("parents").alias("parent")).join(have, ["id", "parent"], "left_anti").select("changeset", "id").distinct().withColumn("__lack", F.lit(True))
    old = changes.select("changeset", "id").distinct().withColumn("__old", F.lit(True))
    rows = new.join(done, "changeset", "left").join(lack, ["changeset", "id"], "left").join(old, ["changeset", "id"], "left")
    again = F.count("*").over(Window.partitionBy("changeset", "id")) > 1
    return rows.withColumn("error", F.when(F.col("__done"), "committed").when(F.col("__lack"), "no parent").when(F.col("__old") | again, "duplicate")).drop("__done", "__lack", "__old")


def _up(start: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, changeset, depth): versions reachable from start(id, changeset, depth 0) by edges(id, changeset, parent), least depth."""
    edges = settle(edges, "parents")
    known = front = settle(start, "reached")
    while True:
        step = front.join(edges, ["id", "changeset"]).select("id", F.col("parent").alias("changeset"), (F.col("depth") + 1).alias("depth")).groupBy("id", "changeset").agg(F.min("depth").alias("depth"))
        front = settle(step.join(known, ["id", "changeset"], "left_anti"), "front")
        if front.isEmpty():
            return known.groupBy("id", "changeset").agg(F.min("depth").alias("depth"))
        known = settle(known.unionByName(front), "reached")


def _parents(changes: DataFrame) -> DataFrame:
    return changes.select("id", "changeset", F.explode("parents").alias("parent")).distinct()


def committed_values(changes: DataFrame, heads: DataFrame) -> DataFrame:
    """(id, changeset, depth): every version below the heads(id, changeset) of a view, at its smallest depth. Parents always have
    smaller depth numbers on some path only, so depths settle when no version is new."""
    return _up(heads.select("id", "changeset", F.lit(0).alias("depth")), _parents(changes))


def commit_plan(changes: DataFrame, wanted: DataFrame, committed: DataFrame) -> DataFrame:
    """Changesets to commit: wanted(changeset) and all their ancestors that the view doesn't have."""
    rows = changes.select("changeset", F.explode_outer("parents").alias("parent")).distinct()
    edges = settle(rows.where("parent IS NOT NULL"), "parents")
    known = front = settle(wanted.select("changeset").join(committed.select("changeset"), "changeset", "left_anti").distinct(), "plan")
    while True:
        front = settle(front.join(edges, "changeset").select(F.col("parent").alias("changeset")).distinct().join(known, "changeset", "left_anti").join(committed.select("changeset"), "changeset", "left_anti"), "front")
        if front.isEmpty():
            return known
        known = settle(known.unionByName(front), "plan")


def head_conflicts(values: DataFrame) -> DataFrame:
    """(view, id, heads): ids with more than one head."""
    return values.where("depth = 0").groupBy("view", "id").agg(F.count("*").alias("heads")).where("heads > 1")


def latest_in_view(path: DataFrame, values: DataFrame) -> DataFrame:
    """Of values(view, id, ...) the ones of the nearest view of path(view, position) that has the id."""
    rows = values.join(path, "view")
    return rows.groupBy("id").agg(F.min_by(F.struct(*rows.columns), "position").alias("r")).select("r.*")


def snapshot(path: DataFrame, heads: DataFrame, changes: DataFrame) -> DataFrame:
    """(id, changeset, data, deleted) as a view shows it: the nearest head's current revision."""
    top = latest_in_view(path, heads).select("id", "changeset")
    rows = top.join(current_revisions(changes, ["id", "changeset"]).select("id", "changeset", "data"), ["id", "changeset"])
    return rows.withColumn("deleted", F.col("data").isNull())


def count_values(shown: DataFrame, deleted: bool = False) -> DataFrame:
    """(n): live values of a snapshot, or all of them."""
    return shown.agg((F.count("*") if deleted else F.count("data")).alias("n"))


def at_version(changes: DataFrame, versions: DataFrame) -> DataFrame:
    """The change of each (id, changeset[, revision]) of versions; without a revision the current one."""
    if "revision" in versions.columns:
        return changes.join(versions, ["id", "changeset", "revision"], "left_semi")
    return current_revisions(changes, ["id", "changeset"]).join(versions, ["id", "changeset"], "left_semi")


def history(values: DataFrame, id_: str) -> DataFrame:
    """A value's versions by depth, then changeset."""
    return values.where(F.col("id") == id_).orderBy("depth", "changeset")


def view_paths(views: DataFrame, parent: str, new: str) -> DataFrame:
    """The current row of the new view under parent: its path and, as released, the names that other views hold no longer."""
    now = current_revisions(views, ["view"])
    return now.where(F.col("view") == parent).select(F.lit(new).alias("view"), F.array_prepend("path", F.lit(new)).alias("path"))


def paths_below(views: DataFrame, new: DataFrame) -> DataFrame:
    """(view, path) of many new(view, parent) at once; one whose parent doesn't exist gives no row."""
    now = current_revisions(views, ["view"]).select(F.col("view").alias("parent"), "path")
    return new.join(now, "parent").select("view", F.array_prepend("path", F.col("view")).alias("path"))


def released_names(views: DataFrame) -> DataFrame:
    """Names of earlier revisions that no current revision has."""
    return views.select("name").where("name IS NOT NULL").distinct().join(current_revisions(views, ["view"]).select("name"), "name", "left_anti")


def changes_of(changes: DataFrame, changeset: str) -> DataFrame:
    return current_revisions(changes.where(F.col("changeset") == changeset), ["id", "changeset"])


def views_of(committed: DataFrame, changeset: str) -> DataFrame:
    return committed.where(F.col("changeset") == changeset).select("view").distinct()


def discardable(changes: DataFrame, committed: DataFrame) -> DataFrame:
    """Changesets that are neither committed nor a parent of another."""
    every = changes.select("changeset").distinct()
    parents = changes.select("changeset", F.explode("parents").alias("p")).where("p <> changeset").select(F.col("p").alias("changeset"))
    return every.join(committed.select("changeset"), "changeset", "left_anti").join(parents, "changeset", "left_anti")


def upsert_documents(latest: DataFrame, docs: DataFrame, changeset: str) -> DataFrame:
    """Changes that insert docs(id, data) or replace their latest(id, changeset, data) version; equal data make none."""
    rows = docs.join(latest.select("id", F.col("changeset").alias("__parent"), F.col("data").alias("__old")), "id", "left").where(~F.col("data").eqNullSafe(F.col("__old")))
    parents = F.when(F.col("__parent").isNull(), F.expr("CAST(array() AS array<string>)")).otherwise(F.array("__parent"))
    return rows.select(F.lit(changeset).alias("changeset"), "id", F.lit(1).alias("revision"), parents.alias("parents"), "data")


def replay_patches(base: DataFrame, patches: DataFrame) -> DataFrame:
    """Claims after patches: base(doc_id, claim_id, parent_claim_id, value) and patches(doc_id, op, kind, claim_id, parent_claim_id,
    value) with kind add, set, cast or remove. The last operation on a claim wins (a set without a value keeps the earlier one);
    a removed claim takes what is below it along."""
    first = base.select("doc_id", "claim_id", F.lit(-1).alias("op"), F.lit("add").alias("kind"), "parent_claim_id", "value")
    rows = first.unionByName(patches.select(*first.columns))
    last = rows.groupBy("doc_id", "claim_id").agg(
        F.max_by("kind", "op").alias("kind"), F.max_by("value", F.when(F.col("value").isNotNull(), F.col("op"))).alias("value"),
        F.max_by("parent_claim_id", F.when(F.col("parent_claim_id").isNotNull(), F.col("op"))).alias("parent_claim_id"),
    )
    last = settle(last, "replayed")
    gone = front = settle(last.where("kind = 'remove'").select("doc_id", "claim_id"), "removed")
    while True:
        front = settle(last.join(front.withColumnRenamed("claim_id", "parent_claim_id"), ["doc_id", "parent_claim_id"], "left_semi").select("doc_id", "claim_id").join(gone, ["doc_id", "claim_id"], "left_anti"), "removed")
        if front.isEmpty():
            break
        gone = settle(gone.unionByName(front), "removed")
    return last.join(gone, ["doc_id", "claim_id"], "left_anti").select("doc_id", "claim_id", "parent_claim_id", "value")


def validate_patches(patches: DataFrame) -> DataFrame:
    """patches(session, op, base, claim_id, kind, value) with error: base isn't session and number, an operation number is skipped
    or repeated, an add without a value."""
    w = Window.partitionBy("session").orderBy("op")
    wrong = F.col("base") != F.concat_ws("/", "session", F.col("op").cast("string"))
    return patches.withColumn("error", F.when(F.row_number().over(w) != F.col("op"), "number").when(wrong, "base").when((F.col("kind") == "add") & F.col("value").isNull(), "incomplete"))


def number_operations(ops: DataFrame, session: str = "session", order: list[str] = ("at",)) -> DataFrame:
    """ops with operation: 1, 2, ... within each session."""
    return ops.withColumn("operation", F.row_number().over(Window.partitionBy(session).orderBy(*order)))


def open_sessions(sessions: DataFrame, ops: DataFrame, meta: dict[str, str]) -> DataFrame:
    """Sessions without an end, with their last operation, whose JSON metadata hold all of meta."""
    last = ops.groupBy("session").agg(F.max_by(F.struct("operation", "data"), "operation").alias("last"))
    here = sessions.where("end_metadata IS NULL")
    for k, v in meta.items():
        here = here.where(F.get_json_object("begin_metadata", f"$.{k}") == v)
    return here.join(last, "session", "left").select("session", F.col("last.operation").alias("operation"), F.col("last.data").alias("data"))


def contributors(ops: DataFrame, by: str = "session", user: str = "user") -> DataFrame:
    return ops.groupBy(by).agg(F.sort_array(F.collect_set(user)).alias("contributors"))
