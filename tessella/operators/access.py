"""Access control as data: who may read or change which documents, by roles, grants and claims."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tessella.operators.claims import claim_signature, shuffled, spread_join


def level_versions(docs: DataFrame, levels: list[str], hooks: list[Callable[[DataFrame, str], DataFrame]] = (), source: Column | None = None) -> DataFrame:
    """docs once for each level, passed through the hooks (which change rows or drop them) with is_source. The last level must keep all."""
    out = None
    for level in levels:
        rows = docs
        for hook in hooks:
            rows = hook(rows, level)
        rows = rows.withColumns({"level": F.lit(level), "is_source": F.lit(True) if source is None else source})
        out = rows if out is None else out.unionByName(rows)
    top = out.where(F.col("level") == levels[-1]).select("doc_id")
    if not docs.select("doc_id").join(top, "doc_id", "left_anti").isEmpty():
        raise ValueError(f"level {levels[-1]} must keep all documents")
    return out


def finalize(claims: DataFrame, hooks: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    for hook in hooks:
        claims = claims.transform(hook)
    return claims


def readable_roles(docs: DataFrame, scopes: DataFrame, grants: DataFrame) -> DataFrame:
    """(doc_id, role): roles with a grant on everything (grants.prop null), or with all values that the document has of a scope
    property granted: scopes(doc_id, prop, value), grants(role, prop, value)."""
    # each of these roles is a row of every document, so one row of them goes along with the documents, without a join
    open_ = grants.where("prop IS NULL").select(F.collect_set("role")).scalar()
    every = docs.select("doc_id", open_.alias("__roles")).select("doc_id", F.explode("__roles").alias("role"))
    some = scopes.distinct()
    need = some.groupBy("doc_id", "prop").agg(F.count("*").alias("need"))
    have = spread_join(some, grants.where("prop IS NOT NULL").distinct(), ["prop", "value"]).groupBy("doc_id", "prop", "role").agg(F.count("*").alias("have"))
    covered = have.join(need, ["doc_id", "prop"]).where("have = need").select("doc_id", "role")
    return every.select("doc_id", "role").unionByName(covered).distinct()


def claim_grants(claims: DataFrame, prop: str, action_prop: str = "ACTION") -> DataFrame:
    """(doc_id, user, action): users named by the document's own permission claims; create is never granted so."""
    subs = claims.where(F.col("prop") == action_prop).select(F.col("parent_claim_id").alias("claim_id"), F.col("str_value").alias("action"))
    rows = claims.where((F.col("prop") == prop) & (F.col("type") == "ref")).join(shuffled(subs), "claim_id").where("action <> 'create'")
    return rows.select("doc_id", F.col("to").alias("user"), "action").distinct()


def permitted(caller_roles: DataFrame, roles: DataFrame, own: DataFrame, needs: dict[str, list[str]], action: str) -> DataFrame:
    """(caller, doc_id): callers holding the action and all that it needs: roles(doc_id, role, action) through caller_roles(caller,
    role), or own(doc_id, user, action)."""
    wanted = sorted({action, *needs.get(action, [])})
    held = spread_join(roles.where(F.col("action").isin(wanted)), caller_roles, ["role"]).select("caller", "doc_id", "action")
    held = held.unionByName(own.where(F.col("action").isin(wanted)).select(F.col("user").alias("caller"), "doc_id", "action"))
    return held.distinct().groupBy("caller", "doc_id").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select("caller", "doc_id")


def read_access(docs: DataFrame, roles: list[str], subject: str | None) -> DataFrame:
    """docs that name one of the roles in readable_roles, or the subject in readable_users."""
    mine = F.arrays_overlap("readable_roles", F.array(*[F.lit(r) for r in roles])) if roles else F.lit(False)
    return docs.where(F.coalesce(mine, F.lit(False)) | (F.coalesce(F.array_contains("readable_users", subject), F.lit(False)) if subject else F.lit(False)))


def caller_levels(caller_roles: DataFrame, levels: DataFrame) -> DataFrame:
    """(caller, level): the highest level of levels(role, level, rank) that one of a caller's roles gives."""
    return caller_roles.join(levels, "role").groupBy("caller").agg(F.max_by("level", "rank").alias("level"))


def source_flags(docs: DataFrame, roles: DataFrame, audiences: DataFrame) -> DataFrame:
    """(doc_id, level, is_source): whether every role of audiences(level, role) may read the document: roles(doc_id, role)."""
    listed = audiences.select(F.collect_set(F.struct("level", "role"))).scalar()
    want = docs.select("doc_id", listed.alias("__all")).select("doc_id", F.explode("__all").alias("a")).select("doc_id", "a.level", "a.role")
    have = roles.select("doc_id", "role").distinct().withColumn("ok", F.lit(True))
    return want.join(have, ["doc_id", "role"], "left").groupBy("doc_id", "level").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("is_source"))


def audit_changes(before: DataFrame, after: DataFrame, permission_props: list[str], scope_props: list[str], held: DataFrame) -> DataFrame:
    """(doc_id, kind): kinds of change (permission, scope, other) that a document underwent without held(doc_id, action) of that kind."""
    a, b = (claim_signature(x, with_id=True).select("doc_id", "prop", "signature") for x in (before, after))
    changed = a.exceptAll(b).unionByName(b.exceptAll(a))
    kind = F.when(F.col("prop").isin(permission_props), "permission").when(F.col("prop").isin(scope_props), "scope").otherwise("other")
    return changed.select("doc_id", kind.alias("kind")).distinct().join(held.select("doc_id", F.col("action").alias("kind")), ["doc_id", "kind"], "left_anti")


def readable_versions(versions: DataFrame, readable: DataFrame, historic: DataFrame) -> DataFrame:
    """(caller, id, changeset) of versions(id, changeset, depth): the latest must be readable(caller, id, changeset), and so must the
    version itself unless the caller is in historic(caller)."""
    latest = versions.where("depth = 0").join(readable, ["id", "changeset"]).select("caller", "id").distinct()
    rows = latest.join(versions, "id")
    free = rows.join(historic, "caller", "left_semi")
    bound = rows.join(historic, "caller", "left_anti").join(readable, ["caller", "id", "changeset"], "left_semi")
    return free.unionByName(bound).select("caller", "id", "changeset").distinct()
