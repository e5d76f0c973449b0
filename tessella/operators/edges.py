"""Edges between documents: references, inverse relations, embedding; what changes between versions; counts from edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessella.operators.claims import CLAIM, FLOOR, claim_signature, make_id, shuffled, spread_join, with_paths
from tessella.operators.hierarchy import expand_refs


def reference_edges(claims: DataFrame, ancestors: DataFrame, level: str, source: bool = True) -> DataFrame:
    """(target, level, claim, source, is_source): one row for each target, claim and referring document, at any depth."""
    rows = expand_refs(claims, ancestors)
    return rows.select(F.col("to").alias("target"), F.lit(level).alias("level"), F.col("claim_id").alias("claim"), F.col("doc_id").alias("source"), F.lit(source).alias("is_source")).dropDuplicates(["target", "level", "claim", "source"])


def inverse_claims(claims: DataFrame, props: DataFrame, fields: DataFrame | None = None, has_class: DataFrame | None = None, ancestors: DataFrame | None = None) -> DataFrame:
    """Claims B -Y-> A for claims A -X-> B: props(prop, inverse) names Y, fields(class, prop, inverse) overrides it for documents
    of a class (has_class(doc_id, class)). With ancestors they land on those of B too."""
    rows = claims.where("type = 'ref' AND depth = 0")
    if ancestors is not None:
        rows = expand_refs(rows, ancestors).drop("direct")
    rows = rows.join(props.withColumnRenamed("inverse", "__p"), "prop", "left")
    if fields is not None:
        rows = rows.join(has_class, "doc_id", "left").join(fields.withColumnRenamed("inverse", "__f"), ["class", "prop"], "left")
    else:
        rows = rows.withColumn("__f", F.lit(None).cast("string"))
    rows = rows.withColumn("__y", F.coalesce("__f", "__p")).where("__y IS NOT NULL")
    made = {c: F.col(c) for c in CLAIM} | {"doc_id": F.col("to"), "claim_id": make_id(F.lit("inverse"), F.col("claim_id"), F.col("to"), F.col("__y")), "prop": F.col("__y"), "to": F.col("doc_id")}
    return rows.select(*[made[c].alias(c) for c in CLAIM]).dropDuplicates(["claim_id"])


def embed_claims(claims: DataFrame, fields: DataFrame, depth: int = 1, floor: float = FLOOR) -> DataFrame:
    """Sub-claims copied under referring claims: for each claim of fields(prop, source_prop[, dest]) the referenced document's claims
    at source_prop, properties joined by dots down to depth levels, all of them at the floor or above, with new ids and, where dest
    is given, as that property. A referenced document that is not there gives none."""
    if "dest" not in fields.columns:
        fields = fields.withColumn("dest", F.lit(None).cast("string"))
    refs = claims.where("type = 'ref' AND depth = 0").join(fields, "prop").select(F.col("doc_id").alias("__doc"), F.col("claim_id").alias("__claim"), F.col("to").alias("doc_id"), F.col("prop").alias("__prop"), F.col("source_prop").alias("path"), "dest")
    found = refs.join(shuffled(with_paths(claims.where(F.col("confidence") >= floor), depth)), ["doc_id", "path"])
    prop = F.coalesce("dest", "prop")
    made = {c: F.col(c) for c in CLAIM} | {"doc_id": F.col("__doc"), "claim_id": make_id(F.lit("embedded"), F.col("__claim"), F.col("claim_id"), prop), "parent_claim_id": F.col("__claim"), "parent_prop": F.col("__prop"), "depth": F.lit(1), "prop": prop}
    return found.select(*[made[c].alias(c) for c in CLAIM])


def embedding_edges(claims: DataFrame, fields: DataFrame) -> DataFrame:
    """(target, embedder, paths): which documents embed which, and from where."""
    refs = spread_join(claims.where("type = 'ref' AND depth = 0").select("doc_id", "prop", "to"), fields, ["prop"])
    return refs.groupBy(F.col("to").alias("target"), F.col("doc_id").alias("embedder")).agg(F.sort_array(F.collect_set("source_prop")).alias("paths"))


def referrers(edges: DataFrame, ids: list[str], levels: list[str]) -> DataFrame:
    return edges.where(F.col("target").isin(ids) & F.col("level").isin(levels)).select("source").distinct()


def reference_counts(edges: DataFrame, level: str, ignored: DataFrame | None = None) -> DataFrame:
    """(target, refs): referring source documents, without those of ignored(doc_id)."""
    rows = edges.where((F.col("level") == level) & F.col("is_source"))
    if ignored is not None:
        rows = rows.join(ignored.select(F.col("doc_id").alias("source")), "source", "left_anti")
    return rows.groupBy("target").agg(F.count_distinct("source").alias("refs"))


def doc_counts(claims: DataFrame, refs: DataFrame) -> DataFrame:
    """(doc_id, n_claims, n_refs, score): claims given (prune them with confident() first) plus references."""
    n = claims.groupBy("doc_id").agg(F.count("*").alias("n_claims"))
    out = n.join(refs.select(F.col("target").alias("doc_id"), F.col("refs").alias("n_refs")), "doc_id", "left").withColumn("n_refs", F.coalesce("n_refs", F.lit(0)))
    return out.withColumn("score", F.col("n_claims") + F.col("n_refs"))


def earliest_time(windows: DataFrame) -> DataFrame:
    """(doc_id, time): the least start of a document's time windows, at any depth."""
    return windows.groupBy("doc_id").agg(F.min(F.least("lo", "hi")).alias("time"))


def diff_rows(current: DataFrame, before: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows added to and removed from before, compared on all columns (nulls are equal)."""
    return current.exceptAll(before), before.exceptAll(current)


def changed_props(current: DataFrame, before: DataFrame) -> DataFrame:
    """(doc_id, prop) whose claims differ between two versions, by signature."""
    a, b = (claim_signature(x).select("doc_id", "prop", "signature") for x in (current, before))
    gone, new = b.exceptAll(a), a.exceptAll(b)
    return gone.unionByName(new).select("doc_id", "prop").distinct()


def embedders_to_refresh(edges: DataFrame, changed: DataFrame, flipped: DataFrame | None = None) -> DataFrame:
    """Embedders of a document whose embedded property changed(doc_id, prop), or whose visibility flipped(doc_id)."""
    leaf = edges.select("target", "embedder", F.explode("paths").alias("path")).withColumn("prop", F.element_at(F.split("path", "[.]"), -1))
    out = leaf.join(changed.withColumnRenamed("doc_id", "target"), ["target", "prop"], "left_semi").select("embedder")
    if flipped is not None:
        out = out.unionByName(edges.join(flipped.withColumnRenamed("doc_id", "target"), "target", "left_semi").select("embedder"))
    return out.distinct()


def merge_paths(a: DataFrame, b: DataFrame) -> DataFrame:
    """(target, embedder, paths, changed): the union of two path sets, and whether it differs from a's."""
    x = a.join(b.withColumnRenamed("paths", "__b"), ["target", "embedder"], "full")
    empty = F.expr("CAST(array() AS array<string>)")
    both = F.sort_array(F.array_union(F.coalesce("paths", empty), F.coalesce("__b", empty)))
    return x.select("target", "embedder", both.alias("merged"), F.sort_array(F.coalesce("paths", empty)).alias("old")).select("target", "embedder", F.col("merged").alias("paths"), (F.col("merged") != F.col("old")).alias("changed"))


def merge_docs(a: DataFrame, *others: DataFrame) -> DataFrame:
    """The claims of all frames; a claim id that occurs twice is an error."""
    out = a
    for x in others:
        out = out.unionByName(x)
    twice = out.groupBy("claim_id").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"claim {twice[0].claim_id} occurs more than once")
    return out


def claims_equivalent(a: DataFrame, b: DataFrame, levels: int | None = None) -> DataFrame:
    """(doc_id, equivalent): whether both frames hold equal claims for a document, whatever their order and ids. Both are signed in one
    walk, so each claim is shuffled once. levels are as in claim_signature()."""
    both = a.withColumn("__side", F.lit("x")).unionByName(b.withColumn("__side", F.lit("y")))
    top = claim_signature(both, levels=levels, by=["__side"], top=True)
    side = lambda n: F.sort_array(F.collect_list(F.when(F.col("__side") == n, F.col("signature"))))
    return top.groupBy("doc_id").agg(side("x").alias("x"), side("y").alias("y")).select("doc_id", (F.col("x") == F.col("y")).alias("equivalent"))


def duplicate_claims(claims: DataFrame, with_sub: bool = True, levels: int | None = None) -> DataFrame:
    """(doc_id, prop, n): claims of a field with equal signatures. levels are as in claim_signature()."""
    rows = claim_signature(claims, with_sub=with_sub, levels=levels, top=True)
    return rows.groupBy("doc_id", "prop", "signature").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "prop", "n")
