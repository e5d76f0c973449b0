"""Facets: which properties a result set offers, their values with counts, identity counts, histograms.

All counts are of documents. Where several distinct counts are asked for, rows are first brought to one for each document and key
with flags, so that one aggregation does and no row is multiplied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessella.functions.values import step_down
from tessella.operators.claims import shuffled
from tessella.sources.settle import settle

CAP, BINS = 1000, 100
#: The order in which a facet offers entries that are no values.
SPECIALS = ["has", "unknown", "none", "missing"]


def _by_doc(records: DataFrame, *keys: str, **marks: Column) -> DataFrame:
    return records.groupBy("doc_id", *keys).agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in marks.items()])


def discover_rel(records: DataFrame) -> DataFrame:
    """(prop, docs, valued, none, unknown, has, valueless, has_hierarchy) over top-level references and statements; valueless counts
    documents with any of none, unknown and has."""
    t = F.col("claim_type")
    rows = _by_doc(records.where("depth = 0 AND collection = 'rel'"), "prop", ref=t == "ref", none=t == "none", unknown=t == "unknown", has=t == "has", valueless=t.isin("none", "unknown", "has"), up=~F.coalesce(F.col("direct"), F.lit(True)))
    return rows.groupBy("prop").agg(F.count("*").alias("docs"), *[F.count_if(F.col(c)).alias(n) for c, n in (("ref", "valued"), ("none", "none"), ("unknown", "unknown"), ("has", "has"), ("valueless", "valueless"))], F.bool_or("up").alias("has_hierarchy"))


def discover_amount(records: DataFrame) -> DataFrame:
    """(prop, unit, docs); a missing unit is the unit ''."""
    return records.where("depth = 0 AND collection = 'amount'").groupBy("prop", F.coalesce("unit", F.lit("")).alias("unit")).agg(F.count_distinct("doc_id").alias("docs"))


def discover_time(records: DataFrame) -> DataFrame:
    return records.where("depth = 0 AND collection = 'time'").groupBy("prop").agg(F.count_distinct("doc_id").alias("docs"))


def discover_sub(records: DataFrame) -> DataFrame:
    """(parent_prop, prop, collection, unit, docs) of sub-claims."""
    rows = records.where("depth = 1 AND collection IN ('rel', 'amount', 'time')")
    return rows.groupBy("parent_prop", "prop", "collection", F.coalesce("unit", F.lit("")).alias("unit")).agg(F.count_distinct("doc_id").alias("docs"))


def discover(records: DataFrame) -> DataFrame:
    """(kind, prop, unit, docs): how many documents say something of a property, in top-level references and statements (rel), amounts by
    unit, and times: facet_facts() counted. Ancestors of a reference are of the same document and property, so records of references
    that are not expanded give the same."""
    return facet_facts(records).groupBy("kind", "prop", "unit").agg(F.count("*").alias("docs"))


def pooled_has(records: DataFrame, parent: str | None = None) -> DataFrame:
    """(prop, docs): properties that are only ever stated by has, and the documents with each; '' stands for any of them."""
    rows = records.where("depth = 0" if parent is None else F.col("parent_prop") == parent)
    other = rows.where("collection IN ('amount', 'time') OR claim_type IN ('ref', 'none', 'unknown')").select("prop").distinct()
    has = rows.where("claim_type = 'has'").join(other, "prop", "left_anti").select("doc_id", "prop").distinct()
    every = has.select("doc_id").distinct().agg(F.count("*").alias("docs")).select(F.lit("").alias("prop"), "docs")
    return has.groupBy("prop").agg(F.count("*").alias("docs")).unionByName(every)


def facet_facts(records: DataFrame, parents: bool = False) -> DataFrame:
    """(doc_id, parent, prop, kind, unit, ref, none, unknown, has): what each document says of a property, one row for each document,
    property and kind (rel, amount by unit, time); with parents also of the properties of sub-claims. All counts of facets follow
    from these rows, so records are read and shuffled once."""
    t = F.col("claim_type")
    rows = records.where(F.col("collection").isin("rel", "amount", "time") & (F.col("depth") <= (1 if parents else 0)))
    keys = [F.when(F.col("depth") == 1, F.coalesce("parent_prop", F.lit(""))).otherwise("").alias("parent"), "prop", F.col("collection").alias("kind"), F.when(F.col("collection") == "amount", F.coalesce("unit", F.lit(""))).otherwise("").alias("unit")]
    return rows.groupBy("doc_id", *keys).agg(*[F.coalesce(F.bool_or(t == c), F.lit(False)).alias(c) for c in ("ref", "none", "unknown", "has")])


def facets(records: DataFrame, active: list[str] = (), cap: int = CAP, docs: DataFrame | None = None, parents: bool = False, mark: bool = False) -> DataFrame:
    """(kind, prop, unit, docs, active, position): ref, amount, time, specials-only and pooled has facets, active ones first,
    then by count; at most cap. docs is what a facet reaches: amount and time facets add the documents with a statement without a
    value of their property, so that a document with both counts twice there.

    With docs(doc_id), the result of the filters, only these documents count. With parents the properties of sub-claims are facets
    too, under their parent's property (column parent, '' for those of documents). With mark, saturated tells in each row whether
    more than cap facets were found, and total how many.

    facet_facts() is written once; one aggregation of it by property and kind gives all counts, one by property says which are only
    ever stated by has, and the documents of these are counted once for the pool.
    """
    rows = records if docs is None else records.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    facts = settle(facet_facts(rows, parents), "facts")
    valueless = F.col("none") | F.col("unknown") | F.col("has")
    counts = facts.groupBy("parent", "prop", "kind", "unit").agg(F.count("*").alias("docs"), F.count_if("ref").alias("valued"), F.count_if(valueless).alias("valueless"), F.count_if(F.col("none") | F.col("unknown")).alias("special"))
    rel, by = F.col("kind") == "rel", Window.partitionBy("parent", "prop")
    known = settle(counts.withColumns({"ranged": F.coalesce(F.bool_or(~rel).over(by), F.lit(False)), "stated": F.coalesce(F.max(F.when(rel, F.col("valueless"))).over(by), F.lit(0)), "only_has": ~F.coalesce(F.bool_or(~rel | (F.col("valued") + F.col("special") > 0)).over(by), F.lit(False))}), "counts")
    kind = F.when(~rel, F.col("kind")).when(F.col("valued") > 0, "ref").when((F.col("special") > 0) & ~F.col("ranged"), "special")
    each = known.select(kind.alias("kind"), "parent", "prop", "unit", (F.col("docs") + F.when(rel, 0).otherwise(F.col("stated"))).alias("docs")).where("kind IS NOT NULL")
    pool = facts.where("has").join(known.where("only_has").select("parent", "prop"), ["parent", "prop"], "left_semi").groupBy("parent").agg(F.count_distinct("doc_id").alias("docs"))
    each = each.unionByName(pool.select(F.lit("has").alias("kind"), "parent", F.lit("").alias("prop"), F.lit("").alias("unit"), "docs"))
    each = each.withColumn("active", F.col("prop").isin(list(active))) if parents else each.drop("parent").withColumn("active", F.col("prop").isin(list(active)))
    order = [F.desc("active"), F.desc("docs"), F.asc("kind"), *([F.asc("parent")] if parents else []), F.asc("prop"), F.asc("unit")]
    if not mark:
        return rank(each, order, cap)
    total = each.select(F.count("*")).scalar()
    return rank(each.withColumn("total", total), order, cap).withColumn("saturated", F.col("total") > cap)


def rank(rows: DataFrame, order: list[Column], cap: int, by: list[str] | None = None, name: str = "position") -> DataFrame:
    """The first cap rows in order (of each group of by), with their position. Without by the top rows are taken first, in each task."""
    if not by:
        rows = rows.orderBy(*order).limit(cap)
    w = Window.partitionBy(*(by or [])).orderBy(*order)
    out = rows.withColumn(name, F.row_number().over(w))
    return out.where(F.col(name) <= cap) if by else out


def rank_facets(rows: DataFrame, by: list[str], cap: int = CAP) -> DataFrame:
    return rank(rows, [F.desc("docs"), F.asc("prop")], cap, by)


def ref_values(records: DataFrame, prop: str, parent: str | None = None) -> DataFrame:
    """(to, docs, direct_docs): values of a reference property with the documents at or below each, and those with it as most specific."""
    where = (F.col("prop") == prop) & (F.col("claim_type") == "ref") & (F.col("depth") == 0 if parent is None else F.col("parent_prop") == parent)
    rows = _by_doc(records.where(where), "to", leaf=F.col("is_leaf"))
    return rows.groupBy("to").agg(F.count("*").alias("docs"), F.count_if("leaf").alias("direct_docs"))


def direct_entries(values: DataFrame, ancestors: DataFrame) -> DataFrame:
    """(to, docs): values with narrower values among the facet's own, for their direct documents."""
    inner = values.select(F.col("to").alias("id")).join(ancestors, "id").select(F.col("ancestor").alias("to")).distinct()
    return values.join(inner, "to", "left_semi").where("direct_docs > 0").select("to", F.col("direct_docs").alias("docs"))


def child_counts(values: DataFrame, edges: DataFrame) -> DataFrame:
    """(to, children): how many of the facet's values lie directly below each value."""
    below = values.select(F.col("to").alias("id")).join(edges, "id").groupBy(F.col("parent").alias("to")).agg(F.count_distinct("id").alias("children"))
    return values.select("to").join(below, "to", "left").select("to", F.coalesce("children", F.lit(0)).alias("children"))


def value_paths(values: DataFrame, paths: DataFrame) -> DataFrame:
    """values with paths: all of id_paths() of each value, in order; empty for a value outside all hierarchies."""
    found = paths.groupBy(F.col("id").alias("to")).agg(F.sort_array(F.collect_set("id_path")).alias("paths"))
    return values.join(found, "to", "left").withColumn("paths", F.coalesce("paths", F.expr("CAST(array() AS array<array<string>>)")))


def special_entries(counts: DataFrame) -> DataFrame:
    """(to, docs): the entries HAS, UNKNOWN, NONE and MISSING of a facet, from its identity_counts(), where there are any documents."""
    found = counts.select(F.explode(F.array(*[F.struct(F.lit(n.upper()).alias("to"), F.col(n).alias("docs")) for n in SPECIALS])).alias("e"))
    return found.select("e.to", "e.docs").where("docs > 0")


def order_values(values: DataFrame, paths: DataFrame, cap: int = CAP, specials: DataFrame | None = None) -> DataFrame:
    """values in display order: count, then depth (of the longest path), then special_entries() in their order, then id."""
    depth = paths.groupBy(F.col("id").alias("to")).agg(F.max(F.size("id_path")).alias("depth"))
    rows = values.join(depth, "to", "left").withColumn("depth", F.coalesce("depth", F.lit(1)))
    if specials is None:
        return rank(rows, [F.desc("docs"), F.asc("depth"), F.asc("to")], cap)
    place = F.array_position(F.array(*[F.lit(n.upper()) for n in SPECIALS]), F.col("to"))
    rows = rows.withColumn("__special", F.lit(0).cast("long")).unionByName(specials.withColumns({"depth": F.lit(1), "__special": place}), allowMissingColumns=True)
    return rank(rows, [F.desc("docs"), F.asc("depth"), F.asc("__special"), F.asc("to")], cap).drop("__special")


def identity_counts(docs: DataFrame, records: DataFrame, prop: str, kind: str = "rel") -> DataFrame:
    """One row: documents with the property in this kind (exists), as has, unknown, none, in other kinds, missing, and all."""
    rows = records.where((F.col("prop") == prop) & (F.col("depth") == 0) & F.col("collection").isin("rel", "amount", "time"))
    t, valued = F.col("claim_type"), F.col("claim_type").isin("has", "none", "unknown")
    marks = _by_doc(rows, exists=(F.col("collection") == kind) & ~valued, has=t == "has", unknown=t == "unknown", none=t == "none", other=(F.col("collection") != kind) & ~valued)
    joined = docs.select("doc_id").distinct().join(marks, "doc_id", "left")
    return joined.agg(*[F.count_if(F.coalesce(F.col(c), F.lit(False))).alias(c) for c in ("exists", "has", "unknown", "none", "other")], F.count_if(F.col("exists").isNull()).alias("missing"), F.count("*").alias("universe"))


def distinct_total(rows: DataFrame, column: str, cap: int = CAP) -> DataFrame:
    """(total, estimate, saturated): the exact number of different values, a sketch's estimate of it, and whether it passes the cap."""
    return rows.agg(F.count_distinct(column).alias("total"), F.hll_sketch_estimate(F.hll_sketch_agg(column)).alias("estimate")).withColumn("saturated", F.col("total") > cap)


def distinct_estimate(rows: DataFrame, column: str, cap: int = CAP, log2k: int = 15) -> DataFrame:
    """(total, saturated): the exact number of different values up to the cap; above it the estimate of a mergeable sketch of 2**log2k
    registers, whose relative standard error is 0.83 / 2**(log2k / 2): 0.5 % at 15. State is bounded: the sketch, and at most
    cap + 1 values a task that are then brought together. Nulls don't count; no rows give 0."""
    few = rows.select(column).where(F.col(column).isNotNull()).distinct().limit(cap + 1)
    n, estimate = few.select(F.count("*")).scalar(), rows.select(F.hll_sketch_estimate(F.hll_sketch_agg(column, log2k))).scalar()
    one = rows.sparkSession.range(1).select(n.alias("n"), estimate.alias("estimate"))
    return one.select(F.when(F.col("n") > cap, F.greatest("n", "estimate")).otherwise(F.col("n")).alias("total"), (F.col("n") > cap).alias("saturated"))


def _windows(records: DataFrame, prop: str, kind: str, unit: str | None, parent: str | None) -> DataFrame:
    where = (F.col("prop") == prop) & (F.col("collection") == kind) & (F.col("depth") == 0 if parent is None else F.col("parent_prop") == parent)
    if kind == "amount":
        where &= F.col("unit").eqNullSafe(F.lit(unit))
    return records.where(where)


def value_bounds(records: DataFrame, prop: str, kind: str = "amount", unit: str | None = None, parent: str | None = None, limit: float = 1e308) -> DataFrame:
    """One row: least, most (ends at infinity left out), docs, open_start, open_end, start_is_end (the least value is the exclusive
    or inclusive end of some window)."""
    rows = _windows(records, prop, kind, unit, parent)
    lo, hi = F.when(F.abs("lo") < limit, F.col("lo")), F.when(F.abs("hi") < limit, F.col("hi"))
    return rows.agg(F.least(F.min(lo), F.min(hi)).alias("least"), F.greatest(F.max(lo), F.max(hi)).alias("most"), F.count_distinct("doc_id").alias("docs"), F.coalesce(F.bool_or(F.col("lo") <= -limit), F.lit(False)).alias("open_start"), F.coalesce(F.bool_or(F.col("hi") >= limit), F.lit(False)).alias("open_end"), F.coalesce(F.min(hi) <= F.min(lo), F.lit(False)).alias("start_is_end"))


def histogram(records: DataFrame, prop: str, kind: str = "amount", unit: str | None = None, gte: float | None = None, lte: float | None = None, parent: str | None = None, bins: int = BINS) -> DataFrame:
    """(bin, lo, docs): documents by bins of equal width over the values, a document in each bin that a window of it meets.

    A selection [gte, lte] is widened by a tenth of its width and clamped to the values; gte = lte is one bin. Where the least
    value is itself an end, the start is stepped down. The bounds are one row, read by the driver; bins are whole numbers.
    """
    b = value_bounds(records, prop, kind, unit, parent).withColumn("down", step_down(F.col("least"), F.col("most") - F.col("least"))).first()
    rows = _windows(records, prop, kind, unit, parent)
    schema = "bin int, lo double, docs long"
    if b.least is None:
        return records.sparkSession.createDataFrame([], schema)
    low, high = (b.down if b.start_is_end else b.least), b.most
    if gte is not None or lte is not None:
        a, z = (low if gte is None else gte), (high if lte is None else lte)
        if a < z:
            a, z = a - (z - a) * 0.1, z + (z - a) * 0.1
        low, high = max(low, a), min(high, z)
    n = bins if low < high else 1
    width = (high - low) / n if n > 1 else 1.0
    at = lambda c: F.least(F.greatest(F.floor((c - F.lit(low)) / F.lit(width)), F.lit(0)), F.lit(n - 1)).cast("int")
    meets = rows.where((F.col("lo") <= high) & ((F.col("hi") > low) | (F.col("hi_incl") & (F.col("hi") == low))))
    # the end is exclusive: a window that ends on a bin's edge doesn't reach the next bin
    last = at(F.col("hi")) - F.when((F.floor((F.col("hi") - F.lit(low)) / F.lit(width)) == (F.col("hi") - F.lit(low)) / F.lit(width)) & ~F.col("hi_incl") & (at(F.col("hi")) > at(F.col("lo"))) & (F.col("hi") < F.lit(low + width * n)), 1).otherwise(0)
    found = meets.select("doc_id", F.explode(F.sequence(at(F.col("lo")), F.greatest(at(F.col("lo")), last))).alias("bin")).groupBy("bin").agg(F.count_distinct("doc_id").alias("docs"))
    every = records.sparkSession.range(n).select(F.col("id").cast("int").alias("bin"), (F.lit(low) + F.col("id") * F.lit(width)).alias("lo"))
    return every.join(found, "bin", "left").select("bin", "lo", F.coalesce("docs", F.lit(0)).alias("docs"))


def narrow_facets(rows: DataFrame, labels: DataFrame, text: str, key: str = "to", ancestors: DataFrame | None = None) -> DataFrame:
    """rows whose value's label contains the text (in any case), with their ancestors among rows; counts stay as they are."""
    match = labels.where(F.lower("label").contains(text.lower())).select(F.col("id").alias(key)).distinct()
    keep = match
    if ancestors is not None:
        keep = match.unionByName(match.withColumnRenamed(key, "id").join(shuffled(ancestors), "id").select(F.col("ancestor").alias(key))).distinct()
    return rows.join(shuffled(keep), key, "left_semi")


def merge_selected(values: DataFrame, selected: DataFrame, ancestors: DataFrame) -> DataFrame:
    """(to, docs): values with the selected ids and their ancestors, at count 0 where the facet lacks them."""
    want = selected.select("to").unionByName(selected.select(F.col("to").alias("id")).join(ancestors, "id").select(F.col("ancestor").alias("to"))).distinct()
    return values.select("to", "docs").join(want, "to", "full").select("to", F.coalesce("docs", F.lit(0)).alias("docs"))


def class_counts(records: DataFrame, prop: str = "INSTANCE_OF") -> DataFrame:
    """(to, docs) of classes, sub-classes included as records are expanded."""
    return ref_values(records, prop).select("to", "docs")


def class_options(classes: DataFrame, ancestors: DataFrame, counts: DataFrame, limit: str | None = None) -> DataFrame:
    """(id, creatable, docs): classes(id, creatable) that are creatable or above one that is, within the subtree of limit, by use."""
    able = classes.where("creatable").select("id")
    keep = able.unionByName(able.join(ancestors, "id").select(F.col("ancestor").alias("id"))).distinct()
    rows = classes.join(keep, "id", "left_semi")
    if limit is not None:
        below = ancestors.where(F.col("ancestor") == limit).select("id")
        rows = rows.join(below, "id", "left_semi").unionByName(rows.where(F.col("id") == limit))
    return rows.join(counts.withColumnRenamed("to", "id"), "id", "left").select("id", "creatable", F.coalesce("docs", F.lit(0)).alias("docs")).orderBy(F.desc("docs"), "id")


def value_tree(values: DataFrame, ancestors: DataFrame) -> DataFrame:
    """(id, under): each value below the nearest of its ancestors that is itself placed, once for each at the same distance."""
    placed = values.select("id")
    up = placed.join(ancestors, "id").join(placed.withColumnRenamed("id", "ancestor"), "ancestor", "left_semi")
    w = Window.partitionBy("id").orderBy("min_depth")
    near = up.withColumn("r", F.rank().over(w)).where("r = 1").select("id", F.col("ancestor").alias("under"))
    return placed.join(near, "id", "left")


def score_factor(docs: DataFrame, score: str = "score", accuracy: int | None = None) -> DataFrame:
    """(factor): (2**10 - 2) / p99 of the scores, 0 where p99 is under 1. Exact without accuracy, which counts the different scores;
    with it from a mergeable quantile sketch of that accuracy (rank error 1 / accuracy), whose state doesn't grow with the scores."""
    p = F.percentile(score, F.lit(0.99)) if accuracy is None else F.percentile_approx(score, 0.99, accuracy)
    return docs.agg(F.coalesce(F.when(p >= 1, 1022.0 / p), F.lit(0.0)).alias("factor"))
