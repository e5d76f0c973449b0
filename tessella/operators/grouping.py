"""Order, pages and groups of results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessella.operators.claims import shuffled
from tessella.sources.settle import settle

CAP = 1000


def default_order() -> list[Column]:
    """Score, then time, then label, then id; what is missing comes last."""
    return [F.desc_nulls_last("score"), F.desc_nulls_last("time"), F.asc_nulls_last("label"), F.asc("doc_id")]


def sort_keys(docs: DataFrame, records: DataFrame, keys: list[tuple[str, bool]], unit: str | None = None) -> tuple[DataFrame, list[Column]]:
    """docs with a column for each (property, ascending) and the order by them: the least value of a document ascending, the
    largest descending, missing ones last, then id. One pass over the records."""
    props = [p for p, _ in keys]
    rows = records.where(F.col("prop").isin(props) & (F.col("depth") == 0) & (F.col("collection").isin("time") | ((F.col("collection") == "amount") & F.col("unit").eqNullSafe(F.lit(unit)))))
    found = rows.groupBy("doc_id").agg(*[(F.min if up else F.max)(F.when(F.col("prop") == p, F.col("lo"))).alias(f"key_{p}") for p, up in keys])
    order = [(F.asc_nulls_last if up else F.desc_nulls_last)(f"key_{p}") for p, up in keys]
    return docs.join(shuffled(found), "doc_id", "left"), [*order, F.asc("doc_id")]


@dataclass(frozen=True)
class Key:
    """One key of an order. kind: score, time or label of the document itself, or ref, amount or time of a property (prop)."""

    kind: str
    prop: str = ""
    descending: bool = False
    unit: str | None = None


def sort_results(docs: DataFrame, records: DataFrame, keys: list[Key], lang: str, labels: DataFrame) -> tuple[DataFrame, list[Column]]:
    """docs(doc_id, score, time) with a column for each key, and the order by them: missing values last in either direction, then id.

    A document's label is labels(id, lang, label) of itself in the language, folded. Of a property the document's least value counts
    ascending and its largest descending: of references the folded label of the target (its id where it has none), with the id to
    part equal labels; of amounts in the key's unit and of times their start. One pass over the records and one over the labels.
    """
    named = labels.where(F.col("lang") == lang).groupBy("id").agg(F.min(F.lower("label")).alias("__label"))
    out = docs
    if any(k.kind == "label" for k in keys):
        out = out.join(named.select(F.col("id").alias("doc_id"), F.col("__label").alias("__own")), "doc_id", "left")
    of_props = [(i, k) for i, k in enumerate(keys) if k.prop]
    if of_props:
        rows = records.where(F.col("prop").isin([k.prop for _, k in of_props]) & (F.col("depth") == 0)).join(named.select(F.col("id").alias("to"), "__label"), "to", "left")
        made = []
        for i, k in of_props:
            here = F.col("prop") == k.prop
            if k.kind == "ref":
                value = F.when(here & (F.col("claim_type") == "ref") & F.col("is_leaf"), F.struct(F.coalesce("__label", F.lower("to")).alias("l"), F.col("to").alias("id")))
            else:
                here = here & (F.col("collection") == k.kind)
                value = F.when(here & F.col("unit").eqNullSafe(F.lit(k.unit)) if k.kind == "amount" else here, F.col("lo"))
            made.append((F.max if k.descending else F.min)(value).alias(f"key_{i}"))
        out = out.join(shuffled(rows.groupBy("doc_id").agg(*made)), "doc_id", "left")
    own = {"score": "score", "time": "time", "label": "__own"}
    out = out.withColumns({f"key_{i}": F.col(own[k.kind]) for i, k in enumerate(keys) if not k.prop}).drop("__own")
    return out, [*[(F.desc_nulls_last if k.descending else F.asc_nulls_last)(f"key_{i}") for i, k in enumerate(keys)], F.asc("doc_id")]


def results(docs: DataFrame, order: list[Column], cap: int = CAP) -> tuple[DataFrame, int]:
    """The first cap rows with their position, and how many there are in all. Only cap rows of each task move."""
    top = docs.orderBy(*order).limit(cap)
    return top.withColumn("position", F.row_number().over(Window.orderBy(*order))), docs.count()


def page_after(rows: DataFrame, keys: list[str], after: tuple | None, size: int) -> DataFrame:
    """The page of rows behind the key tuple after; an after that rows don't have is an error."""
    if after is not None:
        here = F.lit(True)
        for k, v in zip(keys, after):
            here &= F.col(k) == F.lit(v)
        if rows.where(here).isEmpty():
            raise ValueError(f"no row has the key {after}")
        later = F.lit(False)
        for i in range(len(keys)):
            step = F.col(keys[i]) > F.lit(after[i])
            for k, v in zip(keys[:i], after[:i]):
                step &= F.col(k) == F.lit(v)
            later |= step
        rows = rows.where(later)
    return rows.orderBy(*keys).limit(size)


def _grouped(docs: DataFrame, records: DataFrame, props: list[str]) -> tuple[DataFrame, list[str]]:
    out = docs
    for p in props:
        leaves = records.where((F.col("prop") == p) & (F.col("claim_type") == "ref") & (F.col("depth") == 0) & F.col("is_leaf")).select("doc_id", F.col("to").alias(f"g_{p}")).distinct()
        out = out.join(leaves, "doc_id", "left")
    return out, [f"g_{p}" for p in props]


def group_headings(docs: DataFrame, records: DataFrame, props: list[str], labels: DataFrame) -> DataFrame:
    """(level, g_<prop>..., label, docs): a heading for each group of group_results() at each level, with the label of its innermost
    value (null for the missing group) and all its documents, also those over the cap. Inner values are null at outer levels."""
    rows, keys = _grouped(docs.select("doc_id").distinct(), records, props)
    inner = rows.groupBy(*keys, "doc_id").agg(F.lit(1).alias("one")).drop("one")
    out = None
    for n in range(1, len(keys) + 1):
        each = inner if n == len(keys) else inner.select(*keys[:n], "doc_id").distinct()
        level = each.groupBy(*keys[:n]).agg(F.count("*").alias("docs")).withColumns({k: F.lit(None).cast("string") for k in keys[n:]})
        level = level.withColumns({"level": F.lit(n), "__id": F.col(keys[n - 1])})
        out = level if out is None else out.unionByName(level)
    return out.join(labels.select(F.col("id").alias("__id"), "label"), "__id", "left").select("level", *keys, "label", "docs")


def group_results(docs: DataFrame, records: DataFrame, props: list[str], order: list[Column], cap: int = CAP) -> DataFrame:
    """(g_<prop>..., doc_id, position, group_docs): each document under its most specific values of the properties, null for a
    missing one; positions by order within the innermost group, at most cap; group_docs counts the outermost group's documents."""
    out, keys = _grouped(docs, records, props)
    heads = out.groupBy(keys[0]).agg(F.count_distinct("doc_id").alias("group_docs")).withColumnRenamed(keys[0], "__g")
    placed = out.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("position") <= cap)
    return placed.join(heads, placed[keys[0]].eqNullSafe(heads["__g"])).select(*keys, "doc_id", "position", "group_docs")


def limit_groups(rows: DataFrame, labels: DataFrame | None, keys: list[str], n: int, unique: bool = False, ascending: bool = True) -> DataFrame:
    """The first n rows of group_results() in traversal order (groups by label, lower-cased, the missing group last; then position);
    with unique the rows of the first n different documents. Only n rows of each task move for a plain cap."""
    order, at = [], rows
    for k in keys:
        if labels is not None:
            at = at.join(labels.select(F.col("id").alias(k), F.lower("label").alias(f"l_{k}")), k, "left")
        else:
            at = at.withColumn(f"l_{k}", F.lower(k))
        order += [(F.asc_nulls_last if ascending else F.desc_nulls_last)(f"l_{k}"), F.asc_nulls_last(k)]
    order += [F.asc("position"), F.asc("doc_id")]
    drop = [f"l_{k}" for k in keys]
    if not unique:
        return at.orderBy(*order).limit(n).drop(*drop)
    # a document's first place decides; the first n documents are taken by their first places
    first = at.groupBy("doc_id").agg(F.min(F.struct(*[F.struct(F.col(f"l_{k}").isNull().alias("m"), F.col(f"l_{k}"), F.col(k)) if ascending else F.struct(F.col(f"l_{k}").isNull().alias("m"), F.col(k)) for k in keys], F.col("position"))).alias("__first"))
    return at.join(first.orderBy("__first", "doc_id").limit(n).select("doc_id"), "doc_id", "left_semi").drop(*drop)


def _headings(i: int) -> Column:
    """The chain of the i-th property's value; only the value itself counts its documents."""
    last = F.size(f"c_{i}") - 1
    return F.transform(f"c_{i}", lambda x, at: F.struct(F.lit(i).alias("col"), x.id.alias("id"), x.label.alias("label"), F.when(at == last, F.col(f"n_{i + 1}")).alias("docs")))


def group_tree(docs: DataFrame, records: DataFrame, props: list[str], order: list[Column], labels: DataFrame, paths: DataFrame | None = None, cap: int = CAP, descending: list[bool] | None = None) -> DataFrame:
    """(position, headings, doc_id, more): grouped results in the order in which they are shown, at most cap; headings is the chain
    of groups that a result stands in, outermost first: (col, id, label, docs, first).

    A document stands under its most specific values of each property, once for each, and under the missing group (id null), always
    the last one, where it has none. With paths(id, id_path) a value's headings are its ancestors from the root down; of these only
    the value itself has docs, the true number of its group's documents, those over the cap included. Groups are ordered by folded
    label, then id, along the path, or the other way where descending says so for the property; documents of a value itself come
    after the groups below it, in the given order. first marks where a heading starts; a group without a result among the first cap
    has no heading. more tells whether results were cut.

    Each task keeps its first cap rows, so no group is brought together; counts are made for the groups that are shown. The grouped
    documents and the first rows are written once, and all that follows reads them.
    """
    rows, keys = _grouped(docs, records, props)
    rows = plain = settle(rows, "grouped")
    named = labels.groupBy(F.col("id").alias("__id")).agg(F.min("label").alias("__label"))
    by: list[Column] = []
    for i, k in enumerate(keys):
        down = bool(descending and descending[i])
        values = rows.select(F.col(k).alias("id")).where("id IS NOT NULL").distinct()
        chains = values.select("id", F.array("id").alias("id_path")) if paths is None else values.join(paths, "id", "left").select("id", F.coalesce("id_path", F.array("id")).alias("id_path"))
        steps = chains.select("id", "id_path", F.posexplode("id_path").alias("at", "__id")).join(named, "__id", "left")
        node = F.struct("at", F.lit(int(down)).alias("below"), F.lower(F.coalesce("__label", "__id")).alias("folded"), F.col("__id").alias("id"), F.coalesce("__label", "__id").alias("label"))
        chains = steps.groupBy("id", "id_path").agg(F.sort_array(F.collect_list(node)).alias("c"))
        # a value's own documents end its chain: behind the groups below it, in either direction
        end = F.struct(F.lit(1 - int(down)).alias("below"), F.lit(None).cast("string").alias("folded"), F.lit(None).cast("string").alias("id"))
        place = F.concat(F.transform("c", lambda x: F.struct(x.below.alias("below"), x.folded.alias("folded"), x.id.alias("id"))), F.array(end))
        chains = chains.select(F.col("id").alias(f"v_{i}"), F.transform("c", lambda x: F.struct(x.id.alias("id"), x.label.alias("label"))).alias(f"c_{i}"), place.alias(f"o_{i}"))
        rows = rows.join(chains, F.col(k) == F.col(f"v_{i}"), "left").drop(f"v_{i}")
        by += [F.col(k).isNull().asc(), (F.desc if down else F.asc)(f"o_{i}")]
    first = settle(rows.orderBy(*by, *order).limit(cap + 1).withColumn("position", F.row_number().over(Window.orderBy(*by, *order))), "first")
    cut = first.select(F.count("*") > cap).scalar()
    shown = first.where(F.col("position") <= cap)
    for n in range(1, len(keys) + 1):
        groups = shown.select(*[F.col(k).alias(f"w_{j}") for j, k in enumerate(keys[:n])]).distinct()
        same = F.lit(True)
        for j, k in enumerate(keys[:n]):
            same = same & F.col(k).eqNullSafe(F.col(f"w_{j}"))
        counts = plain.select(*keys[:n], "doc_id").join(groups, same).groupBy(*[f"w_{j}" for j in range(n)]).agg(F.count_distinct("doc_id").alias(f"n_{n}"))
        shown = shown.join(counts, same, "left").drop(*[f"w_{j}" for j in range(n)])
    kind = "array<struct<col: int, id: string, label: string, docs: bigint>>"
    chain = []
    for i, k in enumerate(keys):
        made = _headings(i)
        none = F.array(F.struct(F.lit(i).alias("col"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("label"), F.col(f"n_{i + 1}").alias("docs")))
        chain.append(F.when(F.col(k).isNull(), none.cast(kind)).otherwise(made.cast(kind)))
    shown = shown.withColumn("h", F.concat(*chain)).withColumn("before", F.lag("h").over(Window.orderBy("position")))
    step = lambda x, at: F.struct(x["col"].alias("col"), x.id.alias("id"), x.label.alias("label"), x.docs.alias("docs"), (~F.slice("h", 1, at + 1).eqNullSafe(F.slice("before", 1, at + 1))).alias("first"))
    return shown.select("position", F.transform("h", step).alias("headings"), "doc_id", cut.alias("more"))
