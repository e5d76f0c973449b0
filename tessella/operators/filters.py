"""Filters over records, all evaluated in one aggregation: a flag for each path and document.

Selections on one path (property, and parent property) are alternatives; paths must all hold. Paths below one parent property
form a group: they must hold on the same parent claim, which a selection on the parent property itself narrows further.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F

FACETABLE = ("rel", "amount", "time")


@dataclass(frozen=True)
class Filter:
    """A selection. kind: to, among, direct, amount, time, exists, has, special, missing."""

    kind: str
    prop: str = ""
    values: tuple = ()
    gte: float | None = None
    lte: float | None = None
    unit: str | None = None
    parent: str | None = None

    @property
    def path(self) -> tuple:
        return (self.parent, "<has>" if self.kind == "has" else self.prop)

    @property
    def mark(self) -> str:
        return f"__in_{id(self.values[0])}"

    def condition(self) -> Column:
        """Whether one record satisfies the selection (of missing: whether it contradicts it)."""
        prop = F.col("prop") == self.prop
        if self.kind == "to":
            return prop & F.col("to").isin(*self.values)
        if self.kind == "among":
            return prop & F.col(self.mark)
        if self.kind == "direct":
            return prop & F.col("to").isin(*self.values) & F.col("is_leaf")
        if self.kind in ("amount", "time"):
            here = prop & (F.col("collection") == self.kind)
            if self.kind == "amount":
                here &= F.col("unit").eqNullSafe(F.lit(self.unit))
            if self.lte is not None:
                here &= F.col("lo") <= self.lte
            if self.gte is not None:
                here &= (F.col("hi") > self.gte) | (F.col("hi_incl") & (F.col("hi") == self.gte))
            return here
        if self.kind == "exists":
            here = prop & (F.col("collection") == (self.values[0] if self.values else "rel"))
            return here & F.col("unit").eqNullSafe(F.lit(self.unit)) if self.values and self.values[0] == "amount" else here
        if self.kind == "has":
            return (F.col("claim_type") == "has") & F.col("prop").isin(*self.values)
        if self.kind == "special":
            return prop & F.col("claim_type").isin(*self.values)
        return prop & F.col("collection").isin(*FACETABLE)


def to(prop, *values, parent=None):
    return Filter("to", prop, values, parent=parent)


def among(prop, ids, parent=None):
    """As to(), for the values of ids(id): a DataFrame of any size, which is joined and not listed."""
    return Filter("among", prop, (ids,), parent=parent)


def direct(prop, *values, parent=None):
    return Filter("direct", prop, values, parent=parent)


def amount(prop, gte=None, lte=None, unit=None, parent=None):
    return Filter("amount", prop, (), gte, lte, unit, parent)


def time(prop, gte=None, lte=None, parent=None):
    return Filter("time", prop, (), gte, lte, None, parent)


def exists(prop, kind="rel", unit=None, parent=None):
    return Filter("exists", prop, (kind,), unit=unit, parent=parent)


def has(*props, parent=None):
    return Filter("has", "", props, parent=parent)


def special(prop, *kinds, parent=None):
    return Filter("special", prop, kinds, parent=parent)


def missing(prop, parent=None):
    return Filter("missing", prop, parent=parent)


def _paths(filters: list[Filter]) -> dict[tuple, list[Filter]]:
    out: dict[tuple, list[Filter]] = {}
    for f in filters:
        out.setdefault(f.path, []).append(f)
    return out


def properties(filters: list[Filter]) -> set[str]:
    """The properties that filters look at, parents included: records of others need not be made."""
    return {p for f in filters for p in (f.prop, f.parent, *(f.values if f.kind == "has" else ())) if p}


def flag_name(path: tuple) -> str:
    return "f_" + "_".join(str(x).strip("<>") for x in path if x)


def _any(filters: list[Filter], missing: bool) -> Column:
    found = [f.condition() for f in filters if (f.kind == "missing") == missing]
    return reduce(or_, found) if found else F.lit(False)


def _marked(records: DataFrame, filters: list[Filter]) -> DataFrame:
    """records with a flag for each among filter. Records of other properties get keys of their own, so that none is hot."""
    for f in {f.mark: f for f in filters if f.kind == "among"}.values():
        # filters on several properties may share one ids frame
        props = [g.prop for g in filters if g.kind == "among" and g.mark == f.mark]
        key = F.when(F.col("prop").isin(props) & F.col("to").isNotNull(), F.col("to")).otherwise(F.concat(F.lit("\0"), "claim_id"))
        ids = f.values[0].select(F.col("id").alias("__id")).distinct().withColumn("__found", F.lit(True))
        records = records.withColumn("__key", key).join(ids, F.col("__key") == F.col("__id"), "left").withColumn(f.mark, F.col("__found").isNotNull()).drop("__key", "__id", "__found")
    return records


def flags(docs: DataFrame, records: DataFrame, filters: list[Filter]) -> DataFrame:
    """(doc_id, one flag for each top-level path, one for each group): one pass over the records of the paths' properties."""
    paths = _paths(filters)
    top = {p: fs for p, fs in paths.items() if p[0] is None}
    groups: dict[str, dict] = {}
    for p, fs in paths.items():
        if p[0] is not None:
            groups.setdefault(p[0], {})[p] = fs
    out = docs.select("doc_id").distinct()
    records = _marked(records, filters)
    rows = records.where("depth = 0")
    if top:
        marks = [F.coalesce(F.bool_or(_any(fs, m)), F.lit(False)).alias(f"{flag_name(p)}{'_x' if m else ''}") for p, fs in top.items() for m in (False, True)]
        # records that no condition looks at need no shuffle
        wanted = reduce(or_, [_any(fs, m) for fs in top.values() for m in (False, True)])
        found = rows.where(wanted).groupBy("doc_id").agg(*marks)
        out = out.join(found, "doc_id", "left")
        for p, fs in top.items():
            name = flag_name(p)
            value = F.coalesce(F.col(name), F.lit(False))
            if any(f.kind == "missing" for f in fs):
                value = value | ~F.coalesce(F.col(f"{name}_x"), F.lit(False))
            out = out.withColumn(name, value).drop(f"{name}_x")
    for parent, members in groups.items():
        out = out.join(_group(records, parent, members, top.get((None, parent), [])), "doc_id", "left")
        name = f"g_{parent}"
        out = out.withColumn(name, F.coalesce(name, F.lit(False)))
    return out


def _group(records: DataFrame, parent: str, members: dict[tuple, list[Filter]], narrowing: list[Filter]) -> DataFrame:
    """(doc_id, g_<parent>): whether one claim of the parent property satisfies all members.

    A member that only asks for missing, and is the only one, asks instead that no qualifying parent claim carries the property.
    """
    # one parent claim gives one group: its own records (several where a reference was expanded) and those below it
    asked = sorted({f.prop for fs in members.values() for f in fs if f.prop})
    below = (F.col("parent_prop") == parent) & (F.col("depth") > 0)
    below = below & F.col("prop").isin(asked) if all(f.prop for fs in members.values() for f in fs) else below  # others need no shuffle
    members_only = not narrowing and not any(f.kind == "missing" for fs in members.values() for f in fs)
    if members_only:
        # the parent claim itself says nothing here: only records that some member looks for are brought together
        rows = records.where((F.col("parent_prop") == parent) & (F.col("depth") == 1) & reduce(or_, [_any(fs, False) for fs in members.values()]))
    else:
        rows = records.where(below | ((F.col("prop") == parent) & (F.col("depth") == 0)))
    key = F.when(F.col("depth") == 0, F.col("claim_id")).otherwise(F.col("parent_claim_id")).alias("__claim")
    sub, own = F.col("depth") > 0, F.col("depth") == 0
    narrow = _any([f for f in narrowing if f.kind != "missing"], False) if narrowing else F.lit(True)
    marks = [F.coalesce(F.bool_or(own & narrow), F.lit(False)).alias("__own")]
    for i, fs in enumerate(members.values()):
        marks += [F.coalesce(F.bool_or(sub & _any(fs, False)), F.lit(False)).alias(f"__m{i}"), F.coalesce(F.bool_or(sub & _any(fs, True)), F.lit(False)).alias(f"__x{i}")]
    claims = rows.groupBy("doc_id", key).agg(*marks).where(F.lit(True) if members_only else F.col("__own"))
    alone = len(members) == 1 and all(f.kind == "missing" for f in next(iter(members.values())))
    if alone:
        return claims.groupBy("doc_id").agg((~F.bool_or("__x0")).alias(f"g_{parent}"))
    each = [F.col(f"__m{i}") | (~F.col(f"__x{i}") if any(f.kind == "missing" for f in fs) else F.lit(False)) for i, fs in enumerate(members.values())]
    return claims.groupBy("doc_id").agg(F.bool_or(reduce(and_, each)).alias(f"g_{parent}"))


def _names(filters: list[Filter]) -> list[str]:
    return list(dict.fromkeys(flag_name(p) if p[0] is None else f"g_{p[0]}" for p in _paths(filters)))


def apply_filters(docs: DataFrame, records: DataFrame, filters: list[Filter], prefilters: list[Filter] | None = None, exclude: list[Filter] | None = None) -> DataFrame:
    """The documents that satisfy filters (without those of exclude) and, each for itself, prefilters."""
    kept = [f for f in filters if f not in (exclude or [])]
    out = docs.select("doc_id").distinct()
    if kept:
        out = flags(docs, records, kept).where(reduce(and_, map(F.col, _names(kept)))).select("doc_id")
    for f in prefilters or []:
        out = out.join(flags(docs, records, [f]).where(F.col(_names([f])[0])).select("doc_id"), "doc_id", "left_semi")
    return out


def reverse_scope(docs: DataFrame, records: DataFrame, target: str) -> DataFrame:
    """Documents that refer to target by any property, at any depth."""
    return docs.join(records.where(F.col("to") == target).select("doc_id"), "doc_id", "left_semi")


def ids_scope(docs: DataFrame, ids: list[str]) -> DataFrame:
    return docs.where(F.col("doc_id").isin(ids))


def hide_props(records: DataFrame, hidden: list[str], selected: list[str] = ()) -> DataFrame:
    """records without hidden properties, but for those selected in a pooled has filter."""
    gone = [p for p in hidden if p not in selected]
    return records.where(~F.col("prop").isin(gone)) if gone else records


def active_counts(docs: DataFrame, records: DataFrame, filters: list[Filter]) -> DataFrame:
    """(filter, n): for each path the documents left by all other paths; all from one flags pass."""
    marked, names = flags(docs, records, filters), _names(filters)
    rest = lambda name: reduce(and_, [F.col(x) for x in names if x != name], F.lit(True))
    one = marked.agg(*[F.count_if(rest(x)).alias(x) for x in names])
    return one.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*names))).alias("filter", "n"))
