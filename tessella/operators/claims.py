"""Claims as long rows: made from typed rows by a field spec, filtered by confidence, picked, ordered, signed, nested.

The columns of a claims frame are CLAIM. A sub-claim names its parent in parent_claim_id and the parent's property in parent_prop;
depth is 0 for claims of a document.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

CLAIM = {
    "doc_id": "string", "claim_id": "string", "parent_claim_id": "string", "parent_prop": "string", "depth": "int", "ord": "int", "type": "string", "prop": "string",
    "confidence": "double", "str_value": "string", "raw": "string", "precision": "double", "time_precision": "string", "to": "string", "unit": "string", "lang": "string",
}
VALUES = ["str_value", "raw", "precision", "time_precision", "to", "unit", "lang"]
FLOOR = 0.5


def shuffled(df: DataFrame) -> DataFrame:
    """df as a side of a join by shuffle. Spark sees the rows that claims are made from, not how many claims it makes of each, nor that
    random ids don't compress, so it takes large frames of claims for small ones and would send them whole to every task."""
    return df.hint("merge")


def spread_join(big: DataFrame, small: DataFrame, on: list[str], parts: int = 64) -> DataFrame:
    """The inner join of big with small on columns of few values. Rows of big are dealt over parts by their content, and each row of
    small meets all parts: no value lands in one task, and nothing is sent whole to every task."""
    dealt = big.withColumn("__part", F.pmod(F.xxhash64(*big.columns), F.lit(parts)).cast("int"))
    each = small.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return dealt.join(shuffled(each), [*on, "__part"]).drop("__part")


def make_id(*parts: Column) -> Column:
    """22 characters that depend on the parts and their order only."""
    return F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, 22)


def _levels(claims: DataFrame, levels: int | None) -> int:
    """How many levels claims have: as the caller knows it, or by a pass over them."""
    return levels or 1 + claims.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]


def _checked(claims: DataFrame, levels: int | None) -> DataFrame:
    """claims, where one below the levels that a caller names is an error."""
    if levels is not None:
        claims = claims.withColumn("depth", F.when(F.col("depth") < levels, F.col("depth")).otherwise(F.raise_error(F.lit(f"a claim lies below {levels} levels")).cast("int")))
    return claims


def _short(id_: str) -> Column:
    """An id as bytes, without loss: two hexadecimal digits of one that has only such in one byte, behind a byte that says how."""
    c, plain = F.col(id_), F.col(id_).rlike("^[0-9a-f]*$")
    even = F.length(c) % 2 == 0
    return F.when(plain & even, F.concat(F.lit(b"0"), F.unhex(c))).when(plain, F.concat(F.lit(b"1"), F.unhex(F.concat(c, F.lit("0"))))).otherwise(F.concat(F.lit(b"2"), F.encode(c, "UTF-8")))


def _long(id_: str) -> Column:
    """The id that _short() made these bytes of."""
    how, rest = F.substring(id_, 1, 1), F.expr(f"substring({id_}, 2)")
    hexed = F.lower(F.hex(rest))
    return F.when(how == F.lit(b"0"), hexed).when(how == F.lit(b"1"), F.substr(hexed, F.lit(1), F.length(hexed) - 1)).otherwise(F.decode(rest, "UTF-8"))


def _gathered(claims: DataFrame, levels: int | None) -> DataFrame:
    """claims dealt by document: the one shuffle of a walk over the levels. Ids are the part that does not compress, so they are
    shuffled as bytes."""
    ids = ["claim_id", "parent_claim_id"]
    rows = _checked(claims, levels).withColumns({c: _short(c) for c in ids}).repartition("doc_id")
    return rows.withColumns({c: _long(c) for c in ids})


def _family(depth: int, *more: str) -> WindowSpec:
    """Claims of a level with the claim above them, all other claims by themselves. As it begins with the document, the walk up or down
    the levels of _gathered() claims sorts inside tasks and shuffles nothing."""
    return Window.partitionBy("doc_id", *more, F.when(F.col("depth") == depth, F.col("parent_claim_id")).otherwise(F.col("claim_id")))


@dataclass
class Field:
    """One claim of a typed row. Values are SQL expressions over the row; a row where ``when`` is false has no such claim."""

    prop: str
    type: str
    values: dict[str, str] = field(default_factory=dict)
    when: str = "true"
    ord: str = "0"
    key: str = "''"
    confidence: str = "1.0D"
    subs: list["Field"] = field(default_factory=list)
    prop_sql: str | None = None


def rows_to_claims(df: DataFrame, doc: str, fields: list[Field], floor: float | None = None) -> DataFrame:
    """The claims of typed rows: one projection with one struct for each field, then inline; no union of scans. Ids of claims that
    have sub-claims are made in a projection before, once for all of them. With a floor, claims under it and all below them are left
    out in the same projection: what confident() gives, without a join."""
    ids: dict[str, Column] = {}

    def struct(f: Field, parent: list[Column] | None, parent_id: Column, parent_prop: Column, depth: int, guard: Column) -> list[Column]:
        prop = F.expr(f.prop_sql) if f.prop_sql else F.lit(f.prop)
        base = [*(parent or [F.expr(doc)]), prop, F.expr(f.key).cast("string"), F.expr(f.ord).cast("string")]
        on, own_id = guard & F.expr(f.when), make_id(*base)
        if floor is not None:
            on = on & (F.expr(f.confidence).cast("double") >= floor)
        if f.subs:
            ids[name := f"__claim_{len(ids)}"] = own_id
            own_id = F.col(name)
        made = {
            "doc_id": F.expr(doc), "claim_id": own_id, "parent_claim_id": parent_id, "parent_prop": parent_prop, "depth": F.lit(depth),
            "ord": F.expr(f.ord), "type": F.lit(f.type), "prop": prop, "confidence": F.expr(f.confidence),
            **{v: F.expr(f.values[v]) if v in f.values else F.lit(None) for v in VALUES},
        }
        own = F.when(on, F.struct(*[made[c].cast(kind).alias(c) for c, kind in CLAIM.items()]))
        return [own, *[x for s in f.subs for x in struct(s, base, own_id, prop, depth + 1, on)]]

    none = F.lit(None).cast("string")
    all_claims = F.array(*[x for f in fields for x in struct(f, None, none, none, 0, F.lit(True))])
    return df.withColumns(ids).select(F.inline(all_claims)).where("claim_id IS NOT NULL")


def with_ids(claims: DataFrame) -> DataFrame:
    """claims whose claim_id follows from document, property and running number within them (ordered by ord, then value)."""
    w = Window.partitionBy("doc_id", "prop").orderBy("ord", F.to_json(F.struct(*VALUES)))
    return claims.withColumn("claim_id", make_id(F.col("doc_id"), F.col("prop"), F.row_number().over(w).cast("string")))


def fill_defaults(claims: DataFrame, docs: DataFrame, spec: DataFrame) -> DataFrame:
    """claims with none or unknown claims added where spec(prop, min, default) asks for more than a document of docs has."""
    have = claims.where("depth = 0").groupBy("doc_id", "prop").agg(F.count("*").alias("n"))
    wanted = spec.where("min > 0").select(F.collect_list(F.struct("prop", "min", "default"))).scalar()
    want = docs.select("doc_id").distinct().select("doc_id", wanted.alias("__spec")).select("doc_id", F.inline("__spec"))
    lack = want.join(have, ["doc_id", "prop"], "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n < min")
    rows = lack.select("*", F.explode(F.sequence(F.lit(1), (F.col("min") - F.col("n")).cast("int"))).alias("i"))
    made = {c: F.lit(None).cast(kind) for c, kind in CLAIM.items()}
    made |= {"doc_id": F.col("doc_id"), "claim_id": make_id(F.col("doc_id"), F.col("prop"), F.lit("default"), F.col("i").cast("string")), "depth": F.lit(0), "ord": (F.col("n") + F.col("i")).cast("int"), "type": F.col("default"), "prop": F.col("prop"), "confidence": F.lit(1.0)}
    return claims.unionByName(rows.select(*[made[c].alias(c) for c in CLAIM]))


def confident(claims: DataFrame, floor: float = FLOOR, levels: int | None = None) -> DataFrame:
    """claims without those under the floor and everything below them, however deep: what goes is passed on from level to level.
    levels are as in claim_signature()."""
    rows = _gathered(claims, levels).withColumn("__low", F.col("confidence") < floor)
    for depth in range(1, _levels(claims, levels)):
        above = F.bool_or(F.when(F.col("depth") == depth - 1, F.col("__low"))).over(_family(depth))
        rows = rows.withColumn("__low", F.when(F.col("depth") == depth, F.coalesce("__low", F.lit(False)) | F.coalesce(above, F.lit(False))).otherwise(F.col("__low")))
    return rows.where(~F.coalesce("__low", F.lit(False))).drop("__low")


def _by_confidence() -> list[Column]:
    return [F.desc("confidence"), F.asc("ord"), F.asc("claim_id")]


def best_claim(claims: DataFrame, type_: str, prop: str) -> DataFrame:
    """For each document its surest claim of a type and property, the earlier one on a tie."""
    rows = claims.where((F.col("type") == type_) & (F.col("prop") == prop) & (F.col("depth") == 0))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy(*_by_confidence()))).where("n = 1").drop("n")


def claims_of(claims: DataFrame, type_: str, prop: str, floor: float = FLOOR) -> DataFrame:
    """All claims of a type and property at the floor or above, numbered by confidence within each document."""
    rows = claims.where((F.col("type") == type_) & (F.col("prop") == prop) & (F.col("confidence") >= floor))
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("doc_id").orderBy(*_by_confidence())))


def claim_lists(claims: DataFrame, prop: str, list_prop: str = "LIST", order_prop: str = "ORDER_IN_LIST") -> DataFrame:
    """(doc_id, list, position, claim_id): claims of prop by the list they name, ordered by their place in it, unplaced last."""
    subs = claims.where(F.col("prop").isin(list_prop, order_prop))
    facts = subs.groupBy("parent_claim_id").agg(F.max(F.when(F.col("prop") == list_prop, F.col("str_value"))).alias("list"), F.min(F.when(F.col("prop") == order_prop, F.col("raw").try_cast("double"))).alias("place"))
    rows = claims.where(F.col("prop") == prop).join(shuffled(facts.withColumnRenamed("parent_claim_id", "claim_id")), "claim_id", "left").withColumn("list", F.coalesce("list", F.lit("")))
    w = Window.partitionBy("doc_id", "list").orderBy(F.asc_nulls_last("place"), "ord", "claim_id")
    return rows.select("doc_id", "list", F.row_number().over(w).alias("position"), "claim_id")


def nest_claims(claims: DataFrame, depth: int = 2) -> DataFrame:
    """(doc_id, claims): one row for each document with its claims in order, sub-claims inside their claim as sub. depth is the
    number of levels; a claim below them is an error. Claims are shuffled once, by document."""
    if depth < 1:
        raise ValueError("depth must be at least 1")
    names = ["ord", "claim_id", *[c for c in CLAIM if c not in ("doc_id", "parent_claim_id", "depth", "ord", "claim_id")]]
    rows = _gathered(claims.select("doc_id", "parent_claim_id", "depth", *names), depth)
    for level in range(depth - 1, 0, -1):
        item = F.struct(*names, *(["sub"] if "sub" in rows.columns else []))
        found = F.sort_array(F.collect_list(F.when(F.col("depth") == level, item)).over(_family(level)))
        rows = rows.withColumn("__sub", found).where(F.col("depth") < level).withColumn("sub", F.when(F.size("__sub") > 0, F.col("__sub"))).drop("__sub")
    item = F.struct(*names, *(["sub"] if depth > 1 else []))
    return rows.where("depth = 0").groupBy("doc_id").agg(F.sort_array(F.collect_list(item)).alias("claims"))


def explode_claims(nested: DataFrame) -> DataFrame:
    """The long rows of nest_claims(), of any number of levels, by one pass over them."""
    def rows(c: Column, names: list[str], kind, parent: Column, depth: int) -> Column:
        made = {"doc_id": F.col("doc_id"), "parent_claim_id": parent, "depth": F.lit(depth)}
        own = F.array(F.struct(*[made.get(x, c[x] if x in names else F.lit(None)).cast(k).alias(x) for x, k in CLAIM.items()]))
        if "sub" not in names:
            return own
        kind = kind["sub"].dataType.elementType
        below = F.flatten(F.transform(c["sub"], lambda s: rows(s, kind.names, kind, c["claim_id"], depth + 1)))
        return F.concat(own, F.coalesce(below, F.array().cast(own_type)))

    own_type = "array<struct<" + ",".join(f"`{x}`:{k}" for x, k in CLAIM.items()) + ">>"
    kind = nested.schema["claims"].dataType.elementType
    tops = nested.select("doc_id", F.explode("claims").alias("c"))
    return tops.select(F.inline(rows(F.col("c"), kind.names, kind, F.lit(None).cast("string"), 0)))


def claim_signature(claims: DataFrame, with_id: bool = False, with_sub: bool = True, levels: int | None = None, by: list[str] = [], top: bool = False) -> DataFrame:  # noqa: B006
    """(doc_id, claim_id, prop, depth, signature): equal for claims with equal type, property, confidence and values (and ids, and
    equal sub-claims in any order, however deep).

    Bottom-up: each level signs its own values and the sorted signatures of its sub-claims, so a claim's signature covers its whole
    tree in 16 bytes. Claims are shuffled once, by document, as ids and signatures only. levels is how many levels the claims have at
    most, where the caller knows it; else a pass over the claims finds it. by names columns that keep claims with equal ids apart,
    which the result then has too. top gives the claims of documents only: others end where they are signed into the claim above
    them, and those of the last level, which nothing lies below, move without an id.
    """
    short = lambda c: F.unhex(F.substring(F.sha2(c, 256), 1, 32))
    own = short(F.to_json(F.struct("type", "prop", "confidence", *VALUES, *(["claim_id"] if with_id else []))))
    rows = claims.select("doc_id", *by, "claim_id", "parent_claim_id", "prop", "depth", own.alias("signature"))
    shown = ["doc_id", *by, "claim_id", "prop", "depth", F.lower(F.hex("signature")).alias("signature")]
    if not with_sub:
        return rows.where("depth = 0").select(shown) if top else rows.select(shown)
    last = _levels(claims, levels) - 1
    if top:
        rows = rows.withColumns({"prop": F.when(F.col("depth") == 0, F.col("prop")), "claim_id": F.when((F.col("depth") < last) | (F.col("depth") == 0), F.col("claim_id"))})
    rows = _gathered(rows, levels)
    for depth in range(last, 0, -1):
        sub = F.sort_array(F.collect_list(F.when(F.col("depth") == depth, F.hex("signature"))).over(_family(depth, *by)))
        rows = rows.withColumn("__sub", sub).withColumn("signature", F.when((F.col("depth") == depth - 1) & (F.size("__sub") > 0), short(F.concat_ws("|", F.hex("signature"), "__sub"))).otherwise(F.col("signature"))).drop("__sub")
        rows = rows.where(F.col("depth") < depth) if top else rows
    return rows.select(shown)


def navigate(claims: DataFrame, path: list[str], floor: float = FLOOR) -> DataFrame:
    """(doc_id, start_id, claim_id, ...): claims reached from a document's claim of path[0] through sub-claims of path[1:], all at the floor or above."""
    rows = claims.where((F.col("confidence") >= floor) & (F.col("prop") == path[0]) & (F.col("depth") == 0)).select(F.col("claim_id").alias("start_id"), F.col("claim_id").alias("at"))
    for prop in path[1:]:
        step = claims.where((F.col("confidence") >= floor) & (F.col("prop") == prop)).select(F.col("parent_claim_id").alias("at"), F.col("claim_id").alias("next"))
        rows = rows.join(shuffled(step), "at").select("start_id", F.col("next").alias("at"))
    return claims.join(shuffled(rows.withColumnRenamed("at", "claim_id")), "claim_id").select("doc_id", "start_id", *[c for c in CLAIM if c != "doc_id"])


def with_paths(claims: DataFrame, depth: int | None = None, levels: int | None = None) -> DataFrame:
    """claims with path: the properties from the document down to the claim, joined by dots. All levels, or depth of them. Paths are
    passed on from level to level; claims whose parent is not there are left out. levels are as in claim_signature()."""
    rows = claims if depth is None else claims.where(F.col("depth") < depth)
    last = _levels(rows, levels) if depth is None else depth if levels is None else min(depth, levels)
    if last == 1:
        return rows.where("depth = 0").withColumn("path", F.col("prop"))
    if last == 2:  # one join of the sub-claims; claims of documents, which have their paths, are not shuffled
        up = rows.where("depth = 0").select(F.col("claim_id").alias("parent_claim_id"), F.col("prop").alias("__up"))
        subs = _checked(rows.where("depth > 0"), levels).join(shuffled(up), "parent_claim_id").withColumn("path", F.concat("__up", F.lit("."), "prop"))
        return rows.where("depth = 0").withColumn("path", F.col("prop")).unionByName(subs.drop("__up"))
    rows = _gathered(rows, levels).withColumn("path", F.when(F.col("depth") == 0, F.col("prop")))
    for d in range(1, last):
        up = F.max(F.when(F.col("depth") == d - 1, F.col("path"))).over(_family(d))
        rows = rows.withColumn("__up", up).withColumn("path", F.when(F.col("depth") == d, F.concat("__up", F.lit("."), "prop")).otherwise(F.col("path"))).drop("__up")
    return rows.where("path IS NOT NULL")


def match_paths(claims: DataFrame, specs: list[str], depth: int | None = None, levels: int | None = None) -> DataFrame:
    """with_paths() rows that match a spec: dotted properties, where * is any one property and ** any properties or none."""
    def pattern(spec: str) -> str:
        out = ""
        for i, step in enumerate(spec.split(".")):
            if step == "**":
                out += r"(\.[^.]+)*"
            else:
                out += r"\." + (r"[^.]+" if step == "*" else "\\Q" + step + "\\E")
        return out
    rows = with_paths(claims, depth, levels)
    return rows.where(F.concat(F.lit("."), F.col("path")).rlike("^(" + "|".join(map(pattern, specs)) + ")$"))


def select_by_language(claims: DataFrame, props: list[str], lang: str, chain: dict[str, list[str]]) -> DataFrame:
    """(doc_id, str_value, lang): each document's string of props in the language or the first of its fallback chain that has one."""
    order = [lang, *chain.get(lang, []), "und"]
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.coalesce("lang", F.lit("und")))
    rows = claims.where(F.col("prop").isin(props) & (F.col("type") == "string") & (F.col("depth") == 0)).withColumn("place", place).where("place > 0")
    w = Window.partitionBy("doc_id").orderBy("place", *_by_confidence())
    return rows.withColumn("n", F.row_number().over(w)).where("n = 1").select("doc_id", "str_value", F.coalesce("lang", F.lit("und")).alias("lang"))


def with_lang_unit(claims: DataFrame, languages: DataFrame, lang_prop: str = "IN_LANGUAGE", unit_prop: str = "IN_UNIT") -> DataFrame:
    """claims with langs (codes of their IN_LANGUAGE sub-claims by languages(id, code), und without any) and in_unit."""
    subs = claims.where(F.col("prop").isin(lang_prop, unit_prop)).join(languages, F.col("to") == F.col("id"), "left")
    found = subs.groupBy("parent_claim_id").agg(F.sort_array(F.collect_set(F.when(F.col("prop") == lang_prop, F.col("code")))).alias("langs"), F.min(F.when(F.col("prop") == unit_prop, F.col("to"))).alias("in_unit"))
    rows = claims.join(shuffled(found.withColumnRenamed("parent_claim_id", "claim_id")), "claim_id", "left")
    return rows.withColumn("langs", F.when(F.coalesce(F.size("langs"), F.lit(0)) > 0, F.col("langs")).otherwise(F.array(F.lit("und"))))


def claim_text(claims: DataFrame) -> DataFrame:
    """claims with text: the value as an export shows it."""
    t = F.col("type")
    text = (
        F.when(t.isin("id", "string", "html", "link"), F.col("str_value")).when(t == "amount", F.concat_ws(" ", "raw", "unit")).when(t == "time", F.col("raw"))
        .when(t == "ref", F.col("to")).when(t.isin("has", "none", "unknown"), F.upper(t))
    )
    return claims.withColumn("text", text)


def interval_text(df: DataFrame) -> Column:
    """[a, b) and the like from from_raw, to_raw, from_open, to_open and the end states."""
    end = lambda s: F.when(F.col(f"{s}_state") == "unknown", "?").when(F.col(f"{s}_state") == "none", "-").otherwise(F.col(f"{s}_raw"))
    return F.concat(F.when(F.col("from_open"), "(").otherwise("["), end("from"), F.lit(", "), end("to"), F.when(F.col("to_open"), ")").otherwise("]"))
