"""Reports on claims: cardinality, validity of claims and ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessella.operators.claims import shuffled


def cardinality_violations(claims: DataFrame, fields: DataFrame, has_class: DataFrame) -> DataFrame:
    """(doc_id, prop, n, min, max): documents whose number of claims of a class's field(class, prop, min, max) is out of bounds;
    max null is no bound."""
    n = claims.where("depth = 0").groupBy("doc_id", "prop").agg(F.count("*").alias("n"))
    rows = has_class.join(fields, "class").join(n, ["doc_id", "prop"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.where("n < min OR n > max").select("doc_id", "prop", "n", "min", "max").distinct()


def sub_cardinality_violations(claims: DataFrame, fields: DataFrame, has_class: DataFrame) -> DataFrame:
    """(doc_id, parent_claim_id, prop, n, min, max): claims, at any depth, whose number of sub-claims of a class's
    field(class, parent, prop, min, max) is out of bounds; parent is the property of the claim that has them."""
    asked = has_class.join(fields, "class").select("doc_id", "parent", "prop", "min", "max").distinct()
    asked = asked.groupBy("doc_id").agg(F.collect_list(F.struct("parent", "prop", "min", "max")).alias("f"))  # a document's fields
    # claims are shuffled once, by document; what follows groups inside tasks
    rows = claims.select("doc_id", "claim_id", "parent_claim_id", "prop", "depth").join(shuffled(asked), "doc_id")
    row = lambda claim, prop, n, bounds: F.struct(claim.alias("parent_claim_id"), prop.alias("prop"), n.alias("n"), bounds.alias("bounds"))
    bounds = lambda x: F.struct(x["min"].alias("min"), x["max"].alias("max"))
    own = F.transform(F.filter("f", lambda x: x.parent == F.col("prop")), lambda x: row(F.col("claim_id"), x.prop, F.lit(0).cast("long"), bounds(x)))
    sub = F.transform(F.slice(F.filter("f", lambda x: (F.col("depth") > 0) & (x.prop == F.col("prop"))), 1, 1), lambda x: row(F.col("parent_claim_id"), x.prop, F.lit(1).cast("long"), F.when(F.lit(False), bounds(x))))
    found = rows.select("doc_id", F.inline(F.concat(own, sub))).groupBy("doc_id", "parent_claim_id", "prop").agg(F.sum("n").alias("n"), F.collect_list("bounds").alias("b"))
    return found.select("doc_id", "parent_claim_id", "prop", "n", F.inline("b")).where("n < min OR n > max")


def cardinality_fills(violations: DataFrame) -> DataFrame:
    """(doc_id, prop, missing): how many default claims each field lacks."""
    return violations.where("n < min").select("doc_id", "prop", (F.col("min") - F.col("n")).alias("missing"))


def _report(rows: DataFrame, rules: dict, *keys: str) -> DataFrame:
    errors = F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]), lambda x: x.isNotNull())
    return rows.withColumn("errors", errors).where(F.size("errors") > 0).select(*keys, "errors")


def validate_claims(claims: DataFrame) -> DataFrame:
    """(doc_id, claim_id, errors) of claims that break a rule."""
    twice = claims.groupBy("claim_id").count().where("count > 1").select("claim_id", F.lit(True).alias("__twice"))
    rows = claims.join(twice, "claim_id", "left")
    c, t = F.col, F.col("type")
    return _report(rows, {
        "confidence": c("confidence").isNull() | ~c("confidence").between(-1, 1), "duplicate id": c("__twice").isNotNull(), "no property": c("prop").isNull(),
        "no value": (t.isin("id", "string", "html", "link") & c("str_value").isNull()) | (t.isin("amount", "time") & c("raw").isNull()) | ((t == "ref") & c("to").isNull()),
        "precision": ((t == "amount") & (c("precision").isNull() | (c("precision") <= 0))) | ((t == "time") & c("time_precision").isNull()),
        "value not allowed": t.isin("has", "none", "unknown") & F.coalesce("str_value", "raw", "to").isNotNull(),
    }, "doc_id", "claim_id")


def validate_intervals(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, errors) of intervals with from_/to_ v, p, open and state columns."""
    rules = {}
    for s in ("from", "to"):
        v, p, state = F.col(f"{s}_v"), F.col(f"{s}_p"), F.col(f"{s}_state")
        rules |= {f"{s} value with state": v.isNotNull() & state.isNotNull(), f"{s} missing": v.isNull() & state.isNull(), f"{s} precision": v.isNotNull() & (p.isNull() | (p <= 0)), f"{s} open without value": F.col(f"{s}_open") & v.isNull()}
    rules["empty"] = (F.col("from_v") == F.col("to_v")) & (F.col("from_open") | F.col("to_open"))
    return _report(rows, rules, *keys)


def validate_ranges(records: DataFrame) -> DataFrame:
    """(doc_id, claim_id, errors) of amount and time records whose window is not a window."""
    rows = records.where("collection IN ('amount', 'time')")
    lo, hi = F.col("lo"), F.col("hi")
    return _report(rows, {"missing end": lo.isNull() | hi.isNull(), "not a number": F.isnan(lo) | F.isnan(hi), "reversed": lo > hi, "empty": (lo == hi) & ~F.coalesce("hi_incl", F.lit(False))}, "doc_id", "claim_id")
