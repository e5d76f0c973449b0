"""Search records: one long row for each indexed value of a claim, references expanded to ancestors, ranges as windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessella.functions.values import amount_window, amount_value, day_start, time_windows
from tessella.operators.hierarchy import expand_refs, mark_leaves

RECORD = ["doc_id", "claim_id", "parent_claim_id", "parent_prop", "depth", "collection", "claim_type", "prop", "to", "direct", "is_leaf", "unit", "lo", "hi", "hi_incl", "text"]


def records(claims: DataFrame, ancestors: DataFrame | None, kinds: set[str] | None = None, plain_days: bool = False) -> DataFrame:
    """The records of claims. A sub-claim's record carries its parent claim's property.

    References are expanded and their leaves marked; without ancestors each stands for itself alone, unmarked, and nothing is joined.
    All other claims are shaped in one projection. Only times that are no plain days go through Python.
    kinds are the claim types that can occur; what they rule out has no branch in the plan.
    plain_days promises that all times are plain days, which leaves the Python branch out.
    """
    blank = {"to": "string", "direct": "boolean", "is_leaf": "boolean", "lo": "double", "hi": "double", "hi_incl": "boolean", "text": "string"}

    def shaped(df: DataFrame, collection) -> DataFrame:
        have = {c: F.col(c) if c in df.columns else F.lit(None).cast(kind) for c, kind in blank.items()}
        return df.select(*[{"collection": collection, "claim_type": F.col("type")}.get(c, have.get(c, F.col(c))).alias(c) for c in RECORD])

    kind, day = F.col("type"), F.when(F.col("type") == "time", day_start(F.col("raw"), F.col("time_precision")))
    lo, hi, incl = amount_window(amount_value(F.col("raw")), F.col("precision"))
    simple = claims.where((kind != "ref") & ((kind != "time") | day.isNotNull())).drop("to").withColumns({
        "text": F.when(kind.isin("id", "string", "html", "link"), F.col("str_value")),
        "lo": F.when(kind == "amount", lo).otherwise(day), "hi": F.when(kind == "amount", hi).otherwise(day + 86_400.0),
        "hi_incl": F.when(kind == "amount", incl).when(kind == "time", False),
    })
    out = shaped(simple, F.when(kind.isin("has", "none", "unknown"), "rel").otherwise(kind)) if kinds is None or kinds - {"ref"} else None
    if kinds is not None and "ref" not in kinds:
        rel = None
    elif ancestors is None:
        rel = shaped(claims.where("type = 'ref'").withColumn("direct", F.lit(True)), F.lit("rel"))
    else:
        rel = shaped(mark_leaves(expand_refs(claims, ancestors)), F.lit("rel"))
    if plain_days or (kinds is not None and "time" not in kinds):
        return rel.unionByName(out) if rel is not None and out is not None else out if rel is None else rel
    times = shaped(time_windows(claims.where((kind == "time") & day.isNull()).drop("to")), F.lit("time"))
    return (rel.unionByName(out) if rel is not None else out).unionByName(times)
