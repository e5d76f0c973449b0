from pyspark.sql import functions as F

from tessella.operators import grouping as G


def test_group_tree_makes_its_inputs_once(spark):
    """What follows the written groups reads them: the plan of the result has no scan of the inputs left."""
    docs = spark.range(30).select(F.concat(F.lit("d"), F.col("id")).alias("doc_id"), F.col("id").alias("s"))
    records = spark.range(20).select(F.concat(F.lit("d"), F.col("id")).alias("doc_id"), F.lit("IN").alias("prop"), F.lit("ref").alias("claim_type"), F.lit(0).alias("depth"), F.lit(True).alias("is_leaf"), F.concat(F.lit("g"), F.col("id") % 3).alias("to"))
    labels = spark.createDataFrame([("g0", "zero"), ("g1", "one")], "id string, label string")
    out = G.group_tree(docs, records, ["IN"], [F.asc("s")], labels, cap=25)
    rows = out.orderBy("position").collect()
    assert [h.docs for r in rows for h in r.headings if h.first] == [6, 7, 7, 10] and len(rows) == 25 and rows[0].more
    assert [h.id for r in rows for h in r.headings if h.first] == ["g2", "g1", "g0", None]
    assert "Range (" not in out._jdf.queryExecution().executedPlan().toString()
