"""How many rows joins make and shuffles move, by the metrics of the plans that ran."""

import contextlib

from pyspark.sql import functions as F

from tessella.llm import kneser_ney, near_dup


@contextlib.contextmanager
def plain_plans(spark):
    now = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in now}
    for k, v in now.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def metrics(df, node, metric):
    """The metric of each such node of the plan of df, which has run."""
    found, open_ = [], [df._jdf.queryExecution().executedPlan()]
    while open_:
        p = open_.pop()
        if p.nodeName() == node:
            found.append(p.metrics().get(metric).get().value())
        open_ += [p.children().apply(i) for i in range(p.children().size())]
    return found


def test_meeting_fetches_the_smaller_side_first(spark):
    """600 sets of component 0 share ten shingles with one set each of components 1000 to 1019, of which two have the right size."""
    large = spark.range(600).select(F.col("id").alias("row"), F.lit(0).cast("long").alias("label"), F.lit(100).alias("n"))
    small = spark.range(1000, 1020).select(F.col("id").alias("row"), F.col("id").alias("label"), F.when(F.col("id") < 1002, 100).otherwise(101).alias("n"))
    rest = F.when(F.col("n") == 100, 100).otherwise(80)  # of 101, too few are left
    rows = large.unionByName(small).withColumn("s", F.explode(F.sequence(F.lit(1), F.lit(10)).cast("array<long>"))).withColumn("rest", rest.cast("int"))
    with plain_plans(spark):
        out = near_dup._meeting(rows.repartition(3), 80)
        got = {(r.a, r.b) for r in out.collect()}
        made = metrics(out, "SortMergeJoin", "numOutputRows")
    assert got == {(a, b) for a in range(600) for b in (1000, 1001)} | {(1000, 1001)}
    assert sorted(made)[:-1] == [30, 30] and max(made) <= 10 * len(got)


def test_other_texts_are_not_shuffled(spark):
    rows = spark.range(5_000).select(F.when(F.col("id") % 7 > 0, F.col("id")).alias("id"), F.lit("text").alias("t"))
    ids = spark.createDataFrame([(3,), (5,), (7,), (4_999,), (9_999,), (None,)], "id long")
    with plain_plans(spark):
        out = kneser_ney.of_ids(rows, ids)
        assert sorted(r.id for r in out.collect()) == [3, 5, 4_999]
        assert sum(metrics(out, "Exchange", "shuffleRecordsWritten")) < 100
    assert kneser_ney.of_ids(rows, ids.limit(0)).collect() == []
