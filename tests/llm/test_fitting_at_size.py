"""Fitting on the driver stays small, and fitting on executors takes all that may be learned from."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from tessella.llm import kneser_ney, toxicity


def test_fitting_holds_little_beside_its_rows():
    r = np.random.default_rng(1)
    rows = [(np.sort(r.choice(200_000, 2_000, replace=False)).astype(np.int32), np.ones(2_000, np.float32)) for _ in range(1_000)]
    labels = np.arange(1_000) % 2
    tracemalloc.start()
    weights, _ = toxicity.fit_weights(rows, labels, rounds=3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (weights != 0).any() and peak < 40 * 2_000_000


def test_the_model_is_fitted_on_every_trusted_text_of_its_half(spark, monkeypatch):
    docs = spark.range(46_000).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.concat(F.lit("t"), (F.col("id") % 10).cast("string")).alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    seen, model = [], kneser_ney.model
    monkeypatch.setattr(kneser_ney, "model", lambda trusted: (seen.append(trusted.count()), model(trusted))[1])
    assert kneser_ney.classify(docs, labels).count() == 46_000
    assert seen == [docs.where(F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)) == 0).count()] and seen[0] > 20_000
