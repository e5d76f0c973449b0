"""A corpus pipeline over ``documents``: five stages, each by one operator of tessella.llm, each on all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each as Parquet in the shared folder and reads it again
as the next one's docs. All stages but the last return the columns of documents, and no stage writes to its input.

Null texts are kept by all stages and encode to no tokens. Rows of one doc_id with unlike texts are documents of their own until
near-dedup, which judges them alike; repeated rows share their verdict. Columns beside doc_id and text travel in one struct, so a
column named like one that an operator adds is never overwritten. Near-duplicates are of five words and a similarity of 0.8.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessella.llm import bpe, decontaminate, line_dedup, near_dup, toxicity
from tessella.llm.scratch import drop, table, written


def _packed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, __rest): all other columns in one struct."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in rest] or [F.lit(0).alias("none")]).alias("__rest"))


def _like(packed: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again."""
    return packed.select(*[F.col(c) if c in ("doc_id", "text") else F.col("__rest")[c].alias(c) for c in docs.columns])


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be toxic go. It learns from all labelled rows of the input documents."""
    rows = _packed(docs)
    judged = toxicity.fit(rows, table(spark, sf_dir, "labels")).score(rows, keep_text=True)
    return _like(judged.where("predicted = 0"), docs)


def stage_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of a recurring template, then recurring sentences inside lines and frequent short lines, go from all documents but
    their first; documents that keep no word of theirs go."""
    cleaned = _like(line_dedup.cut_passages(line_dedup.clean(_packed(docs))).where("kept"), docs)
    if "n_chars" not in docs.columns:
        return cleaned
    return cleaned.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))


def stage_near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest doc_id. Rows without a doc_id stay."""
    gone = near_dup.groups(docs.select("doc_id", "text"), size=5, percent=80).where("NOT kept").select("id").distinct()
    return docs.join(gone, docs["doc_id"] == gone["id"], "left_anti")


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, within its edit budget, go."""
    rows = docs.withColumn("__row", F.monotonically_increasing_id())  # of a file scan, which numbers rows alike each time
    found = decontaminate.matches(rows.select("__row", "text"), table(spark, sf_dir, "benchmark"), id_col="__row")
    gone = found.select(F.col("doc_id").alias("__gone")).distinct()
    return rows.join(gone, rows["__row"] == gone["__gone"], "left_anti").drop("__row")


def stage_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (little-endian unsigned 32-bit), and whether they decode to the text's bytes."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = bpe.round_trip(docs.select("doc_id", "text", "lang", "source").withColumn("__sum", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)), path, pattern, keep_tables=False)
    return encoded.select("doc_id", "lang", "source", "n_tokens", "ids", (F.sha2("decoded", 256) == F.col("__sum")).alias("round_trip"))


STAGES = [
    ("toxicity", stage_toxicity),
    ("line dedup", stage_line_dedup),
    ("near-dedup", stage_near_dup),
    ("decontamination", stage_decontaminate),
    ("encoding", stage_encode),
]

#: The classifier and the edit distance have no SQL form; tests/llm/test_pipeline.py holds each stage against a plain Python version
#: (the classifier against its own scores, row by row).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            drop(before)
        before = docs
    return docs
