"""The registered queries of this subpackage: thin callers of the operators with production parameters, and their SQL."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessella.llm import bpe, debruijn, decontaminate, hard_negatives, kneser_ney, language, line_dedup, lm_score, near_dup, periodic, quality, toxicity, warc
from tessella.llm.scratch import table


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def _held_out(folds: int, fold: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_warc_captures(spark, sf_dir).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_trigram_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"), order=3).withColumnRenamed("id", "doc_id")


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.groups(table(spark, sf_dir, "documents").select("doc_id", "text"), size=2, percent=80).withColumnRenamed("id", "doc_id")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kneser_ney.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.withColumnRenamed("id", "doc_id")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.clean(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.cut_passages(op7_line_dedup(spark, sf_dir))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", _held_out(4, 2))
    known = language.learn(docs.where("not held_out"))
    return language.identify(docs.drop("lang"), known).drop("lang_out")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", _held_out(5, 0))
    labels = table(spark, sf_dir, "labels").where(~_held_out(5, 0))
    return toxicity.fit(docs, labels).score(docs)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.select("vec_id", "embedding", moved.alias("label")), "vec_id", "label", "embedding")


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = debruijn.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text): with h = crc32(doc_id as text), g = h div 10, the n words of a text with h % 10 = 0 repeat a block of
    1 + (n - a) div (3 + g % 8) words from word a = g % n on. Other texts, and rows without a doc_id, stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")).alias("w"))
    sizes = chosen.select("doc_id", "text", "w", F.expr("h div 10").alias("g"), F.size("w").alias("n")).withColumn("a", F.when(F.col("n") > 0, F.expr("cast(g % n AS int)")))
    periods = sizes.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) AS int)"))
    tail = "slice(flatten(array_repeat(slice(w, a + 1, p), cast((n - a + p - 1) div p AS int))), 1, n - a)"
    return periods.select("doc_id", F.when(F.col("n") > 0, F.expr(f"array_join(concat(slice(w, 1, a), {tail}), ' ')")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_periodic_tails(table(spark, sf_dir, "documents"))
    return periodic.longest(periodic.periodic_runs(docs)).withColumnRenamed("id", "doc_id")


def queries() -> dict:
    return {"pipeline": corpus_pipeline.run, "op7_line_dedup": op7_line_dedup, "op7_passage_dedup": op7_passage_dedup, "op10_decontaminate": op10_decontaminate, "op1_byte_bpe": op1_byte_bpe, "op2_quality_rules": op2_quality_rules, "op3_warc": op3_warc, "op3_warc_captures": op3_warc_captures, "op4_lm_score": op4_lm_score, "op4_trigram_score": op4_trigram_score, "op5_near_dup": op5_near_dup, "op6_quality_classifier": op6_quality_classifier, "op8_language_id": op8_language_id, "op9_toxicity": op9_toxicity, "op11_hard_negatives": op11_hard_negatives, "op12_substring_dedup": op12_substring_dedup, "op13_periodic_runs": op13_periodic_runs}


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": quality.ORACLE, "op3_warc": warc.ORACLE, "op7_line_dedup": line_dedup.ORACLE, "op11_hard_negatives": hard_negatives.ORACLE, "op12_substring_dedup": debruijn.ORACLE}
