"""The registered query of each operator: whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm import licenses, linededup, lmscore, mixing, packing, quality, simhash, topk, toxicity, urls
from edgeloom.llm.text import word_count


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``component_id`` and fingerprint of every document."""
    c = simhash.simhash_classes(read(spark, sf_dir, "documents"))
    return c.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each piece of a document."""
    return packing.pack(read(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    return urls.url_verdicts(read(spark, sf_dir, "pages"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and license found in it."""
    return licenses.license_matches(read(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the training stream takes of every document, and the position of its first read (null if it is not taken)."""
    p = mixing.mixed_sizes(read(spark, sf_dir, "documents"))
    return p.select("doc_id", "size", "source_size", "target", "taken", F.round("position", 9).alias("position"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction of every document, with the number of toxic spans and the byte offset of the first."""
    t = toxicity.toxicity_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return t.select("doc_id", "held_out", "score", "predicted", F.size("spans").cast("long").alias("n_spans"), F.when(F.size("spans") > 0, F.col("spans")[0][0]).alias("first_offset"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of every document."""
    q = quality.quality_scores(read(spark, sf_dir, "documents"))
    return q.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("distance", 6).alias("distance"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines removed of every document, words left and a digest of the text that stays."""
    d = linededup.line_dedup(read(spark, sf_dir, "documents"))
    return d.select("doc_id", "removed_lines", word_count(F.col("text")).alias("kept_words"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every document under the add-one unigram and under the model."""
    return lmscore.lm_scores(read(spark, sf_dir, "documents"))


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best candidates of every query vector."""
    return topk.top_k(read(spark, sf_dir, "embeddings"))
