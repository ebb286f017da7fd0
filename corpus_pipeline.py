"""Documents to packed training sequences, one operator a stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from edgeloom.llm.linededup import line_dedup
from edgeloom.llm.mixing import mix
from edgeloom.llm.packing import pack
from edgeloom.llm.quality import quality_filter
from edgeloom.llm.shingles import similar_classes
from edgeloom.llm.simhash import near_dedup
from edgeloom.storage import Scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go."""
    return quality_filter(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines go, from every document."""
    return line_dedup(docs, count_col=None)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8."""
    return near_dedup(docs, classes_of=similar_classes, shingle=5, similarity=0.8)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training stream in order: documents as often as the mix reads them."""
    return mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return pack(docs)


STAGES = [("quality", quality_rules), ("line_dedup", line_stage), ("near_dedup", near_duplicates), ("mixing", source_mix), ("packing", packed)]
#: Tokenisation and fingerprints have no SQL form; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage is written and read again before the next."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return docs
