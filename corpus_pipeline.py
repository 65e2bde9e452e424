"""From raw documents to packed sequences: five stages over the whole corpus.

Every stage takes what its predecessor kept and, but for the last, returns the columns of
documents.  run() writes a stage's rows to the shared folder and reads them back for the
next, so no stage repeats another's work; what a stage wrote for itself, and the rows it
was given, are deleted once its own rows are written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.llm import language, mixing, packing, quality
from cutline.llm import near_dedup as near
from cutline.llm.queries import TOKENIZER
from cutline.llm.scratch import Scratch, released
from cutline.sources.ship import ship_package


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no known language."""
    ship_package(spark)
    return language.keep_language(docs)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score as label 0."""
    ship_package(spark)
    return quality.keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that is alike in five-word shingles."""
    ship_package(spark)
    return near.near_dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws documents by temperature-mixed source weights."""
    return mixing.mix_sources(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs token pieces into sequences of at most 2048 tokens."""
    ship_package(spark)
    out = packing.pack_documents(docs, TOKENIZER, with_ids=False)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("sequence_id"), F.col("offset"))


STAGES = [
    ("language_id", identify_language),
    ("quality_classifier", classify_quality),
    ("minhash_near_dedup", drop_near_copies),
    ("temperature_mixing", mix),
    ("best_fit_packing", pack),
]
#: Language identification and packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        scratch = Scratch(spark, "pipeline")
        with released():
            docs = scratch.table(stage(spark, docs, sf_dir), name)
        if before:
            before.drop()
        before = scratch
    return STAGES[-1][1](spark, docs, sf_dir)
