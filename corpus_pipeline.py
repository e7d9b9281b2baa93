"""From raw documents to packed token sequences, in five stages.

Each stage reads the Parquet its predecessor wrote, works on all of it, and writes what it
keeps: readable language, one document of each near-duplicate group, first occurrences of
repeated passages, nothing of the benchmark, and full sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.llm.decontaminate import contaminated
from ebbtide.llm.language import UNKNOWN, identify_languages
from ebbtide.llm.membership import only_members, without_members
from ebbtide.llm.near_dedup import near_duplicates
from ebbtide.llm.packing import pack_documents
from ebbtide.llm.passages import repeated_passages, without_passages
from ebbtide.llm.scratch import saved, text_batches


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognisable language: null texts and texts without a letter go."""
    with text_batches(spark):
        rejected = saved(identify_languages(docs).where(F.col("lang_pred") == UNKNOWN).select("doc_id"), "rejected")
    # Rows without an id cannot be named in a list; the same rule, stated on the text.
    return without_members(docs, "doc_id", rejected).where("doc_id IS NOT NULL OR text RLIKE '\\\\p{L}'")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group; repeated rows of one document once."""
    decided = saved(near_duplicates(docs), "decided")
    kept = without_members(docs, "doc_id", decided.where("NOT kept").select("doc_id"))
    repeated = decided.where("kept").groupBy("doc_id").count().where("count > 1").select("doc_id")
    return without_members(kept, "doc_id", repeated).union(only_members(kept, "doc_id", repeated).dropDuplicates(["doc_id", "text"]))


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that repeat a document with a smaller id are cut out."""
    return without_passages(docs, saved(repeated_passages(docs), "passages"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold half of a benchmark item go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return without_members(docs, "doc_id", saved(contaminated(docs, benchmark).select("doc_id").distinct(), "leaks"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and place."""
    return pack_documents(docs)


STAGES = [
    ("language", language_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", passage_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Sequences are not unique, so SQL cannot state the rows; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
