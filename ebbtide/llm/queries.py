"""The registered query of each operator and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.llm.chat import chat_digests, format_chats
from ebbtide.llm.collocations import collocations
from ebbtide.llm.decontaminate import contaminated
from ebbtide.llm.language import identify_languages
from ebbtide.llm.near_dedup import near_duplicates
from ebbtide.llm.packing import pack_documents
from ebbtide.llm.passages import repeated_passages
from ebbtide.llm.ranked_search import ranked_search
from ebbtide.llm.secret_scan import find_secrets, secret_digests
from ebbtide.llm.suffix_tree import score_texts
from ebbtide.llm.token_trees import apply_edits, token_trees
from ebbtide.llm.topk import integer_vectors, top_k
from ebbtide.llm.toxicity import score_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), width=4, percent=80)


@query
def op2_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    trap = "\\### Assistant: </turn> ok"
    added = spark.createDataFrame([(-7, 0, "user", trap), (-7, 1, "assistant", trap)], "conv_id long, turn long, role string, text string")
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return chat_digests(format_chats(turns.unionByName(added)))


@query
def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return identify_languages(table(spark, folder, "documents"))


@query
def op4_string_tiling(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op5_threshold_top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = integer_vectors(table(spark, folder, "embeddings"), "vec_id", "embedding", scale=256)
    return top_k(vectors.where("id % 50 = 0"), vectors, k=5)


@query
def op6_token_trees(spark: SparkSession, folder: str) -> DataFrame:
    """Three edits in every document: a word joined, a part repeated from the start, a cut at the end."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    n = F.length(F.coalesce("text", F.lit("")))
    draw = F.pmod(F.xxhash64("doc_id"), n + 1).cast("int")
    edits = F.array(
        F.struct(draw.alias("start"), (draw + 1).alias("stop"), F.lit("").alias("text")),
        F.struct((n / 2).cast("int").alias("start"), (n / 2 + 40).cast("int").alias("stop"), F.substring("text", 1, 60).alias("text")),
        F.struct((n - 25).alias("start"), (n + 100).alias("stop"), F.lit(" the end.").alias("text")),
    )
    return apply_edits(token_trees(docs.withColumn("edits", edits))).select("doc_id", "tokens_before", "tokens_after", "encoded_chars")


@query
def op7_certified_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"))


@query
def op8_compact_windows(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_passages(table(spark, folder, "documents"))


@query
def op9_counterfactual_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op10_suffix_tree(spark: SparkSession, folder: str) -> DataFrame:
    return score_texts(table(spark, folder, "documents"))


@query
def op11_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_digests(find_secrets(table(spark, folder, "documents")))


@query
def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents"))


@query
def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
