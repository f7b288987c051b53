"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsewide.llm import alignment, chat, decontaminate, embeddings, html, jaccard, licenses, lines, mixing, pii, quality, trie, urls
from pulsewide.llm.oracles import ORACLES  # noqa: F401 - the queries' SQL, beside them

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_register
def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html.extract_main_text(_table(spark, sf_dir, "pages"), carry=["page_id", "url"])
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.col("n_main_chars").alias("n_chars"))


@_register
def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan_licenses(_table(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


@_register
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(_table(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select("doc_id", *quality.BASE, "base_failed", "kept")


@_register
def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = urls.filter_urls(_table(spark, sf_dir, "pages"), carry=["page_id"])
    return out.select("page_id", "host", "path", "rule", "verdict")


@_register
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find_pii(_table(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select(
        "doc_id", *[f"n_{k}" for k in pii.KINDS],
        F.sha2(pii.joined(F.col("base_spans")), 256).alias("base_sha256"), pii.joined(F.col("all_spans")).alias("spans"),
    )


@_register
def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicate_groups(_table(spark, sf_dir, "documents"))


@_register
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), carry=["doc_id"]
    )
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@_register
def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(_table(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@_register
def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.format_turns(turns))


@_register
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_table(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select("doc_id", "size", "source_size", "target", "taken")


@_register
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = alignment.align(_table(spark, sf_dir, "documents"), carry=["doc_id"], lists=False)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@_register
def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = trie.prefix_trie(_table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@_register
def op13_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))
