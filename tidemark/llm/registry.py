"""The queries of this subpackage over the given tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import (dialogue_repair, hard_negatives, langid, lattice_lm, mixing, packing, secret_scan, sketch_dedup, token_frames, topk, toxicity,
                          url_filter, vector_dedup)
from tidemark.llm.batches import load

Query = Callable[[SparkSession, str], DataFrame]

BYTE_RANKS = "byte_bpe_50k.tiktoken"
BYTE_TOKENIZER = "byte_bpe_50k.json"
WORD_TOKENIZER = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op1_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.scan(load(spark, folder, "documents"), public_tokenizers.path(BYTE_RANKS))


def op2_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(load(spark, folder, "embeddings"), F.col("id") % 20 == 0, 20)


def op3_vector_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return vector_dedup.near_duplicates(load(spark, folder, "embeddings"))


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(load(spark, folder, "documents"), public_tokenizers.path(BYTE_TOKENIZER))


def op5_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return sketch_dedup.near_duplicates(load(spark, folder, "documents"), width=3, percent=85)


def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return langid.predict(load(spark, folder, "documents"))


def op7_lattice_lm(spark: SparkSession, folder: str) -> DataFrame:
    return lattice_lm.predict(load(spark, folder, "documents"), public_tokenizers.path(PIECES))


def op8_token_frames(spark: SparkSession, folder: str) -> DataFrame:
    return token_frames.token_files(load(spark, folder, "documents"), public_tokenizers.path(WORD_TOKENIZER))


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.predict(load(spark, folder, "documents"), load(spark, folder, "labels"))


def op9_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(load(spark, folder, "documents"))


def op11_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """The list holds the crawl's addresses on hosts with an unwanted word in their name."""
    pages = load(spark, folder, "pages")
    return url_filter.judge(pages, url_filter.unwanted(pages), URL_RULES)


def op12_dialogue_repair(spark: SparkSession, folder: str) -> DataFrame:
    return dialogue_repair.repair(load(spark, folder, "conversations"), harm=True)


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(load(spark, folder, "embeddings"), F.col("id") % 50 == 0, label=moved)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_secret_scan, op2_exact_topk, op3_vector_dedup, op4_packing, op5_minhash_dedup, op6_language_id, op7_lattice_lm, op8_token_frames, op9_source_mix,
                                    op10_toxicity, op11_url_filter, op12_dialogue_repair, op13_hard_negatives)}


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_topk": topk.SQL, "op3_vector_dedup": vector_dedup.SQL, "op5_minhash_dedup": sketch_dedup.SQL, "op9_source_mix": mixing.SQL,
            "op11_url_filter": url_filter.SQL, "op12_dialogue_repair": dialogue_repair.SQL, "op13_hard_negatives": hard_negatives.SQL}
