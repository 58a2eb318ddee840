"""From raw documents to packed sequences: language, near-duplicates, secrets, source mix, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. Extra columns pass through; all
stages but the last return the columns they were given.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import langid, mixing, packing, secret_scan, sketch_dedup
from tidemark.llm.batches import load, only
from tidemark.plans.checkpoints import stable

LEAST_KNOWN = 0.75  # of a text's letter groups, those that the language model has met
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model has learned: not ``und``, and made of letter groups that it has met in some language.

    So texts in two or three known languages stay, those in an unlearned one and random letters go, however many languages there are.
    """
    return langid.keep(docs, langid.learn(docs), LEAST_KNOWN)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id. Rows that repeat id and text become one.

    Where an id bears several texts each is judged by its own shingles, so one without a copy stays; rows without an id all stay.
    """
    found = stable(sketch_dedup.near_duplicates(docs, width=SHINGLE_WORDS, percent=SIMILAR_PERCENT, with_set=True))
    gone = found.filter(~F.col("kept"))
    again = stable(found.groupBy("doc_id").count().filter("count > 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_again")))
    once = docs.join(again, docs["doc_id"] == again["_again"], "left_anti").join(gone.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
    each = docs.join(again, docs["doc_id"] == again["_again"], "left_semi").dropDuplicates(["doc_id", "text"]).withColumn("_key", F.struct("doc_id", F.xxhash64("text").alias("hash")))
    sets = sketch_dedup.sketches(only(each, doc_id="_key", text="text"), SHINGLE_WORDS).select(F.col("doc_id").alias("_key"), "f")
    copies = sets.join(gone.select("doc_id", "f"), (F.col("_key.doc_id") == gone["doc_id"]) & (sets["f"] == gone["f"])).select("_key").distinct()
    return once.unionByName(each.join(copies, "_key", "left_anti").select(*docs.columns))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with their secrets replaced by a mark, and ``n_chars`` brought up to date. Repeated rows are changed alike; a null text stays."""
    clean = secret_scan.redact(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words, to the nearest whole copy; documents of which it takes less than half go.

    Rows that share an id count as one document: all of them come as often as the mix takes their words together.
    """
    shares = mixing.mix(docs).groupBy(F.col("doc_id").alias("_id")).agg(F.sum("taken").alias("_taken"), F.sum("size").alias("_size"))
    copies = shares.select("_id", F.round(F.col("_taken") / F.greatest("_size", F.lit(1))).cast("int").alias("_copies")).filter("_copies > 0")
    taken = docs.join(copies, docs["doc_id"].eqNullSafe(copies["_id"]))
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 ids; see ``packing.pack``."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", keep_languages), ("near_duplicates", drop_near_duplicates), ("secrets", redact_secrets), ("mix", mix_sources), ("pack", pack_sequences)]

ORACLE_SQL = None  # the language model, the union sketches and the tokenizer have no SQL form; tests/llm holds a brute-force run


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
