"""A corpus from raw documents to packed sequences: five stages, each a table of its own."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usage_ts.llm import language_id, packing, quality_gam, shingle_links, substring_dedup
from usage_ts.llm.common import settle

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality model accepts; it learns from what is left of the labelled ones."""
    model = quality_gam.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_gam.accepted(docs, model).select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; texts without letters or mostly outside all languages go."""
    return language_id.accepted(docs, language_id.learn(docs)).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id, then hash of the text.

    A row without id stays, once, when its group has no row with an id.
    """
    rows = settle(shingle_links.near_copies(docs), "near")
    first = rows.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "hash")).alias("f"))
    first = settle(first.select(F.col("f.doc_id").alias("id"), "f.hash"), "kept")
    hashed = docs.select(*COLUMNS).withColumn("hash", F.xxhash64("text"))
    same = (hashed["hash"] == first["hash"]) & hashed["doc_id"].cast("long").eqNullSafe(first["id"])
    return hashed.join(first, same, "left_semi").dropDuplicates(["doc_id", "hash"]).select(*COLUMNS)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the long passages that an earlier one has."""
    return substring_dedup.cut_texts(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed token sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality),
    ("language", language),
    ("near_copies", near_copies),
    ("passages", passages),
    ("pack", pack),
]
#: The learned stages and the tokens have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
