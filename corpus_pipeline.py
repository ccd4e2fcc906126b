"""From raw documents to packed training sequences, in five stages over whole tables.

run(spark, sf_dir) applies STAGES to the documents table, each to all that the one before
kept. Each stage but the last returns the columns of documents; texts that a stage edits
have their n_chars counted anew. Documents whose text was removed as a whole stay, as empty
ones. Nulls, repeated rows and empty tables are handled as each operator says.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigauge.llm import common
from lexigauge.llm.decontamination import find_contamination
from lexigauge.llm.near_duplicates import near_duplicates
from lexigauge.llm.packing import pack_documents
from lexigauge.llm.quality import fit_quality, keep_quality
from lexigauge.llm.suffix_dedup import remove_repeats

REST = ("lang", "source")
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. Each row is judged by its own text, a null one as empty; repeated rows fare alike. Without labels nothing is rejected."""
    docs = docs.select(*COLUMNS)
    model = fit_quality(docs, common.table(spark, sf_dir, "labels"), common.fold("doc_id", 5) != 0)
    return keep_quality(docs, model, cut=0.3)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the smallest id. Rows with one id and text count once; null texts are alike with nothing and all stay; rows with a null id stay if one of them does."""
    docs = docs.select(*COLUMNS)
    near = common.cut(near_duplicates(docs))
    kept = common.cut(near.where("kept").select(F.col("id").alias("kept_id")).distinct())
    out = docs.join(common.broadcast_if_small(kept), docs.doc_id.eqNullSafe(kept.kept_id), "left_semi")
    twice = common.cut(near.groupBy(F.col("id").alias("twice_id")).count().where("count > 1").select("twice_id"))
    if not twice.limit(1).count():
        return out
    # rows with one id: a shuffle of their texts alone
    same, ids = docs.doc_id.eqNullSafe(twice.twice_id), common.broadcast_if_small(twice)
    return out.join(ids, same, "left_anti").unionByName(out.join(ids, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 200 bytes that occur twice or more; parts of characters at the cuts go too. Null texts stay null; repeated rows are repeats of each other, and lose what they share."""
    out = remove_repeats(docs, window=200, carry=REST, as_text=True)
    return _documents(out, F.col("kept"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that lie in a window of 10 words of a benchmark item. Every row stays, with a null text too; repeated rows are cut alike."""
    out = find_contamination(docs, common.table(spark, sf_dir, "benchmark"), n=10, carry=REST)
    return _documents(out, F.col("kept_text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their token ids, placed in sequences of 2048. A null text is packed as an empty one, repeated rows each."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), window=2048).withColumnRenamed("id", "doc_id")


def _documents(out: DataFrame, text) -> DataFrame:
    return out.select(F.col("id").alias("doc_id"), text.alias("text"), *REST).select("doc_id", "text", *REST, F.length("text").cast("long").alias("n_chars"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontaminate", decontaminate),
    ("pack", pack),
]

#: Trained models, sketches and tokens have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed pieces of the documents of a folder. What a stage returns is kept in the checkpoint folder for the next."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.cut(docs)
    return docs
