"""The queries opN_* over the tables of a folder, with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, oracles
from .collocations import mine_collocations
from .context_mixing import score_texts
from .decontamination import find_contamination
from .embedding_duplicates import linked_vectors
from .language_id import identify
from .near_duplicates import near_duplicates
from .packing import pack_documents
from .quality import fit_quality, score_quality
from .ranked_search import rank_documents
from .sharding import shard_documents
from .suffix_dedup import remove_repeats
from .token_counts import count_tokens
from .toxicity import score_toxicity


def _as_doc(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("id", "doc_id")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return _as_doc(pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (common.table(spark, sf_dir, t) for t in ("documents", "labels"))
    out = score_toxicity(docs, labels, common.fold("doc_id", 4) != 2, cut=0.3)
    return out.select(F.col("id").alias("doc_id"), (common.fold("id", 4) == 2).alias("held_out"), "score", "predicted", "flagged")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return remove_repeats(docs, window=200).select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return _as_doc(count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), limit=512))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    out = shard_documents(docs, shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (common.table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    out = find_contamination(docs, items, n=10)
    return out.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    out = identify(docs, common.fold("id", 4) != 2, public_tokenizers.path("byte_bpe_50k.tiktoken"), bound=1000)
    return out.select(F.col("id").alias("doc_id"), (common.fold("id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return _as_doc(near_duplicates(docs, k=5, least=0.8))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (common.table(spark, sf_dir, t) for t in ("documents", "labels"))
    model = fit_quality(docs, labels, common.fold("doc_id", 5) != 0)
    out = score_quality(docs, model, cut=0.3)
    return out.select(F.col("id").alias("doc_id"), (common.fold("id", 5) == 0).alias("held_out"), "score", "predicted")


def op10_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings")
    return linked_vectors(vectors, least=0.93).withColumnRenamed("id", "vec_id")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (common.table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return rank_documents(docs, items, k=10).select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_collocations(common.table(spark, sf_dir, "documents"), least=10, longest=3, top=2000, share=50)


def op13_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_doc(score_texts(common.table(spark, sf_dir, "documents"), common.fold("doc_id", 7) != 2))


def queries() -> dict:
    return {f.__name__: f for f in (op1_packing, op2_toxicity, op3_suffix_dedup, op4_token_counts, op5_sharding, op6_decontamination, op7_language_id, op8_minhash, op9_quality, op10_embedding_links, op11_ranked_search, op12_collocations, op13_context_mixing)}


def oracle_sql() -> dict[str, str]:
    """The other queries train models, count tokens, pack or sort suffixes; their tests compare them with brute force or held-out labels."""
    return {"op5_sharding": oracles.SHARDING, "op6_decontamination": oracles.DECONTAMINATION, "op8_minhash": oracles.NEAR_DUPLICATES, "op10_embedding_links": oracles.EMBEDDING_LINKS, "op11_ranked_search": oracles.RANKED_SEARCH, "op12_collocations": oracles.COLLOCATIONS}
