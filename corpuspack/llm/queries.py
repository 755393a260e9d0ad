"""The registered queries of the training-data operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bond, embed_dedup, line_templates, mixing, vptree
from .bond import hard_negatives
from .common import held_out, scratch_path
from .embed_dedup import near_vectors
from .hilbert import shard_by_hilbert
from .imatch import edit_robustness
from .langid import identify
from .langid import train as train_langid
from .line_templates import drop_recurring_lines
from .mixing import mix_sources
from .resampling import resample
from .sentencepieces import encode_documents
from .simhash import simhash_groups
from .token_files import file_digests, write_tokens
from .toxicity import score_toxicity
from .toxicity import train as train_toxicity
from .vptree import nearest

PIECE_MODEL, BYTE_BPE = "piece_bpe_32k.model", "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every text, decodes the ids and compares; the ids are given by their crc32."""
    docs = table(spark, sf_dir, "documents")
    return encode_documents(docs, public_tokenizers.path(PIECE_MODEL), add=("n_tokens", "repaired", "round_trip", "ids_crc32"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), weights=(5, 2, 1), max_repeat=3)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = held_out(F.col("doc_id"), 4, 2)
    model = train_langid(docs, ~out)
    return identify(docs.select("doc_id", "text"), model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"), shingle=3)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_recurring_lines(table(spark, sf_dir, "documents"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"), k=10, factor=1.0)


def op8_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_hilbert(table(spark, sf_dir, "documents"), shards=8)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path(BYTE_BPE), end_id=2)
    return file_digests(spark, path)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = held_out(F.col("doc_id"), 5, 0)
    model = train_toxicity(docs, table(spark, sf_dir, "labels"), ~out)
    return score_toxicity(docs, model).select("doc_id", out.alias("held_out"), "score", "predicted")


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_robustness(table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seventh of the labels is moved on by one, so that labels and vectors don't simply agree."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding")
    return hard_negatives(vectors, vectors.where("vec_id % 100 = 0"))


QUERIES = (
    op1_embedding_near_dedup, op2_sentencepiece, op3_source_mixing, op4_language_id, op5_simhash_near_dedup,
    op6_line_dedup, op7_nearest_neighbours, op8_hilbert_sharding, op9_token_files, op10_toxicity,
    op11_document_fingerprints, op12_importance_resampling, op13_hard_negatives,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    """SQL where it can express the operator; the others are tested against brute force."""
    return {
        "op1_embedding_near_dedup": embed_dedup.ORACLE_SQL,
        "op3_source_mixing": mixing.ORACLE_SQL,
        "op6_line_dedup": line_templates.ORACLE_SQL,
        "op7_nearest_neighbours": vptree.ORACLE_SQL,
        "op13_hard_negatives": bond.ORACLE_SQL,
    }
