"""The corpus pipeline: five stages over ``documents``, each one operator of ``corpuspack.llm``.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; :func:`run` writes
it as Parquet in the shared folder and reads it again as the next stage's ``docs``.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuspack.llm.common import held_out, scratch_path
from corpuspack.llm.langid import UNDETERMINED, identify, train
from corpuspack.llm.line_templates import drop_recurring_passages
from corpuspack.llm.mixing import mixed_documents
from corpuspack.llm.sentencepieces import encode_documents
from corpuspack.llm.simhash import first_of_groups

#: Documents whose language is less sure than this are rejected.
LEAST_SCORE = 0.4
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
PIECE_MODEL = "piece_bpe_32k.model"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents of a determined language; ``lang`` is filled in where it was null.

    Null and empty texts, and texts without a letter, are rejected.  Rows without an id, and rows that
    repeat, are judged like any other.  Without any text whose language is known all are rejected.
    """
    model = train(docs.select("doc_id", "text", "lang"), ~held_out(F.col("doc_id"), 4, 2))
    said = identify(docs.select(*COLUMNS), model)
    known = said.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return known.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines, and sentences of long lines, that recur in two documents out of the texts; ``n_chars`` follows the text.

    All rows stay.  The document with the smallest id keeps what recurs; rows that repeat an id are one
    document, and so are those without one, which come last.  A null text stays null, with null ``n_chars``.
    """
    out = drop_recurring_passages(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest ``doc_id``, null ids last.

    Near are texts of which five-word shingles agree to 0.8 or more.  Rows that repeat an id, or have none, are
    judged by their texts alone; null and empty texts are one group.
    """
    return first_of_groups(docs.select(*COLUMNS), shingle=5, similarity=0.8)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that the sources come in their target shares.

    Documents of no words take no part of a share and may go; a null source is a source of its own; rows
    that repeat are taken one after the other.
    """
    return mixed_documents(docs.select(*COLUMNS), weights=(5, 2, 1), max_repeat=3)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, and whether decoding them gives the text again; a null text is encoded as an empty one."""
    path = public_tokenizers.path(PIECE_MODEL)
    return encode_documents(docs, path, keep=("doc_id", "source"), add=("n_tokens", "ids", "repaired", "round_trip"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("sentencepiece", sentencepiece),
]

#: SQL can't express the language model, the fingerprints and the tokeniser; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents`` one after the other."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
