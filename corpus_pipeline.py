"""A cleaning pipeline over ``documents``: a stage's result is written as Parquet and read as the next one's input.

Each stage is a function of (spark, documents, folder of the tables) and keeps the documents' columns, whatever their number and
names, but for the last. Rows without a text have nothing to repeat, share or leak: the first four stages pass them on, the
last gives them null tokens. Rows without an id can't be named as a copy of another, and stay unless their own text is bad.
Texts are read whole, however long. Empty tables give empty results, of the same columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import bagminhash, bpe, decontam, fmindex, repetition
from vellum.llm.common import read, saved

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that mostly repeat themselves go.

    Null and empty texts stay; repeated rows are judged each for itself; a measure that is equal to its limit stays.
    """
    return repetition.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id stays.

    Rows without words or without an id stay, all of them; of rows that share an id the one with the least text stays.
    """
    return bagminhash.deduplicate(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more are left at their first place only; n_chars follows the text.

    The first place is that of the least id, then the least offset; of equal rows of one id each loses the same. Texts of which
    no word is left go; null and empty texts and rows without an id stay as they are.
    """
    kept = fmindex.remove(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item, within its edit budget, go.

    Null and empty texts and items match nothing; a row without an id goes like any other; a distance equal to the budget counts.
    """
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's tokens, and whether they decode to its text.

    A null text has null tokens, an empty one none; repeated rows and rows without an id have rows of their own.
    """
    return bpe.encode(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]
#: Byte-level BPE and the edit distances have no SQL equivalent.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), spark)
    return docs
