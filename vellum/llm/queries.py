"""Queries of the training-data operators, with production parameters and over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bagminhash, bpe, chat, decontam, fmindex, langid, ngramlm, repetition, seekable, toxicity
from .common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_chat_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_preferences(chat.pairs_of(read(spark, sf_dir, "conversations")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.annotate(read(spark, sf_dir, "documents")).filter("keep")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.detect(read(spark, sf_dir, "documents"))


def op5_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.duplicates(read(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(read(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_fm_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fmindex.repeats(read(spark, sf_dir, "documents"))


def op9_unbounded_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document whose id is divisible by 50, under all the others."""
    return ngramlm.scores(read(spark, sf_dir, "documents"))


def op10_seekable_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seekable.write_shared(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_chat_preferences, op2_toxicity, op3_repetition, op4_language_id, op5_bagminhash, op6_byte_bpe, op7_decontamination, op8_fm_substring, op9_unbounded_lm, op10_seekable_tokens)}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_preferences": chat.SQL, "op3_repetition": repetition.sql(), "op8_fm_substring": fmindex.sql()}
