"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, jaccard, language, mixing, pii, quality, sharding, tokens, warc
from .sql import ORACLES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.ngram_jaccard(_table(spark, sf_dir, "documents")).drop("text_hash")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, _table(spark, sf_dir, "pages"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(_table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("text_hash")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(spark, _table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    rows = sharding.assign(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.reply_ordered(_table(spark, sf_dir, "conversations"))


def chat_quoting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chat operator where there is something to link: each message quotes an earlier one."""
    return chat.reply_ordered(chat.quoting(_table(spark, sf_dir, "conversations"))).drop("role")


def chat_assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same conversations put together, in pieces of at most 64 messages."""
    return chat.assembled(chat.reply_ordered(chat.quoting(_table(spark, sf_dir, "conversations"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_ngram_jaccard, op2_warc, op3_personal_data, op4_decontaminate, op5_quality_rules, op6_language, op7_token_counts, op8_mixing, op9_sharding, op10_chat, chat_quoting, chat_assembled]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
