"""Registered queries of the package: ``opN_<name>`` over whole tables, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import conversations, embedding_dedup, exact_dedup, html_text, language, line_dedup, minhash, mixing, packing, phrases, quality, secrets, toxicity
from quarry.llm.common import read_table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op1_packing(read_table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.op2_line_dedup(read_table(spark, sf_dir, "documents"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.op3_html(read_table(spark, sf_dir, "pages"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.op4_embedding_dedup(read_table(spark, sf_dir, "embeddings"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op5_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op6_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.op7_minhash(read_table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op8_mixing(read_table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.op9_exact_dedup(read_table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.op10_secrets(read_table(spark, sf_dir, "documents"))


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.op11_language(read_table(spark, sf_dir, "documents"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.op12_conversations(read_table(spark, sf_dir, "conversations"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.op13_phrases(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_packing, op2_line_dedup, op3_html, op4_embedding_dedup, op5_toxicity, op6_quality,
                              op7_minhash, op8_mixing, op9_exact_dedup, op10_secrets, op11_language, op12_conversations, op13_phrases)}

SQL: dict[str, str] = {"op4_embedding_dedup": embedding_dedup.OP4_SQL, "op7_minhash": minhash.OP7_SQL,
                       "op9_exact_dedup": exact_dedup.OP9_SQL, "op10_secrets": secrets.op10_sql(),
                       "op12_conversations": conversations.OP12_SQL, "op13_phrases": phrases.op13_sql()}
