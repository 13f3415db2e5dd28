"""The registered queries of this package: each operator over its whole table."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventfold.llm import bpe, chat, decontamination, pii
from eventfold.llm.common import small_batches, table
from eventfold.llm.extraction import main_texts
from eventfold.llm.fingerprints import fingerprints
from eventfold.llm.jaccard import linked
from eventfold.llm.language import language_ids
from eventfold.llm.sharding import sharded
from eventfold.llm.suffixes import text_of, without_repeats
from eventfold.llm.token_counts import token_counts
from eventfold.llm.vector_codes import code_rows
from eventfold.llm.whitening import whitening_rows
from eventfold.session import prepare

SHARDS = 24


def _op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts(
        table(prepare(spark), sf_dir, "documents"), path, public_tokenizers.PATTERN, 1024
    )


def _op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_ids(table(prepare(spark), sf_dir, "documents"))


def _op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    small_batches(spark)
    docs = table(prepare(spark), sf_dir, "documents")
    return bpe.encoded(docs, path, public_tokenizers.PATTERN).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def _op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.flat(chat.dialogues(table(prepare(spark), sf_dir, "conversations")))


def _op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(prepare(spark), sf_dir, "pages"))


def _op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (table(prepare(spark), sf_dir, t) for t in ("documents", "benchmark"))
    return decontamination.contamination(docs, items).drop("kth")


def _op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(prepare(spark), sf_dir, "documents"), SHARDS).drop("number")


def _op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    return linked(docs, words=4, percent=85).drop("kid", "kth", "label")


def _op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(prepare(spark), sf_dir, "documents"))


def _op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["e"] - s["b"])
    return without_repeats(docs, length=400).select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        text_of().alias("text"),
    )


def _op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.personal_data(table(prepare(spark), sf_dir, "documents")))


def _op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_rows(table(prepare(spark), sf_dir, "embeddings"))


def _op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening_rows(table(prepare(spark), sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": _op1,
        "op2_language_id": _op2,
        "op3_byte_bpe": _op3,
        "op4_chat_perspectives": _op4,
        "op5_main_text": _op5,
        "op6_decontamination": _op6,
        "op7_sharding": _op7,
        "op8_jaccard_join": _op8,
        "op9_fingerprints": _op9,
        "op10_suffix_dedup": _op10,
        "op11_personal_data": _op11,
        "op12_vector_codes": _op12,
        "op13_whitening": _op13,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_chat_perspectives": chat.ORACLE, "op6_decontamination": decontamination.ORACLE}
