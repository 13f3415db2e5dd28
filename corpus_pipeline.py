"""A corpus made ready for training, stage by stage.

Each stage takes the documents that the one before kept, and gives documents of the same columns;
the last gives them encoded. ``run`` writes what a stage gives to the shared folder and reads it
back, so a lost executor costs no more than the stage it was in.

No stage can be written in SQL that gives the same rows, as the first two are a trained model and
the components of a graph.
"""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventfold.llm import bpe, decontamination, jaccard, language, suffixes
from eventfold.llm.common import kept_table, row_key, small_batches, table
from eventfold.session import prepare

WORDS, PERCENT = 5, 80
# Passages of some forty words and more.
REPEATED_BYTES = 200
RANKS = "byte_bpe_multi_50k.tiktoken"


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those rejected go."""
    small_batches(spark)
    found = language.language_ids(docs, with_row=True)
    return found.where("NOT rejected").select("row.*")


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    small_batches(spark)
    return jaccard.one_of_each(docs, WORDS, PERCENT)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur again; one that was null stays null."""
    small_batches(spark)
    none = "_none"
    while none in docs.columns:
        none += "_"
    text = F.when(~F.col("row")[none], suffixes.text_of())
    marked = docs.withColumn(none, F.col("text").isNull())
    found = suffixes.without_repeats(marked, REPEATED_BYTES, with_row=True)
    cut = found.withColumn("_text", text)
    columns = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return cut.select(*(columns.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too little of any benchmark item to matter."""
    judged = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"))
    bad = judged.where("contaminated").select(row_key()[0], "kth").distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), *row_key())
    return rows.join(bad, ["kid", "kth"], "left_anti").select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded_sha256``; ids are little-endian 32-bit integers."""
    small_batches(spark)
    path = public_tokenizers.path(RANKS)
    found = bpe.encoded(docs, path, public_tokenizers.PATTERN)
    return found.select(
        "doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify),
    ("jaccard_join", deduplicate),
    ("suffix_dedup", cut_repeats),
    ("decontamination", decontaminate),
    ("byte_bpe", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept_table(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
