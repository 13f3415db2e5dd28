"""Helpers shared by the operators: reading tables, row keys, shared tables."""

import contextlib
import ctypes
import gc
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventfold.session import scratch

NO_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Rows reach Python a few megabytes at a time.

    A batch is held several times over, in the JVM, in Arrow and as Python values, by every
    worker of an executor; operators that carry whole rows hold those as well.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1_000)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)


def give_back() -> None:
    """Return the memory a task no longer uses: its worker stays, idle, beside those of other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def whole(text: str | Column = "text") -> Column:
    """The text, empty if there is none."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Two columns equal for rows that repeat each other, and never null: ``kid``, ``kth``."""
    return [
        F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("kid"),
        F.xxhash64(F.col(text).isNull(), whole(text)).alias("kth"),
    ]


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used, also in lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def kept_table(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back: cuts lineage, outlives executors."""
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_batch(
    df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str
) -> DataFrame:
    """A function of Arrow batches, each on its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := function(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def bounded_sample(df: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` rows drawn one by one, so that hot keys cannot swell it; or all."""
    return df.sample(fraction=min(1.0, rows / max(1, df.count())), seed=11)


def added_tokens(tokenizer_json: str) -> list[str]:
    """Texts that the tokenizer's file maps to one token wherever they stand."""
    with open(tokenizer_json, encoding="utf-8") as file:
        added = json.load(file)["added_tokens"]
    if any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in added):
        raise ValueError("added tokens that match beyond their own text are not supported")
    return [x["content"] for x in added]
