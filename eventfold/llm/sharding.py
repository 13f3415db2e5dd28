"""Shuffled shards by a Feistel permutation of global row numbers.

Every row gets a global number; a keyed permutation of ``[0, rows)`` moves it to its place in
the shuffle. Shard and slot are that place's remainder and quotient by the number of shards, so
both can be computed from the row number alone, shard sizes differ by one row at most, and the
same table and key give the same shuffle whatever the cluster or partitioning.

The permutation is an unbalanced Feistel network over ``a * b >= rows`` values, with ``a * b -
rows < a``; what falls beyond ``rows`` is permuted again until it does not (cycle walking).

Rows are numbered without a global sort: they are counted per distinct row first, then
numbered within hash buckets, whose offsets are a table of ``BUCKETS`` rows.

Defined results: a null text has 8 bytes of size and checksum 0; a null id is an id like any
other; repeated rows get a slot each; an empty table gives none; further columns are ignored.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventfold.llm.common import whole

BUCKETS = 4_096
ROUNDS = 6
ROW_OVERHEAD = 8


def _mixed(values: np.ndarray, key: int) -> np.ndarray:
    """Well mixed 64 bits of each value, for one round key."""
    x = values + np.uint64((key * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def permuted(numbers: np.ndarray, rows: int, key: int) -> np.ndarray:
    """Places of row numbers in a shuffle of ``rows`` rows: a bijection of ``[0, rows)``."""
    a = max(1, math.isqrt(max(rows - 1, 0)) + 1)
    b = max(1, -(-rows // a))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x // np.uint64(b), x % np.uint64(b)
        for i in range(ROUNDS):
            step = key * ROUNDS + i + 1
            if i % 2:
                right = (right + _mixed(left, step) % np.uint64(b)) % np.uint64(b)
            else:
                left = (left + _mixed(right, step) % np.uint64(a)) % np.uint64(a)
        return left * np.uint64(b) + right

    with np.errstate(over="ignore"):
        places = once(np.asarray(numbers).astype(np.uint64))
        while (beyond := places >= np.uint64(rows)).any():
            places[beyond] = once(places[beyond])
    return places.astype(np.int64)


def place(number: Column, rows: int, key: int) -> Column:
    """The permutation as a column."""

    @F.pandas_udf("long")
    def of(numbers: pd.Series) -> pd.Series:
        return pd.Series(permuted(numbers.to_numpy(), rows, key))

    return of(number)


def numbered(df: DataFrame, columns: list[str]) -> DataFrame:
    """The rows' ``columns`` and a gapless ``number`` from 0, equal for equal tables."""
    bucket = F.pmod(F.xxhash64(*columns), F.lit(BUCKETS)).cast("int")
    groups = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("copies"))
    groups = groups.withColumn("bucket", bucket)
    totals = groups.groupBy("bucket").agg(F.sum("copies").alias("total"))
    before = F.sum("total").over(Window.orderBy("bucket")) - F.col("total")
    offsets = F.broadcast(totals.select("bucket", before.alias("offset")))  # BUCKETS rows
    within = F.sum("copies").over(Window.partitionBy("bucket").orderBy(*columns))
    first = groups.withColumn("within", within - F.col("copies")).join(offsets, "bucket")
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))
    return first.withColumn("copy", copy).select(
        *columns, (F.col("offset") + F.col("within") + F.col("copy")).alias("number")
    )


def sharded(docs: DataFrame, shards: int, key: int = 0) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for each row of ``docs``.

    The law is ``rows``; ``grown_shard`` is null, since a shuffle for one more shard moves rows.
    """
    plain = docs.select(
        "doc_id",
        (F.octet_length(whole()) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(whole().cast("binary")).alias("text_crc32"),
    )
    rows = docs.count()
    at = numbered(plain, plain.columns).withColumn("place", place(F.col("number"), rows, key))
    return at.select(
        *plain.columns,
        F.lit("rows").alias("law"),
        F.pmod("place", F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("place") / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "number",
    )
