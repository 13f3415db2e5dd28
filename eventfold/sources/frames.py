"""Framed records: one zero byte, a four-byte schema id, an Avro body.

Header checks are column expressions; bodies are written and read by one Arrow pass
(``avro_body``). Frames that cannot be read are kept with a ``reject_reason`` and have no
``kind``, so that nothing folds them.
"""

import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventfold.schemas import COLUMN_OF, FRAME, TYPE_OF
from eventfold.sources.avro_body import body_reader, body_writer

MAGIC_HEX = "00"
HEADER_BYTES = 5
BROADCAST_SCHEMAS = 10_000


def encode_frames(events: DataFrame, ids: dict[str, int]) -> DataFrame:
    """``key, seq, value`` for events with one struct column per kind; no kind, no value."""
    kinds = [kind for kind in ids if COLUMN_OF[kind] in events.columns]
    headers = {kind: bytes.fromhex(MAGIC_HEX) + struct.pack(">i", ids[kind]) for kind in kinds}
    rows = events.select(
        "key", F.col("seq").cast("long").alias("seq"), "kind", *[COLUMN_OF[kind] for kind in kinds]
    )
    return rows.mapInArrow(body_writer(headers), FRAME)


def _schema_id(value: Column) -> Column:
    """Big-endian signed 32-bit id from bytes 2 to 5."""
    unsigned = F.conv(F.hex(F.substring(value, 2, 4)), 16, 10).cast("long")
    return F.when(unsigned >= 2**31, unsigned - 2**32).otherwise(unsigned).cast("int")


def read_headers(frames: DataFrame, catalog: DataFrame) -> DataFrame:
    """Add ``kind`` and ``reject_reason`` to frames, checks in the order of the reasons.

    The catalog has one row per record type, and is broadcast unless it is larger than any
    number of types would make it.
    """
    size = F.octet_length("value")
    has_header = size > HEADER_BYTES
    magic = F.hex(F.substring("value", 1, 1)) == MAGIC_HEX
    schema_id = F.when(has_header & magic, _schema_id(F.col("value")))
    known = catalog.select("schema_id", "kind")
    if known.limit(BROADCAST_SCHEMAS + 1).count() <= BROADCAST_SCHEMAS:
        known = F.broadcast(known)
    return (
        frames.withColumn("schema_id", schema_id)
        .join(known, "schema_id", "left")
        .withColumn(
            "reject_reason",
            F.when(F.col("value").isNull(), "null_value")
            .when(~has_header, "too_short")
            .when(~magic, "bad_magic")
            .when(F.col("kind").isNull(), "unknown_schema"),
        )
    )


def decode_frames(
    frames: DataFrame, catalog: DataFrame, kinds: list[str] | None = None
) -> DataFrame:
    """Events with ``reject_reason``, null where the frame was read.

    A frame that was not read has its kind, as far as that is known, in ``rejected_kind``. A
    record type outside ``kinds`` (default: all of the catalog given to the reader) is read, but
    keeps its kind only: no fold takes it.
    """
    kinds = list(TYPE_OF) if kinds is None else kinds
    out = T.StructType(
        [
            T.StructField("key", T.StringType()),
            T.StructField("seq", T.LongType()),
            T.StructField("kind", T.StringType()),
            *[T.StructField(COLUMN_OF[kind], TYPE_OF[kind]) for kind in kinds],
            T.StructField("reject_reason", T.StringType()),
        ]
    )
    headed = read_headers(frames, catalog).select(
        "key", F.col("seq").cast("long").alias("seq"), "kind", "value", "reject_reason"
    )
    decoded = headed.mapInArrow(body_reader(kinds, HEADER_BYTES), out)
    read = F.col("reject_reason").isNull()
    return decoded.withColumns(
        {"kind": F.when(read, F.col("kind")), "rejected_kind": F.when(~read, F.col("kind"))}
    )


def good(decoded: DataFrame) -> DataFrame:
    """The events that were read."""
    return decoded.where("reject_reason IS NULL").drop("reject_reason", "rejected_kind")


def rejects(decoded: DataFrame) -> DataFrame:
    """``key, seq, rejected_kind, reject_reason`` of the others, for a sink of their own."""
    refused = decoded.where("reject_reason IS NOT NULL")
    return refused.select("key", "seq", "rejected_kind", "reject_reason")
