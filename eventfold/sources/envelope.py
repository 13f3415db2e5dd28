"""JSON envelopes: an object with one field, named by the record's full name."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventfold.schemas import COLUMN_OF, INPUT_KINDS, NULLABLE, TYPE_OF, full_name


def read_envelopes(lines: DataFrame, namespace: str = "events") -> DataFrame:
    """Events from ``key, seq, json``, with ``reject_reason``, null where the line was read.

    A line that was not read has no kind and no record, as a frame that was not: it is null
    (``null_value``), no JSON object (``bad_json``), names no record type (``unknown_schema``),
    or lacks a required field (``missing_field``).
    """
    envelope = T.StructType(
        [T.StructField(full_name(kind, namespace), TYPE_OF[kind]) for kind in INPUT_KINDS]
    )
    parsed = lines.withColumn("envelope", F.from_json("json", envelope))
    kind = None
    for name in INPUT_KINDS:
        present = F.col("envelope").getField(full_name(name, namespace)).isNotNull()
        kind = F.when(present, name) if kind is None else kind.when(present, name)
    complete = F.lit(True)
    for name in INPUT_KINDS:
        record = F.col("envelope").getField(full_name(name, namespace))
        for field in TYPE_OF[name].names:
            if field not in NULLABLE.get(name, ()):
                complete = complete & (record.isNull() | record.getField(field).isNotNull())
    reason = (
        F.when(F.col("json").isNull(), "null_value")
        .when(F.json_object_keys("json").isNull(), "bad_json")
        .when(kind.isNull(), "unknown_schema")
        .when(~complete, "missing_field")
    )
    judged = parsed.select("key", "seq", "envelope", kind.alias("kind"), reason.alias("reject_reason"))
    read = F.col("reject_reason").isNull()
    return judged.select(
        "key",
        "seq",
        F.when(read, F.col("kind")).alias("kind"),
        *[
            F.when(read, F.col("envelope").getField(full_name(name, namespace))).alias(COLUMN_OF[name])
            for name in INPUT_KINDS
        ],
        "reject_reason",
    )


def write_envelopes(events: DataFrame, namespace: str = "events") -> DataFrame:
    """``key, seq, json`` from events; an event without a kind has no line."""
    fields = [
        F.when(F.col("kind") == name, F.col(COLUMN_OF[name])).alias(full_name(name, namespace))
        for name in INPUT_KINDS
    ]
    return events.where("kind IS NOT NULL").select(
        "key", "seq", F.to_json(F.struct(*fields)).alias("json")
    )
