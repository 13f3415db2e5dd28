"""Point lookups over the aggregates, and their JSON form."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def not_blank(key: str) -> str:
    """The key, which must not be blank."""
    if not key or not key.strip():
        raise ValueError("a key must not be blank")
    return key


def of_key(rows: DataFrame, key: str) -> DataFrame:
    """The rows of one key: of a record table, or of an event log about to be folded.

    An absent key gives no rows. The filter on the grouping key passes through windows and
    aggregations, so folding a filtered log or filtering a folded one reads the same.
    """
    return rows.where(F.col("key") == not_blank(key))


def keys(events: DataFrame, kinds: list[str]) -> DataFrame:
    """The keys that have a record, from the event log alone."""
    return (
        events.where(F.col("kind").isin(kinds) & F.col("key").isNotNull()).select("key").distinct()
    )


def as_json(records: DataFrame, record_type: str | None = None) -> DataFrame:
    """``key, page, json``, null fields included; ``record_type`` adds a ``type`` field."""
    fields = [name for name in records.columns if name not in ("key", "page", "paymentCount")]
    if record_type:
        records = records.withColumn("type", F.lit(record_type))
        fields = ["type", *fields]
    body = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return records.select("key", "page", body.alias("json"))
