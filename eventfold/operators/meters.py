"""What was processed, as one row."""

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from eventfold.schemas import BILLING_KINDS


def _counts() -> list[Column]:
    keyed = F.col("key").isNotNull()
    chaser = keyed & (F.col("kind") == "Chaser")
    billing = keyed & F.col("kind").isin(BILLING_KINDS)
    last_ttl = F.max_by("chaser.ttl", F.when(chaser, F.col("seq")))
    return [
        F.count_if(chaser).alias("chaser_received"),
        F.coalesce(last_ttl, F.lit(0).cast("long")).alias("chaser_ttl_value"),
        F.count_if(billing).alias("billing_aggregation"),
    ]


def processing_meters(events: DataFrame) -> DataFrame:
    """Chasers folded, ttl of the last chaser, billing events folded, keys with a bill.

    Chaser ``seq`` values order the whole log here, not just one key.
    """
    billed = F.when(F.col("kind") == "Bill", F.col("key"))
    return events.agg(*_counts(), F.count_distinct(billed).alias("billing_customer_bills"))


def observed(events: DataFrame, meters: Observation | str) -> DataFrame:
    """The same events, metering what passes through.

    With a name, a streaming query reports the meters of each micro-batch in its
    progress. Keys with a bill need a distinct count, which observation does not offer.
    """
    return events.observe(meters, *_counts())
