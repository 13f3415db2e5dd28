"""Event counts per derived key: final table and changelog."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventfold.functions.keys import count_key
from eventfold.functions.ordered import HOT_ROWS, RUN_BITS, number, run_of
from eventfold.schemas import INPUT_KINDS


def countable(events: DataFrame) -> DataFrame:
    """The events that are counted; null values have no kind and fall out."""
    return events.where(F.col("kind").isin(INPUT_KINDS))


def event_counts(events: DataFrame) -> DataFrame:
    """``count_key, n``: partial counts before the shuffle, so a hot key costs one row per task."""
    return (
        countable(events).groupBy(count_key().alias("count_key")).agg(F.count(F.lit(1)).alias("n"))
    )


def event_count_changelog(
    events: DataFrame, hot_rows: int = HOT_ROWS, run_bits: int = RUN_BITS
) -> DataFrame:
    """``count_key, seq, n``: the count after each event.

    Events of several keys may share a count key; they are taken in the order of
    (seq, kind, key). Chaser ``seq`` values are unique in the log, so a run is bounded.
    """
    rows = countable(events).select(
        count_key().alias("count_key"), "seq", "kind", "key", run_of("seq", run_bits).alias("run")
    )
    order = [F.col("seq"), F.col("kind"), F.col("key")]
    numbered = number(rows, "count_key", ["run"], order, "n", hot_rows=hot_rows)
    return numbered.select("count_key", "seq", "n")
