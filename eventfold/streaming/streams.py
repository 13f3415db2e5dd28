"""The three folds as continuous queries.

Counts and chasers are native stateful aggregations in update mode: Spark combines a
micro-batch per task before the shuffle and keeps one small state row per group. State
of a chaser key is spread over its names, and the record is put together on reading.

Billing depends on order, which a native aggregation does not see. Each micro-batch is
summarised with the batch operators, a fixed-size row per run and one row per new
payment, and the summaries are merged on reading, in order. No key's history, nor a
micro-batch's share of a hot key, ever has to fit in one task.

Inside a micro-batch rows may come in any order; they are taken by ``seq``. Micro-batches are
taken as they arrive, so an event that comes late is applied late, as in a topic.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from eventfold.functions.ordered import HOT_ROWS, PAGE_SIZE, RUN_BITS, hot_keys
from eventfold.operators.billing import (
    billing_events,
    billing_records,
    billing_runs,
    first_requests,
    merge_runs,
    number_requests,
)
from eventfold.operators.chaser import chaser_records, chasers, names_seen
from eventfold.operators.counts import event_counts
from eventfold.streaming.sinks import create, read_batches, start, write_batch

Publish = Callable[[DataFrame, int], None]


def stream_counts(
    events: DataFrame, table: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Keep the event counts; ``table`` receives the counts that changed."""
    counted = event_counts(events)
    create(events.sparkSession, table, counted)
    writer = counted.writeStream.outputMode("update")
    return start(writer.foreachBatch(lambda rows, i: write_batch(rows, table, i)), checkpoint, every)


def current_counts(spark: SparkSession, table: str) -> DataFrame:
    """``count_key, n`` as of the last micro-batch."""
    return _latest_counts(read_batches(spark, table))


def stream_chasers(
    events: DataFrame,
    table: str,
    checkpoint: str,
    every: str | None = None,
    publish: Publish | None = None,
) -> StreamingQuery:
    """Keep what was seen per (key, name); ``publish`` gets the records that changed."""

    def each(rows, i):
        write_batch(rows, table, i)
        if publish:
            spark = rows.sparkSession
            publish(current_chasers(spark, table, _touched(spark, table, i)), i)

    seen = names_seen(chasers(events))
    create(events.sparkSession, table, seen)
    writer = seen.writeStream.outputMode("update")
    return start(writer.foreachBatch(each), checkpoint, every)


def current_chasers(
    spark: SparkSession,
    table: str,
    only: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
    **limits,
) -> DataFrame:
    """The chaser records as of the last micro-batch."""
    rows = _of(read_batches(spark, table), only)
    # the rows of a key bound its names
    return chaser_records(_latest_names(rows), hot_keys(rows, "key", hot_rows), **limits)


def stream_billing(
    events: DataFrame,
    table: str,
    checkpoint: str,
    every: str | None = None,
    publish: Publish | None = None,
    run_bits: int = RUN_BITS,
) -> StreamingQuery:
    """Keep run summaries and first requests; ``publish`` gets the records that changed."""

    def each(rows, i):
        # ordinary keys meet once, for both tables; a hot one stays spread and is cut into runs
        if hot_keys(rows, "key", 2**run_bits) is None:
            rows = rows.repartition("key")
        rows = rows.persist()
        try:
            arrived = F.lit(i).cast("long")
            requests = first_requests(rows).withColumn("arrived", arrived)
            write_batch(requests, f"{table}/requests", i)
            write_batch(billing_runs(rows, run_bits), f"{table}/runs", i)
        finally:
            rows.unpersist()
        if publish:
            spark = rows.sparkSession
            publish(current_billing(spark, table, _touched(spark, f"{table}/runs", i)), i)

    rows = billing_events(events)
    requests = first_requests(rows).withColumn("arrived", F.lit(-1).cast("long"))
    create(events.sparkSession, f"{table}/requests", requests)
    create(events.sparkSession, f"{table}/runs", billing_runs(_still(rows), run_bits))
    writer = rows.writeStream
    return start(writer.foreachBatch(each), checkpoint, every)


def current_billing(
    spark: SparkSession,
    table: str,
    only: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
    run_bits: int = RUN_BITS,
    page_size: int = PAGE_SIZE,
) -> DataFrame:
    """The billing records as of the last micro-batch."""
    runs = _of(read_batches(spark, f"{table}/runs"), only)
    rows = _of(read_batches(spark, f"{table}/requests"), only)
    # the rows of a key bound its payments
    requests = number_requests(first_requests(rows), hot_keys(rows, "key", hot_rows), run_bits)
    return billing_records(runs, requests, page_size)


def stream_rejects(
    rejects: DataFrame, table: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Put what ``read_rejects`` gives aside, in a table of its own."""
    writer = rejects.writeStream.outputMode("append")
    return start(writer.foreachBatch(lambda rows, i: write_batch(rows, table, i)), checkpoint, every)


def compact_counts(spark: SparkSession, table: str, into: str) -> None:
    """Write what ``table`` comes to as a new table, to go on with after a restart.

    A table holds what every micro-batch changed. Compacting leaves a row per group, under
    the last batch number, and the stopped query restarts from its checkpoint with the new
    table; the old one stays as it is.
    """
    _compact(spark, table, into, _latest_counts)


def compact_chasers(spark: SparkSession, table: str, into: str) -> None:
    """As ``compact_counts``, leaving a row per (key, name)."""
    _compact(spark, table, into, _latest_names)


def compact_billing(spark: SparkSession, table: str, into: str) -> None:
    """As ``compact_counts``, leaving a row per key and one per payment."""
    _compact(spark, f"{table}/requests", f"{into}/requests", first_requests)
    _compact(spark, f"{table}/runs", f"{into}/runs", merge_runs)


def state_locations(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``key, partition_id``: where a running query keeps the state of each group."""
    state = spark.read.format("statestore").load(checkpoint)
    return state.select(F.col("key.*"), "partition_id").toDF("key", "partition_id")


def _still(rows):
    """An empty table of the stream's columns, for plans that a stream cannot have."""
    return rows.sparkSession.createDataFrame([], rows.schema)


def _latest_counts(rows):
    """Counts only grow."""
    return rows.groupBy("count_key").agg(F.max("n").alias("n"))


def _latest_names(rows):
    """Every column only grows."""
    latest = [F.max(name).alias(name) for name in ("n", "last_seq", "sent", "ttl")]
    return rows.groupBy("key", "name").agg(*latest)


def _compact(spark, table, into, merge):
    rows = read_batches(spark, table)
    write_batch(merge(rows), into, rows.agg(F.max("batch")).first()[0])


def _touched(spark, table, batch_id):
    return read_batches(spark, table).where(F.col("batch") == batch_id).select("key").distinct()


def _of(rows, only):
    return rows if only is None else rows.join(only, "key", "left_semi")
