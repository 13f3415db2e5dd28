"""Where events come from: a parquet log or a topic of frames."""

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventfold.functions.ordered import RUN_BITS
from eventfold.schemas import EVENT, INPUT_KINDS
from eventfold.sources.catalog import schema_catalog
from eventfold.sources.frames import decode_frames, good, rejects


@dataclass(frozen=True)
class Log:
    """An event log.

    ``parquet``: ``path`` holds files of ``schemas.EVENT`` rows.
    ``kafka``: ``topic`` holds framed records; ``options`` go to the Kafka source, which the
    cluster must have on its class path. ``partitions`` is the topic's partition count.
    """

    format: str = "parquet"
    path: str | None = None
    topic: str | None = None
    partitions: int = 1
    starting_offsets: str = "earliest"
    options: dict = field(default_factory=dict)


def run_bits_of(log: Log) -> int:
    """``run_bits`` for the folds of a log: runs of a key hold as many offsets as they would rows.

    A key's records are all in one partition of a topic, so their ``seq`` are as far apart as
    there are partitions.
    """
    return RUN_BITS + math.ceil(math.log2(max(1, log.partitions)))


def read_events(spark: SparkSession, log: Log, streaming: bool = False) -> DataFrame:
    """Events of a log, as a table or as a stream.

    Topic records get ``seq = offset * partitions + partition``: unique in the whole topic
    and in order within a partition, hence within a key. Frames that cannot be read are not
    among the events; ``read_rejects`` gives them.
    """
    if log.format == "parquet":
        reader = spark.readStream if streaming else spark.read
        return reader.schema(EVENT).options(**log.options).parquet(log.path)
    return from_topic(_records(spark, log, streaming), log)


def read_rejects(spark: SparkSession, log: Log, streaming: bool = False) -> DataFrame:
    """``key, seq, rejected_kind, reject_reason`` of a topic's frames that cannot be read."""
    return topic_rejects(_records(spark, log, streaming), log)


def _records(spark, log, streaming):
    if log.format != "kafka":
        raise ValueError(f"no such log format: {log.format}")
    return (
        (spark.readStream if streaming else spark.read)
        .format("kafka")
        .option("subscribe", log.topic)
        .option("startingOffsets", log.starting_offsets)
        .options(**log.options)
        .load()
    )


def from_topic(records: DataFrame, log: Log) -> DataFrame:
    """Events of ``key, value, offset, partition`` records, without what cannot be read."""
    return good(_decoded(records, log))


def topic_rejects(records: DataFrame, log: Log) -> DataFrame:
    """What ``from_topic`` leaves out, with the reasons."""
    return rejects(_decoded(records, log))


def _decoded(records, log):
    frames = records.select(
        F.col("key").cast("string").alias("key"),
        (F.col("offset") * log.partitions + F.col("partition")).alias("seq"),
        "value",
    )
    return decode_frames(frames, schema_catalog(records.sparkSession, log.topic), INPUT_KINDS)
