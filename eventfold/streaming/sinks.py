"""Tables written batch by batch, topics of aggregates, console taps."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from eventfold.schemas import COLUMN_OF, TYPE_OF
from eventfold.sources.frames import encode_frames


def write_batch(rows: DataFrame, table: str, batch_id: int) -> None:
    """Write the rows of one micro-batch; running the batch again replaces them."""
    rows.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")


def create(spark: SparkSession, table: str, like: DataFrame) -> None:
    """Write an empty batch, so that the table can be read before the first micro-batch."""
    write_batch(spark.createDataFrame([], like.schema), table, -1)


def read_batches(spark: SparkSession, table: str) -> DataFrame:
    """All rows of a table written by ``write_batch``, with their ``batch``."""
    return spark.read.parquet(table)


def start(writer: DataStreamWriter, checkpoint: str, every: str | None) -> StreamingQuery:
    """Start a query: every so often, or once over all there is and then stop."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def aggregate_frames(records: DataFrame, kind: str, ids: dict[str, int]) -> DataFrame:
    """``key, page, value``: aggregate records as frames."""
    record = F.struct(*[F.col(field.name) for field in TYPE_OF[kind]])
    rows = records.select(
        "key", F.col("page").alias("seq"), F.lit(kind).alias("kind"), record.alias(COLUMN_OF[kind])
    )
    return encode_frames(rows, ids).withColumnRenamed("seq", "page")


def topic_rows(
    records: DataFrame, kind: str, ids: dict[str, int], batch_id: int = 0
) -> DataFrame:
    """Aggregate records as the Kafka sink takes them, list page and batch in headers.

    A reader puts the pages of one key and batch together, and knows a batch sent again by its
    number.
    """

    def header(name, value):
        return F.struct(F.lit(name).alias("key"), value.cast("string").cast("binary").alias("value"))

    headers = F.array(header("page", F.col("page")), header("batch", F.lit(batch_id)))
    return aggregate_frames(records, kind, ids).select("key", "value", headers.alias("headers"))


def topic_publisher(topic: str, kind: str, ids: dict[str, int], options: dict):
    """Send changed records to a topic, keyed by string.

    The Kafka sink delivers at least once; readers keep the pages of a key's last batch.
    """

    def publish(records: DataFrame, batch_id: int) -> None:
        writer = topic_rows(records, kind, ids, batch_id).write.format("kafka")
        writer.option("topic", topic).options(**options).save()

    return publish


def console_tap(stream: DataFrame, checkpoint: str, every: str | None = None, mode: str = "append"):
    """Print what passes, for development."""
    return start(stream.writeStream.outputMode(mode).format("console"), checkpoint, every)
