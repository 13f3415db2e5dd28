"""Play a table of events through a streaming query, a stretch of time after another."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from eventfold.schemas import EVENT
from eventfold.session import FILES, file_system, scratch
from eventfold.session import setting as _set
from eventfold.sources.log import Log, read_events


def replay(
    events: DataFrame, stretch: Column, stretches: int, begin: Callable[[DataFrame], StreamingQuery]
) -> None:
    """Feed the events to ``begin`` in ``stretches`` restarts from the same checkpoint.

    ``stretch`` numbers the events from 0 and must not fall along a key's order. Events are written
    once, each stretch to files of its own, which are moved into the log when their turn comes.
    """
    spark = events.sparkSession
    staging, source = scratch(spark, "staging"), scratch(spark, "log")
    columns = [field.name for field in EVENT]
    staged = events.select(*columns, stretch.alias("stretch")).write.partitionBy("stretch")
    # a file open for each stretch, so that whole records are not sorted by it first
    with _set(spark, "spark.sql.maxConcurrentOutputFileWriters", stretches + 1):
        staged.options(**FILES).parquet(staging)
    for i in range(stretches):
        if not _move(spark, f"{staging}/stretch={i}", source, i):
            spark.createDataFrame([], EVENT).write.mode("append").parquet(source)
        query = begin(read_events(spark, Log(path=source), streaming=True))
        query.awaitTermination()
        if query.exception():
            raise query.exception()


def _move(spark: SparkSession, folder: str, source: str, i: int) -> int:
    """Move the files of a folder into the log, under names of their own; gives their number."""
    fs, at = file_system(spark, folder)
    files = list(fs.listStatus(at)) if fs.exists(at) else []
    fs.mkdirs(file_system(spark, source)[1])
    for file in files:
        name = f"stretch-{i}-{file.getPath().getName()}"
        if not fs.rename(file.getPath(), file_system(spark, f"{source}/{name}")[1]):
            raise OSError(f"{file.getPath().toString()} could not be moved into {source}")
    return len(files)
