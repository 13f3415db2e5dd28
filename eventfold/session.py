"""Session settings and the shared scratch folder."""

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Shuffle files go when the plan they belong to has run, not when the driver next collects its garbage.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Of files that are written once and read a few times: ids hardly repeat, so a dictionary of them is
# made for nothing, and keys are alike, which zstd finds.
FILES = {"compression": "zstd", "parquet.enable.dictionary": "false"}

# Input per shuffle partition, and the number beyond which bookkeeping outweighs it.
PARTITION_BYTES = 128 * 1024 * 1024
MOST_PARTITIONS = 50_000


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings the operators rely on; safe on a session made by someone else."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    # the number of rows is not read; keeping it looks every key up again when it is written
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows", "false")
    # each micro-batch uploads what changed instead of whole state files
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    return spark


def fit_shuffles(spark: SparkSession, *inputs: DataFrame) -> None:
    """Plan shuffles for the size of the inputs; adaptive execution merges small partitions.

    A window or aggregation cannot split a partition that turns out too large, so there
    must be enough of them from the start. Sizes come from file listings, not from a job.
    """
    size = sum(
        int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for df in inputs
    )
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = max(usual, min(size // PARTITION_BYTES, MOST_PARTITIONS))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", wanted)


@contextmanager
def setting(spark: SparkSession, name: str, value):
    """A setting for a while."""
    was = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if was is None else spark.conf.set(name, was)


def local_session(cpus: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("eventfold")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="eventfold-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def file_system(spark: SparkSession, path: str):
    """The file system a path is on, and the path as it takes it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared folder named by ``spark.checkpoint.dir``."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="eventfold-")
    return f"{base}/{name}-{uuid.uuid4().hex}"
