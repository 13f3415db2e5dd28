"""Tables of current state that a stream keeps: buckets of keys, written in generations.

A table has parts. Rows of a keyed part fall into buckets by their key. A micro-batch writes the
rows it changed as a new generation, in the buckets it touched and no others; of several rows with
the same keys the one of the latest ``batch`` counts. Generations of a bucket are merged as a
binary counter carries: a new one takes in those of its own size before it. So a bucket touched by
``n`` micro-batches has at most ``log2(n) + 1`` generations at any time, and a row is rewritten
``log2(n)`` times at most, while the stream runs. A part that is a log is appended to and has one
generation for each micro-batch.

**Commits.** What a micro-batch writes is seen by nobody until its manifest is: one small file that
names the live generations of all parts, the table's batch number and its meters, put in place by a
rename. All parts change together; a micro-batch that was killed leaves files nobody reads, and one
that runs again after its commit is skipped (``begun``). Output is exactly-once. A reader takes one
manifest and reads what it names, so it sees one state throughout. The last ``KEPT`` manifests and
their generations stay; older ones, and what killed micro-batches left, are removed.

A bucket is one directory of a generation. Rows are rebalanced by bucket before they are written,
which splits a bucket that one hot key has filled, and sorted by key, so that a point read takes
one bucket and skips row groups. The number of buckets is fixed when a table is made.
"""

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from eventfold.session import FILES
from eventfold.session import file_system as _fs

BUCKETS = 64
KEPT = 3
FOLDER = "_manifests"
STAGED = "_staged"


@dataclass(frozen=True)
class Manifest:
    """What is live as of a batch. ``parts`` has schema and generations by part."""

    batch: int = -1
    buckets: int = BUCKETS
    owner: str = ""  # the checkpoint whose batch numbers these are
    parts: dict = field(default_factory=dict)
    meters: dict = field(default_factory=dict)


def bucket_of(key: str | Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


# --- files -----------------------------------------------------------------------------------


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, at = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def _remove(spark: SparkSession, path: str) -> None:
    fs, at = _fs(spark, path)
    fs.delete(at, True)


def _batches(spark: SparkSession, table: str) -> list[int]:
    names = _names(spark, f"{table}/{FOLDER}")
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))


def _load(spark: SparkSession, table: str, batch: int) -> Manifest:
    fs, at = _fs(spark, f"{table}/{FOLDER}/{batch}.json")
    stream = fs.open(at)
    try:
        return Manifest(**json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
    finally:
        stream.close()


# --- manifests -------------------------------------------------------------------------------


def latest(spark: SparkSession, table: str) -> Manifest:
    """The last manifest committed; an empty one if there is none."""
    found = _batches(spark, table)
    return _load(spark, table, found[-1]) if found else Manifest()


def create(spark: SparkSession, table: str, owner: str, buckets: int, parts: dict[str, DataFrame]) -> None:
    """Make a table if there is none; ``parts`` are empty tables that show the columns.

    A table belongs to one checkpoint: the batch numbers of another would not follow its own.
    """
    known = latest(spark, table)
    if known.owner and known.owner != owner:
        raise ValueError(f"{table} is kept by the stream of {known.owner}")
    if not known.owner:
        schemas = {name: {"schema": df.schema.json(), "live": {}} for name, df in parts.items()}
        commit(spark, table, Manifest(-1, buckets, owner, schemas, {}))
    else:
        sweep(spark, table)


def begun(spark: SparkSession, table: str, batch: int) -> Manifest | None:
    """The manifest to start a batch from; None if the batch is committed already."""
    known = latest(spark, table)
    return None if batch <= known.batch else known


def commit(spark: SparkSession, table: str, manifest: Manifest) -> None:
    """Put a manifest in place, so that all it names is seen at once; then let old ones go."""
    fs, final = _fs(spark, f"{table}/{FOLDER}/{manifest.batch}.json")
    _, draft = _fs(spark, f"{table}/{FOLDER}/.{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(json.dumps(vars(manifest)).encode())
    out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        raise RuntimeError(f"batch {manifest.batch} of {table} was committed by another stream")
    old = _batches(spark, table)[:-KEPT]
    held = [_load(spark, table, b) for b in _batches(spark, table)[-KEPT:]]
    still = {pair for m in held for pair in _pairs(m)}
    for batch in old:
        for part, generation, bucket in _pairs(_load(spark, table, batch)) - still:
            _remove(spark, f"{table}/{part}/gen={generation}/bucket={bucket}")
        _remove(spark, f"{table}/{FOLDER}/{batch}.json")


def sweep(spark: SparkSession, table: str) -> None:
    """Remove what was staged and generations that no manifest names, as killed micro-batches leave them."""
    unstage(spark, table)
    manifests = [_load(spark, table, b) for b in _batches(spark, table)]
    named = {(part, generation) for m in manifests for part, generation, _ in _pairs(m)}
    for part in manifests[-1].parts:
        for name in _names(spark, f"{table}/{part}"):
            if name.startswith("gen=") and (part, name.removeprefix("gen=")) not in named:
                _remove(spark, f"{table}/{part}/{name}")


def _pairs(manifest: Manifest) -> set[tuple[str, str, str]]:
    return {
        (part, generation, bucket)
        for part, about in manifest.parts.items()
        for bucket, generations in about["live"].items()
        for generation, _ in generations
    }


# --- rows ------------------------------------------------------------------------------------


def _rows(spark: SparkSession, table: str, about: dict, part: str, live: list[tuple[str, str]]) -> DataFrame:
    schema = StructType.fromJson(json.loads(about["schema"]))
    if not live:
        return spark.createDataFrame([], schema)
    paths = [f"{table}/{part}/gen={generation}/bucket={bucket}" for bucket, generation in live]
    return spark.read.schema(schema).parquet(*paths)


def newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows with the same keys the one of the latest batch."""
    columns = rows.columns
    last = F.max("batch").over(Window.partitionBy(*keys))
    return rows.withColumn("_last", last).where("batch = _last").select(*columns)


def newest_of_none(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``newest`` of rows that are written once for their keys, but for keys that are null.

    A null is not found again among what is known, so only such rows may have come again.
    """
    null = " OR ".join(f"`{k}` IS NULL" for k in keys)
    return rows.where(f"NOT ({null})").unionByName(newest(rows.where(null), keys))


def read(
    spark: SparkSession,
    table: str,
    manifest: Manifest,
    part: str,
    buckets: list[int] | None = None,
    keys: list[str] | None = None,
) -> DataFrame:
    """Rows of a part, of some buckets or all; with ``keys``, the newest of each."""
    about = manifest.parts[part]
    chosen = about["live"] if buckets is None else [str(b) for b in buckets if str(b) in about["live"]]
    live = [(b, generation) for b in chosen for generation, _ in about["live"][b]]
    rows = _rows(spark, table, about, part, live)
    several = any(len(about["live"][b]) > 1 for b in chosen)
    return newest(rows, keys) if keys and several else rows


def read_key(spark: SparkSession, table: str, manifest: Manifest, part: str, key: str, keys: list[str]) -> DataFrame:
    """The rows of one key, from its bucket alone."""
    where = spark.sql(
        "SELECT CAST(pmod(xxhash64(:key), :n) AS INT) AS b", args={"key": key, "n": manifest.buckets}
    )
    (bucket,) = where.first()
    about = manifest.parts[part]
    live = [(str(bucket), generation) for generation, _ in about["live"].get(str(bucket), ())]
    rows = _rows(spark, table, about, part, live).where(F.col("key") == key)
    return newest(rows, keys) if len(live) > 1 else rows


def write(
    spark: SparkSession,
    table: str,
    manifest: Manifest,
    part: str,
    rows: DataFrame,
    batch: int,
    buckets: list[int],
    keys: list[str] | None = None,
    once: bool = False,
) -> Manifest:
    """Write what a micro-batch changed; gives the manifest to commit, as yet seen by nobody.

    ``buckets`` are those that rows may fall into. With ``keys``, merging keeps the newest row
    of each; without, all. ``once`` says that no keys but null ones are ever written again.
    """
    about = manifest.parts[part]
    generation = f"{batch}-{uuid.uuid4().hex[:12]}"
    live = {b: list(g) for b, g in about["live"].items()}
    taken, levels = [], {}
    for b in map(str, buckets):
        level = 0
        while live.get(b) and live[b][-1][1] == level:
            taken.append((b, live[b].pop()[0]))
            level += 1
        levels[b] = level
    if taken:
        old = _rows(spark, table, about, part, taken)
        rows = old.unionByName(rows)
        if keys:
            rows = newest_of_none(rows, keys) if once else newest(rows, keys)
    columns = StructType.fromJson(json.loads(about["schema"])).names
    order = ["bucket", *(keys or [c for c in ("key", "seq") if c in columns])]
    path = f"{table}/{part}/gen={generation}"
    (
        rows.select(*columns, bucket_of("key", manifest.buckets).alias("bucket"))
        .hint("rebalance", "bucket")
        .sortWithinPartitions(*order)
        .write.partitionBy("bucket")
        .options(**FILES)
        .parquet(path)
    )
    for name in _names(spark, path):
        if name.startswith("bucket="):
            b = name.removeprefix("bucket=")
            live.setdefault(b, []).append([generation, levels[b]])
    parts = {**manifest.parts, part: {**about, "live": live}}
    return Manifest(manifest.batch, manifest.buckets, manifest.owner, parts, manifest.meters)


def stage(spark: SparkSession, table: str, rows: DataFrame, batch: int) -> DataFrame:
    """Rows that several parts of a micro-batch are made of, written once and read back.

    They take the executors' memory neither meanwhile nor, once ``unstage`` is called, the disk.
    """
    path = f"{table}/{STAGED}/{batch}-{uuid.uuid4().hex[:12]}"
    rows.write.options(**FILES).parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def unstage(spark: SparkSession, table: str) -> None:
    """Remove what a micro-batch has staged, or a killed one has left."""
    _remove(spark, f"{table}/{STAGED}")


def append(spark: SparkSession, table: str, manifest: Manifest, part: str, rows: DataFrame, batch: int) -> Manifest:
    """Add rows to a part that is a log: one generation for a batch, in a bucket of its own."""
    about = manifest.parts[part]
    generation = f"{batch}-{uuid.uuid4().hex[:12]}"
    columns = StructType.fromJson(json.loads(about["schema"])).names
    rows.select(*columns).write.option("compression", FILES["compression"]).parquet(f"{table}/{part}/gen={generation}/bucket=0")
    live = {"0": [*about["live"].get("0", ()), [generation, batch]]}
    parts = {**manifest.parts, part: {**about, "live": live}}
    return Manifest(manifest.batch, manifest.buckets, manifest.owner, parts, manifest.meters)


def read_log(spark: SparkSession, table: str, manifest: Manifest, part: str, after: int = -1) -> DataFrame:
    """The rows of a log part of batches later than ``after``; a reader goes on from the last it has seen."""
    about = manifest.parts[part]
    live = [("0", g) for g, batch in about["live"].get("0", ()) if batch > after]
    return _rows(spark, table, about, part, live)
