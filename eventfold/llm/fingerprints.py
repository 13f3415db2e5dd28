"""Document fingerprints: sketches that keep a fixed fraction of shingle hashes.

A text's shingles are its runs of five words (white space apart, A-Z lower-cased); a text of
fewer words is one shingle. A sketch keeps every hash below a fixed threshold, ``1 / SCALE`` of
all, so its size follows the text's, sketches of parts merge by union, and the share of one
sketch found in another estimates containment however unequal the texts are. The least hash is
kept as well, so a text with a word is never without a sketch; a union keeps the least of both.

For the query each document also meets the one that follows it in descending order of id. That
takes one shuffle of the texts: documents are dealt to ranges of ids, and the first document of
each range is sent to the range before as a guest, so each range is walked on its own, row by
row. Range bounds come from quantiles and a table of one head per range; no text passes the
driver and none is broadcast.

Defined results: a null text is empty; an empty or wordless text has an empty sketch, whose
likeness is 1 to another empty one and 0 to any other; a null id follows all others; equal ids
follow each other by a hash of their text; the last is followed by the first, a single one by
itself; an empty table gives none; further columns are ignored.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventfold.llm.common import row_key, whole

WORDS = 5
SCALE = 4
THRESHOLD = np.uint64(2**64 // SCALE)
CACHED, CACHED_BYTES = 200_000, 64  # words kept by a task, and the longest of them
# Ranges per shuffle partition, so that hashing them to partitions evens out.
RANGES, MOST_RANGES = 4, 10_000


class WordHashes(dict):
    """Word to 64-bit hash, with a bound on what is kept."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= CACHED_BYTES:
            if len(self) > CACHED:
                self.clear()
            self[word] = h
        return h


def shingle_hashes(data: bytes, hashes: WordHashes, words: int = WORDS) -> np.ndarray:
    """Hashes of the shingles of a text in UTF-8, in order, repeats and all."""
    split = data.lower().split()
    own = np.fromiter(map(hashes.__getitem__, split), np.uint64, len(split))
    if not len(own):
        return own
    n = max(1, len(own) - words + 1)
    mixed = np.full(n, len(own) if n == 1 and len(own) < words else words, np.uint64)
    for i in range(min(words, len(own))):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + own[i : i + n]
    for shift, factor in ((32, 0xBF58476D1CE4E5B9), (29, 0x94D049BB133111EB)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    return mixed ^ (mixed >> np.uint64(32))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The distinct hashes below the threshold and the least one, ascending."""
    kept = np.unique(hashes[hashes < THRESHOLD])
    return kept if len(kept) or not len(hashes) else hashes.min()[None]


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of all shingles of two sketches."""
    return sketch(np.concatenate([a, b]))


def shown(kept: np.ndarray) -> str:
    return kept.astype(">u8").tobytes().hex()


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """The share of a sketch found in another."""
    if not len(a):
        return float(not len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a)


def _ranges(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows with their range (``at``), and one row per range: its head and where it guests."""
    spark = rows.sparkSession
    n = min(MOST_RANGES, RANGES * int(spark.conf.get("spark.sql.shuffle.partitions")))
    shares = [i / n for i in range(1, n)]
    bounds = rows.agg(F.percentile_approx("kid", shares, 10 * n).alias("b")).first().b or []
    splits = np.unique(np.array(bounds, dtype=np.int64))

    @F.pandas_udf("long")
    def at(ids: pd.Series) -> pd.Series:
        return pd.Series(len(splits) - np.searchsorted(splits, ids.to_numpy(), side="left"))

    placed = rows.withColumn("at", at("kid"))
    heads = placed.groupBy("at").agg(F.max(F.struct("kid", F.bitwise_not("kth"))).alias("h"))
    found = sorted((r.at, r.h[0], ~r.h[1]) for r in heads.collect())  # at most MOST_RANGES
    before = [found[i - 1][0] for i in range(len(found))]
    table = [(a, kid, kth, b) for (a, kid, kth), b in zip(found, before)]
    return placed, spark.createDataFrame(table, "at long, kid long, kth long, guest_of long")


def followed(docs: DataFrame) -> DataFrame:
    """Documents of each range in descending order of id, guests last: ``at, guest, …, text``."""
    rows = docs.select("doc_id", *row_key(), whole().alias("text"))
    placed, heads = _ranges(rows)
    twice = placed.join(F.broadcast(heads), ["at", "kid", "kth"], "left").select(
        "doc_id",
        "kid",
        "kth",
        "text",
        F.explode(
            F.when(
                F.col("guest_of").isNotNull(),
                F.array(
                    F.struct("at", F.lit(False).alias("guest")),
                    F.struct(F.col("guest_of").alias("at"), F.lit(True).alias("guest")),
                ),
            ).otherwise(F.array(F.struct("at", F.lit(False).alias("guest"))))
        ).alias("to"),
    )
    dealt = twice.select("to.at", "to.guest", "kid", "kth", "doc_id", "text").repartition("at")
    return dealt.sortWithinPartitions("at", "guest", F.desc("kid"), "kth")


SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)
TYPES = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
FIELDS = pa.schema([(name, TYPES[kind]) for name, kind in (x.split() for x in SCHEMA.split(", "))])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    last = None  # the range, id, text and sketch that still wait for what follows

    def result(doc_id, text: str, own: np.ndarray, after: str, next_own: np.ndarray) -> tuple:
        n = len(text)
        edited = (text[: n - n // 3] + after[: n // 3]).encode()
        other = sketch(shingle_hashes(edited, hashes))
        near = containment(own, other), containment(own, next_own)
        return doc_id, n, hashlib.sha256(edited).hexdigest(), shown(own), shown(other), *near

    for batch in batches:
        out = []
        columns = (batch.column(c).to_pylist() for c in ("at", "guest", "doc_id", "text"))
        for at, guest, doc_id, text in zip(*columns):
            if last is None and guest:
                continue
            own = sketch(shingle_hashes(text.encode(), hashes))
            if last is not None:
                out.append(result(*last, text, own))
            last = None if guest else (doc_id, text, own)
        if out:
            yield pa.RecordBatch.from_pydict(dict(zip(FIELDS.names, zip(*out))), schema=FIELDS)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Sketches of each document and of its text edited with the next document's."""
    return followed(docs).mapInArrow(_compared, SCHEMA)
