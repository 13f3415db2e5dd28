"""Bitmaps of hashes: sets of bounded size that may take a hash too many, never one too few."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27  # 16 MB
CHUNK = 1 << 16  # bytes in one row


def no_marks() -> np.ndarray:
    return np.zeros(LEAST_BITS // 8, np.uint8)


def marked(hashes: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Which hashes have their bit set."""
    at = hashes & np.uint64(8 * len(bitmap) - 1)
    byte = bitmap[(at >> np.uint64(3)).astype(np.int64)]
    return (byte >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def bitmap_of(hashes: DataFrame, count: int) -> np.ndarray:
    """A bitmap with the bit of each hash set, of 16 bits a hash and bounded size."""
    bits = LEAST_BITS
    while bits < min(16 * count, MOST_BITS):
        bits *= 2
    size = min(CHUNK, bits // 8)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            at = batch.column(0).to_numpy().view(np.uint64) & np.uint64(bits - 1)
            np.bitwise_or.at(
                own, (at >> np.uint64(3)).astype(np.int64), 1 << (at & np.uint64(7)).astype(np.uint8)
            )
        parts = own.reshape(-1, size)
        used = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_pydict(
            {"part": used.astype(np.int32), "own": [parts[i].tobytes() for i in used]},
            schema=pa.schema([("part", pa.int32()), ("own", pa.binary())]),
        )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                bits_of = np.frombuffer(own, np.uint8)
                parts[part] = parts[part] | bits_of if part in parts else bits_of
        yield pa.RecordBatch.from_pydict(
            {"part": list(parts), "own": [p.tobytes() for p in parts.values()]},
            schema=pa.schema([("part", pa.int32()), ("own", pa.binary())]),
        )

    kind = "part int, own binary"
    marks = hashes.mapInArrow(mark, kind).repartition("part").mapInArrow(join, kind)
    out = np.zeros(bits // 8, np.uint8)
    for row in marks.collect():  # at most MOST_BITS in all
        out[row.part * size : (row.part + 1) * size] = np.frombuffer(row.own, np.uint8)
    return out
