"""Helpers for tables of vectors: which rows have one, and their integers."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, ids: str = "vec_id", column: str = "embedding", label: str | None = None) -> DataFrame:
    """``id, v`` of the rows whose vector has entries, all of them finite; ``v`` as doubles.

    With ``label``, that column beside them, under that name.
    """
    v = F.col(column).cast("array<double>")
    good = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, good)
    labels = [F.col(label).alias("label")] if label else []
    return vectors.where(fine).select(F.col(ids).alias("id"), v.alias("v"), *labels)


def integers(vectors: pa.Array, scale: int, most: float) -> np.ndarray:
    """``floor(scale * entry)``, a row for each vector of a batch; entries are below ``most``."""
    lengths = np.diff(vectors.offsets.to_numpy())
    if len(set(lengths.tolist())) > 1:
        raise ValueError("vectors of different widths")
    values = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(lengths), -1)
    if np.abs(values).max(initial=0) >= most:
        raise ValueError("an entry is too large for exact integers")
    return np.floor(scale * values).astype(np.int64)
