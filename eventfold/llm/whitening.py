"""Embedding whitening by spectral divide and conquer.

Vectors are taken as integers (``floor(1024 * c) + 100000``), so their sums are exact. One pass
adds up counts and sums, one the covariance, centred before it is multiplied. Both are merged in
Spark row by row of the matrix, so the driver only ever holds one matrix of the vectors' width.

Its eigenvectors come from QDWH: the polar factor of ``A - s I``, by dynamically weighted Halley
steps of QR decompositions, is the matrix sign, and half of it plus the identity projects on the
invariant subspace above ``s``. The shift is the mean of the diagonal, which lies between the
least and the greatest eigenvalue unless all are equal; where it hits an eigenvalue, the projector
is not one and another shift is taken. Both subspaces are split again in the same way, the upper
one first, down to single components, and no further than the components asked for.

The projection is broadcast: as many rows of the vectors' width as there are components. A third
pass measures the covariance of what comes out, a fourth gives the rows; all are narrow.

Defined results: a vector that is null or empty or holds a null or non-finite entry is dropped;
vectors of different widths are an error, and so is an entry of 2**40 or more, as its integer
would not be exact beside the sums; a component without variance is whitened to 0 and takes no
part in the identity's error; with no variance at all every share explained is 0; equal
eigenvalues give some orthonormal basis of their space, the same for all rows; repeated rows and
equal or null ids each give rows; an empty table gives none; further columns are ignored.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventfold.llm.vectors import integers as scaled
from eventfold.llm.vectors import usable

SCALE, SHIFT = 1024, 100_000
MOST = 2.0**40
EPS = float(np.finfo(np.float64).eps)
STEPS = 60  # of Halley; six or seven are usual
SHIFTS = (0.0, 0.11, -0.13, 0.29, -0.31, 0.53, -0.57, 0.83, -0.87)  # of the way to an end


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by QDWH."""
    n = len(a)
    x = a / max(np.linalg.norm(a, 2 if n <= 64 else "fro"), np.finfo(float).tiny)
    low = EPS
    for _ in range(STEPS):
        d = np.cbrt(4 * (1 - low * low) / low**4)
        r = np.sqrt(1 + d)
        wa = r + 0.5 * np.sqrt(max(8 - 4 * d + 8 * (2 - low * low) / (low * low * r), 0.0))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(n)]))
        new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        done = np.linalg.norm(new - x) <= np.sqrt(n) * 1e-15 or abs(1 - low) < 1e-15
        low = min(1.0, low * (wa + wb * low * low) / (1 + wc * low * low))
        x = new
        if done:
            break
    return x


def split(a: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces above and below a shift; None if all is equal."""
    n, middle = len(a), np.trace(a) / len(a)
    spread = np.linalg.norm(a - middle * np.eye(n))
    if spread <= 4 * n * EPS * max(np.linalg.norm(a), np.finfo(float).tiny):
        return None
    best, least = None, np.inf
    for way in SHIFTS:
        sign = polar(a - (middle + way * spread / np.sqrt(n)) * np.eye(n))
        p = (sign + np.eye(n)) / 2
        rank = int(round(np.trace(p)))
        if not 0 < rank < n:
            continue
        upper, _ = np.linalg.qr(p @ rng.standard_normal((n, rank)))
        both, _ = np.linalg.qr(np.hstack([p @ upper, np.zeros((n, n - rank))]), mode="complete")
        upper = both[:, :rank]
        # the complement of the range, cleaned by the other projector
        lower, _ = np.linalg.qr(both[:, rank:] - p @ both[:, rank:])
        lower, _ = np.linalg.qr(lower - upper @ (upper.T @ lower))
        left = np.linalg.norm(lower.T @ a @ upper)
        if left < least:
            best, least = (upper, lower), left
        if left <= 8 * n * EPS * np.linalg.norm(a):
            break
    return best


def components(a: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The greatest eigenvalues of a symmetric matrix, falling, and their unit vectors as columns."""
    rng, n = np.random.default_rng(13), len(a)
    found: list[np.ndarray] = []
    todo = [np.eye(n)]  # bases of subspaces, the one of the greatest eigenvalues last
    while todo and sum(b.shape[1] for b in found) < most:
        basis = todo.pop()
        inner = basis.T @ a @ basis
        halves = split((inner + inner.T) / 2, rng) if basis.shape[1] > 1 else None
        if halves is None:
            found.append(basis)
        else:
            todo += [basis @ halves[1], basis @ halves[0]]
    if not found:
        return np.zeros(0), np.zeros((n, 0))
    vectors = np.hstack(found)
    vectors /= np.linalg.norm(vectors, axis=0)
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")[:most]
    return values[order], vectors[:, order]


@dataclass(frozen=True)
class Whitening:
    n: int
    sums: np.ndarray  # of the integers, exact
    values: np.ndarray
    vectors: np.ndarray  # columns
    trace: float

    @property
    def live(self) -> np.ndarray:
        """Components that have variance."""
        return self.values > max(self.trace, 0.0) * len(self.sums) * EPS

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace if self.trace > 0 else np.zeros(len(self.values))

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Integers, a row each, whitened."""
        scale = np.where(self.live, 1 / np.sqrt(np.where(self.live, self.values, 1.0)), 0.0)
        return centred(x, self.n, self.sums) @ (self.vectors * scale)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``x - sums / n``: the whole parts apart, so that nothing is lost to their size."""
    whole = sums // n
    return (x - whole).astype(np.float64) - (sums - whole * n) / n


def integers(vectors: pa.Array) -> np.ndarray:
    """A row of integers for each vector of a batch."""
    return scaled(vectors, SCALE, MOST) + SHIFT


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count and sums of what a task sees."""
    n, sums = 0, None
    for batch in batches:
        if batch.num_rows:
            x = integers(batch.column("v"))
            if sums is not None and len(sums) != x.shape[1]:
                raise ValueError("vectors of different widths")
            n, sums = n + len(x), x.sum(axis=0) + (0 if sums is None else sums)
    if n:
        yield pa.RecordBatch.from_pydict(
            {"at": np.arange(len(sums)), "n": np.full(len(sums), n), "total": sums, "width": np.full(len(sums), len(sums))}
        )


def _added(batches: Iterator[pa.RecordBatch], rows) -> Iterator[pa.RecordBatch]:
    """The sum over a task of what ``rows`` makes of a batch, as packed rows of a matrix."""
    total = None
    for batch in batches:
        if batch.num_rows:
            own = rows(batch)
            total = own if total is None else total + own
    if total is not None:
        yield pa.RecordBatch.from_pydict(
            {"at": np.arange(len(total)), "row": [r.tobytes() for r in total]},
            schema=pa.schema([("at", pa.int64()), ("row", pa.binary())]),
        )


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the same place added up."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for at, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = np.frombuffer(row)
            held[at] = held[at] + own if at in held else own
    yield pa.RecordBatch.from_pydict(
        {"at": list(held), "row": [r.tobytes() for r in held.values()]},
        schema=pa.schema([("at", pa.int64()), ("row", pa.binary())]),
    )


def _matrix(rows: DataFrame, width: int, of_batch) -> np.ndarray:
    """The sum over all rows; tasks' matrices meet row by row, never whole."""
    kind = "at long, row binary"
    parts = rows.mapInArrow(lambda batches: _added(batches, of_batch), kind)
    met = parts.repartition("at").mapInArrow(_merged, kind)
    out = np.zeros((width, width))
    for r in met.collect():  # a matrix of the vectors' width
        out[r["at"]] = np.frombuffer(r["row"])
    return out


def fitted(rows: DataFrame, most: int = 8) -> Whitening | None:
    """The whitening of the rows of ``usable``; None if there are none."""
    totals = rows.mapInArrow(_totals, "at long, n long, total long, width long").groupBy("at").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.count_distinct("width").alias("widths")
    )
    found = sorted(totals.collect(), key=lambda r: r["at"])  # the vectors' width
    if not found:
        return None
    n, sums = found[0].n, np.array([r.total for r in found], np.int64)
    if len({(r.n, r.widths) for r in found}) > 1:
        raise ValueError("vectors of different widths")

    def product(batch: pa.RecordBatch) -> np.ndarray:
        d = centred(integers(batch.column("v")), n, sums)
        return d.T @ d

    covariance = _matrix(rows, len(sums), product) / n
    covariance = (covariance + covariance.T) / 2
    values, vectors = components(covariance, most)
    return Whitening(n, sums, values, vectors, float(np.trace(covariance)))


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """How far the covariance of the whitened rows is from the identity, at most."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    k = len(model.values)

    def product(batch: pa.RecordBatch) -> np.ndarray:
        w = shared.value.apply(integers(batch.column("v")))
        # its mean is zero but for rounding: centring came before the projection
        return w.T @ w

    off = np.abs(_matrix(rows, k, product) / model.n - np.eye(k))
    live = model.live
    return float(off[np.ix_(live, live)].max(initial=0.0))


def _exact(x: np.ndarray, model: Whitening) -> pa.Array:
    """``(n x - S)**2`` summed over a row, exact whatever its size."""
    off = model.n * x - model.sums
    if len(model.sums) * float(np.abs(off).max(initial=0)) ** 2 < 2.0**62:
        return pa.array((off * off).sum(axis=1)).cast(pa.decimal128(38, 0))
    whole = [sum(v * v for v in row) for row in off.tolist()]
    return pa.array([Decimal(v) for v in whole], pa.decimal128(38, 0))


def whitened(rows: DataFrame, model: Whitening) -> DataFrame:
    """``id, component, deviation, whitened, explained`` of the rows of ``usable``."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        k = len(known.values)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = integers(batch.column("v"))
            each = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(each),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    _exact(x, known).take(each),
                    pa.array(known.apply(x).ravel()),
                    pa.array(np.tile(known.explained, len(x))),
                ],
                ["id", "component", "deviation", "whitened", "explained"],
            )

    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType)]).add("component", "integer")
    schema = schema.add("deviation", T.DecimalType(38, 0)).add("whitened", "double").add("explained", "double")
    return rows.select("id", "v").mapInArrow(look, schema)


def whitening_rows(vectors: DataFrame, most: int = 8) -> DataFrame:
    """The contract's rows of a table of ``vec_id, embedding``.

    ``deviation`` is a long here: more than one holds ends the job instead of wrapping around.
    """
    rows = usable(vectors)
    model = fitted(rows, most)
    if model is None:
        model = Whitening(0, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, 0)), 0.0)
        error = 0.0
    else:
        error = identity_error(rows, model)
    return whitened(rows, model).select(
        F.col("id").alias("vec_id"),
        "component",
        F.lit(model.n).cast("long").alias("n"),
        F.col("deviation").cast("long").alias("deviation"),
        "whitened",
        "explained",
        F.lit(error).alias("identity_error"),
    )
