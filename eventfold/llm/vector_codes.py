"""Compression of vectors to short codes: a codebook for each part, learned by cover-tree Lloyd.

Vectors are taken as integers (``floor(256 * c)``) and cut into equal parts. Each part position
has a codebook that starts as that part of the vectors of least id and is moved for some rounds:
every part goes to its nearest entry, every entry to the floor of the mean of what it got. All of
it is in integers, so the result does not depend on partitions or order.

1. One pass makes, of every ``CHUNK`` vectors a task sees, a cover tree for each part position,
   and writes the trees to the shared folder: a few times the vectors' own bytes, each record
   bounded. Equal vectors, however many, are one leaf of radius zero.
2. A round broadcasts the codebooks, which are bounded by their size, and goes through the trees:
   whole subtrees are assigned by the triangle inequality, their counts and sums taken from
   cumulative sums; only what stays ambiguous is compared point by point (``cover_tree``). A task
   gives one row for each entry that got something; rows of an entry are added up in Spark.
3. A last pass assigns all parts for good and gives codes and errors.

Nothing is dealt by vector or label, but the sums of errors of equal labels, which are partially
added before their shuffle. Labels are joined back by broadcast if they are few, else by a join
that adaptive execution splits where a label is hot.

Defined results: a vector that is null or empty or holds a null or non-finite entry is dropped;
vectors of different widths, a width that the parts do not divide and entries of 2**18 or more are
errors; ids that are null come after all others, equal ids are ordered by their vectors; with
fewer vectors than entries the codebooks have as many; repeated rows each give a row; an empty
table gives none; further columns are ignored.
"""

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventfold.llm.common import kept_table
from eventfold.llm.cover_tree import Tree, assigned, tree_of
from eventfold.llm.vectors import integers, usable

SCALE, MOST = 256, 2.0**18
CHUNK = 4_096
GIVEN = 8_192  # rows in a batch of codes
FEW_LABELS = 100_000  # of a long and a label each


def whole_numbers(vectors: pa.Array, parts: int) -> np.ndarray:
    x = integers(vectors, SCALE, MOST)
    if x.shape[1] % parts:
        raise ValueError(f"vectors of {x.shape[1]} entries cannot be cut into {parts} equal parts")
    return x


def _cut(x: np.ndarray, parts: int) -> np.ndarray:
    """Part position, row, entry."""
    return np.ascontiguousarray(x.reshape(len(x), parts, -1).swapaxes(0, 1))


def _packed(trees: list[Tree]) -> bytes:
    """Trees in the smallest integers that hold them."""
    small = lambda a: a.astype(np.int32) if a.dtype == np.int64 else a
    plain = [{name: small(value) for name, value in vars(tree).items()} for tree in trees]
    return zstandard.compress(pickle.dumps(plain, protocol=5), 1)


def _trees(packed: bytes) -> list[Tree]:
    wide = lambda a: a.astype(np.int64) if a.dtype == np.int32 else a
    plain = pickle.loads(zstandard.decompress(packed))
    return [Tree(**{name: wide(value) for name, value in tree.items()}) for tree in plain]


def forest(rows: DataFrame, parts: int) -> DataFrame:
    """``ids, labels, trees``: the cover trees of every ``CHUNK`` rows of ``usable``, written."""
    kinds = [rows.schema[c].dataType for c in ("id", "label")]

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def grown(table: pa.Table) -> pa.RecordBatch:
            table = table.combine_chunks()
            x = whole_numbers(table.column("v").chunk(0), parts)
            packed = _packed([tree_of(own) for own in _cut(x, parts)])
            lists = [
                pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), table.column(c).chunk(0))
                for c in ("id", "label")
            ]
            return pa.RecordBatch.from_arrays([*lists, pa.array([packed])], ["ids", "labels", "trees"])

        held, size = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                piece = batch.slice(at, CHUNK - size)
                held.append(piece)
                size, at = size + piece.num_rows, at + piece.num_rows
                if size == CHUNK:
                    yield grown(pa.Table.from_batches(held))
                    held, size = [], 0
        if held:
            yield grown(pa.Table.from_batches(held))

    schema = T.StructType().add("ids", T.ArrayType(kinds[0])).add("labels", T.ArrayType(kinds[1]))
    made = rows.select("id", "v", "label").mapInArrow(grow, schema.add("trees", "binary"))
    return kept_table(rows.sparkSession, made, "trees")


def first_books(rows: DataFrame, parts: int, entries: int) -> np.ndarray:
    """Part position, entry, place: the parts of the vectors of least id."""
    least = rows.select("id", "v").orderBy(F.asc_nulls_last("id"), "v").limit(entries).select("v")
    table = least.toArrow().combine_chunks()  # as many as a codebook has entries
    if not table.num_rows:
        return np.zeros((parts, 0, 0), np.int64)
    return _cut(whole_numbers(table.column("v").chunk(0), parts), parts)


SUMS = "part int, entry int, n long, total binary"
_SUMS = pa.schema(
    [("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("total", pa.binary())]
)


def _sums(held: dict[tuple[int, int], list]) -> pa.RecordBatch:
    rows = [(*key, n, total.tobytes()) for key, (n, total) in held.items()]
    return pa.RecordBatch.from_pydict(dict(zip(_SUMS.names, zip(*rows))), schema=_SUMS)


def _add(held: dict[tuple[int, int], list], key: tuple[int, int], n: int, total: np.ndarray) -> None:
    if key in held:
        held[key][0] += n
        held[key][1] = held[key][1] + total
    else:
        held[key] = [n, total]


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[int, int], list] = {}
    for batch in batches:
        for part, entry, n, total in zip(*(c.to_pylist() for c in batch.columns)):
            _add(held, (part, entry), n, np.frombuffer(total, np.int64))
    if held:
        yield _sums(held)


def moved_books(trees: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after a round: floors of means; entries that got nothing stay."""
    shared = trees.sparkSession.sparkContext.broadcast(books)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            for packed in batch.column(0):
                for part, (tree, book) in enumerate(zip(_trees(packed.as_py()), shared.value)):
                    _, counts, sums, _ = assigned(tree, book)
                    for entry in np.flatnonzero(counts).tolist():
                        _add(held, (part, entry), int(counts[entry]), sums[entry])
        if held:
            yield _sums(held)

    met = trees.select("trees").mapInArrow(look, SUMS).repartition("part", "entry").mapInArrow(_merge, SUMS)
    out = books.copy()
    for r in met.collect():  # as many as there are entries
        out[r.part, r.entry] = np.frombuffer(r.total, np.int64) // r.n
    return out


def learned_books(rows: DataFrame, trees: DataFrame, parts: int, entries: int, rounds: int) -> np.ndarray:
    books = first_books(rows, parts, entries)
    for _ in range(rounds if books.size else 0):
        books = moved_books(trees, books)
    return books


def coded(trees: DataFrame, books: np.ndarray) -> DataFrame:
    """``id, label, code, error`` of every vector; a code has a byte for each part."""
    shared = trees.sparkSession.sparkContext.broadcast(books)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, packed in enumerate(batch.column("trees")):
                codes, error = [], 0
                for tree, book in zip(_trees(packed.as_py()), shared.value):
                    to = assigned(tree, book)[0]
                    off = np.empty_like(tree.points)
                    off[tree.order] = tree.points
                    off -= book[to]
                    codes.append(to.astype(np.uint8))
                    error = error + (off * off).sum(axis=1)
                codes = np.stack(codes, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("ids").slice(i, 1).flatten(),
                        batch.column("labels").slice(i, 1).flatten(),
                        pa.array([c.tobytes() for c in codes], pa.binary()),
                        pa.array(error, pa.int64()),
                    ],
                    ["id", "label", "code", "error"],
                )

    schema = T.StructType()
    for name, column in (("id", "ids"), ("label", "labels")):
        schema = schema.add(name, trees.schema[column].dataType.elementType)
    return trees.mapInArrow(look, schema.add("code", "binary").add("error", "long"))


def decoded(code: bytes, books: np.ndarray) -> np.ndarray:
    """The vector that a code stands for."""
    return np.concatenate([book[i] for book, i in zip(books, code)]) / SCALE


def shown(books: np.ndarray) -> str:
    return ",".join(map(str, books.ravel().tolist()))


def compressed(
    vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2
) -> tuple[DataFrame, np.ndarray]:
    """``id, label, code, error`` of the vectors of a table (vec_id, embedding, label); the codebooks."""
    if not 0 < entries <= 256:
        raise ValueError("codes have a byte for each part, so 256 entries at most")
    rows = usable(vectors, label="label")
    trees = forest(rows, parts)
    books = learned_books(rows, trees, parts, entries, rounds)
    return kept_table(vectors.sparkSession, coded(trees, books), "codes"), books


def code_rows(vectors: DataFrame) -> DataFrame:
    """The contract's rows of a table of ``vec_id, embedding, label``."""
    found, books = compressed(vectors)
    by_label = found.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    by_label = kept_table(vectors.sparkSession, by_label, "label_errors")
    if by_label.count() <= FEW_LABELS:
        by_label = F.broadcast(by_label)
    digest = hashlib.sha256(shown(books).encode()).hexdigest()
    return found.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(
        F.col("id").alias("vec_id"),
        F.lower(F.hex("code")).alias("code"),
        "error",
        "label_error",
        F.lit(digest).alias("codebooks_sha256"),
    )
