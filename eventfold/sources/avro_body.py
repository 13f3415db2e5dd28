"""Avro bodies from and to Arrow columns, a whole batch of rows at a time.

Reading moves all rows of a batch in step: one cursor per row into the batch's value
buffer, advanced by numpy. A row that does not hold what its type asks for turns bad
and is left out of the further steps. Writing makes a piece of bytes per field, each
with its size per row, and puts the pieces of a row next to each other.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from eventfold.schemas import COLUMN_OF, NULLABLE, TYPE_OF


class _Rows:
    """Cursors of the rows being read; ``bad`` marks those that failed."""

    def __init__(self, data, start, end, bad=None):
        self.data, self.pos, self.end = data, start.copy(), end
        self.bad = np.zeros(len(start), bool) if bad is None else bad

    def fail(self, rows):
        self.bad[rows] = True

    def alive(self, rows):
        return rows[~self.bad[rows]]


def _read_bytes(state, rows):
    """One byte of each row, 0 where there is none left (the row turns bad)."""
    out = np.zeros(len(rows), np.uint8)
    there = state.pos[rows] < state.end[rows]
    state.fail(rows[~there])
    out[there] = state.data[state.pos[rows[there]]]
    state.pos[rows[there]] += 1
    return out


def _read_longs(state, rows):
    """A zig-zag varint of each row, aligned with ``rows``."""
    value = np.zeros(len(rows), np.uint64)
    open_ = np.flatnonzero(~state.bad[rows])
    for shift in range(0, 70, 7):
        if not len(open_):
            break
        byte = _read_bytes(state, rows[open_])
        value[open_] |= (byte & 0x7F).astype(np.uint64) << np.uint64(shift)
        open_ = open_[(byte & 0x80 != 0) & ~state.bad[rows[open_]]]
    state.fail(rows[open_])  # more than ten bytes
    return (value >> np.uint64(1)).astype(np.int64) ^ -(value & np.uint64(1)).astype(np.int64)


def _gather(data, start, size):
    """Concatenate the given slices of ``data``; returns (bytes, offsets)."""
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    index = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)
    return data[index], offsets


def _read_strings(state, rows):
    size = _read_longs(state, rows)
    wrong = (size < 0) | (size > state.end[rows] - state.pos[rows])
    state.fail(rows[wrong])
    size = np.where(state.bad[rows], 0, size)
    raw, offsets = _gather(state.data, state.pos[rows], size)
    state.pos[rows] += size
    binary = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(raw.tobytes())]
    )
    try:
        return binary.cast(pa.string())
    except pa.ArrowInvalid:  # malformed UTF-8 reads as replacement characters
        return pa.array([b.decode("utf-8", "replace") for b in binary.to_pylist()], pa.string())


def _read_booleans(state, rows):
    byte = _read_bytes(state, rows)
    state.fail(rows[byte > 1])
    return pa.array(byte == 1)


def _read_arrays(state, rows, item_type):
    """Blocks of items until an empty one; a negative count is followed by a byte size."""
    owner, parts = [], []
    open_ = np.arange(len(rows))
    while len(open_):
        count = _read_longs(state, rows[open_])
        sized = count < 0
        _read_longs(state, rows[open_[sized]])
        count = np.abs(count)
        # an item takes at least a byte, which bounds the count
        too_many = count > state.end[rows[open_]] - state.pos[rows[open_]]
        state.fail(rows[open_[too_many]])
        more = (count > 0) & ~state.bad[rows[open_]]
        open_, count = open_[more], count[more]
        left, taken = open_, 0
        while len(left):
            parts.append(_read(state, rows[left], item_type))
            owner.append(left)
            taken += 1
            left = open_[(count > taken) & ~state.bad[rows[open_]]]
        open_ = open_[~state.bad[rows[open_]]]
    owner = np.concatenate(owner) if owner else np.zeros(0, np.int64)
    by_row = np.argsort(owner, kind="stable")
    arrow_type = to_arrow_type(item_type)
    items = pa.concat_arrays([p.cast(arrow_type) for p in parts]) if parts else pa.array([], arrow_type)
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum(np.bincount(owner, minlength=len(rows)), out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), items.take(pa.array(by_row)))


def _read_optional(state, rows, data_type):
    """A union of null and a type: branch 0 or 1, then the value."""
    branch = _read_longs(state, rows)
    state.fail(rows[(branch < 0) | (branch > 1)])
    present = np.flatnonzero((branch == 1) & ~state.bad[rows])
    values = _read(state, rows[present], data_type)
    index = np.full(len(rows), -1)
    index[present] = np.arange(len(present))
    return values.take(pa.array(index, mask=index < 0))


def _read(state, rows, data_type, nullable=False):
    """A value of each row as an Arrow array aligned with ``rows``."""
    if nullable:
        return _read_optional(state, rows, data_type)
    if isinstance(data_type, T.StringType):
        return _read_strings(state, rows)
    if isinstance(data_type, T.LongType):
        return pa.array(_read_longs(state, rows))
    if isinstance(data_type, T.BooleanType):
        return _read_booleans(state, rows)
    if isinstance(data_type, T.ArrayType):
        return _read_arrays(state, rows, data_type.elementType)
    kind = next(kind for kind, record in TYPE_OF.items() if record == data_type)
    optional = NULLABLE.get(kind, ())
    arrays = [
        _read(state, rows, f.dataType, f.name in optional).cast(to_arrow_type(f.dataType))
        for f in data_type
    ]
    return pa.StructArray.from_arrays(arrays, names=data_type.names)


def _body(values, rows, record, header_bytes):
    """Read the given rows of a binary column; returns (structs, which rows are bad)."""
    values = values.cast(pa.large_binary()).take(pa.array(rows))
    raw = values.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw else np.zeros(0, np.uint8)
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(rows) + 1]
    state = _Rows(data, offsets[:-1] + header_bytes, offsets[1:])
    return _read(state, np.arange(len(rows)), record), state.bad


def _scatter(values, rows, bad, size):
    """Place the good ones of ``values`` at ``rows`` of an array of ``size``, else null."""
    index = np.full(size, -1)
    index[rows[~bad]] = np.flatnonzero(~bad)
    return values.take(pa.array(index, mask=index < 0))


def body_reader(kinds, header_bytes):
    """For ``mapInArrow`` over ``key, seq, kind, value, reject_reason``."""

    def read(batches):
        for batch in batches:
            kind = batch.column("kind").to_numpy(zero_copy_only=False)
            accepted = batch.column("reject_reason").is_null().to_numpy(zero_copy_only=False)
            reason = batch.column("reject_reason").to_numpy(zero_copy_only=False).astype(object)
            columns = {}
            for name in kinds:
                rows = np.flatnonzero(accepted & (kind == name))
                record = TYPE_OF[name]
                if len(rows):
                    values, bad = _body(batch.column("value"), rows, record, header_bytes)
                    reason[rows[bad]] = "bad_body"
                    columns[COLUMN_OF[name]] = _scatter(values, rows, bad, len(kind))
                else:
                    columns[COLUMN_OF[name]] = pa.nulls(len(kind), to_arrow_type(record))
            yield pa.RecordBatch.from_pydict(
                {
                    "key": batch.column("key"),
                    "seq": batch.column("seq"),
                    "kind": batch.column("kind"),
                    **columns,
                    "reject_reason": pa.array(reason, pa.string()),
                }
            )

    return read


# --- writing: a piece is (bytes, size per row) --------------------------------------------


def _long_piece(values):
    """Zig-zag varints: seven bits a byte, the high bit set on all but the last."""
    values = np.asarray(values, np.int64)
    zigzag = ((values << 1) ^ (values >> 63)).astype(np.uint64)
    shifts = np.arange(10, dtype=np.uint64) * np.uint64(7)
    rest = zigzag[:, None] >> shifts
    size = np.maximum((rest != 0).sum(axis=1), 1)
    nth = np.arange(10)
    byte = (rest & np.uint64(0x7F)).astype(np.uint8)
    byte |= np.where(nth < size[:, None] - 1, 0x80, 0).astype(np.uint8)
    return byte[nth < size[:, None]], size


def _string_piece(values):
    binary = values.cast(pa.large_string()).cast(pa.large_binary())
    offsets = np.frombuffer(binary.buffers()[1], np.int64)[binary.offset :][: len(binary) + 1]
    raw = binary.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw else np.zeros(0, np.uint8)
    size = np.diff(offsets)
    return _joined([_long_piece(size), (data[offsets[0] : offsets[-1]], size)])


def _array_piece(values, item_type):
    """One block of all items and an empty one; an empty list is just the latter."""
    count = values.value_lengths().to_numpy()
    item_bytes, item_size = _piece(values.flatten(), item_type)
    ends = np.concatenate([[0], np.cumsum(item_size)])[np.concatenate([[0], np.cumsum(count)])]
    counts, count_size = _long_piece(count)
    filled = np.repeat(count > 0, count_size)
    return _joined(
        [
            (counts[filled], np.where(count > 0, count_size, 0)),
            (item_bytes, np.diff(ends)),
            (np.zeros(len(count), np.uint8), np.ones(len(count), np.int64)),
        ]
    )


def _optional_piece(values, data_type):
    present = values.is_valid().to_numpy(zero_copy_only=False)
    branch = np.where(present, 2, 0).astype(np.uint8)  # varint of branch 1 or 0
    data, present_size = _piece(values.take(pa.array(np.flatnonzero(present))), data_type)
    size = np.zeros(len(present), np.int64)
    size[present] = present_size
    return _joined([(branch, np.ones(len(present), np.int64)), (data, size)])


def _piece(values, data_type, nullable=False):
    if nullable:
        return _optional_piece(values, data_type)
    if values.null_count:
        raise ValueError("a required field is null")
    if isinstance(data_type, T.StringType):
        return _string_piece(values)
    if isinstance(data_type, T.LongType):
        return _long_piece(values.to_numpy())
    if isinstance(data_type, T.BooleanType):
        return values.to_numpy(zero_copy_only=False).astype(np.uint8), np.ones(len(values), np.int64)
    if isinstance(data_type, T.ArrayType):
        return _array_piece(values, data_type.elementType)
    kind = next(kind for kind, record in TYPE_OF.items() if record == data_type)
    optional = NULLABLE.get(kind, ())
    fields = zip(data_type, values.flatten())
    return _joined([_piece(column, f.dataType, f.name in optional) for f, column in fields])


def _joined(pieces):
    """Put the pieces of each row next to each other."""
    sizes = np.stack([size for _, size in pieces], axis=1)
    ends = np.cumsum(sizes).reshape(sizes.shape)
    out = np.empty(ends[-1, -1] if len(ends) else 0, np.uint8)
    for j, (data, size) in enumerate(pieces):
        # shift from a byte's place in its piece to its place in the row
        shift = (ends[:, j] - size) - (np.cumsum(size) - size)
        out[np.arange(len(data)) + np.repeat(shift, size)] = data
    return out, sizes.sum(axis=1)


def _framed(header, values, record):
    """Frames of a struct column as a binary array."""
    n = len(values)
    head = np.tile(np.frombuffer(header, np.uint8), n), np.full(n, len(header))
    data, size = _joined([head, _piece(values, record)])
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, buffers)


def body_writer(headers):
    """For ``mapInArrow`` over ``key, seq, kind`` and a struct column per kind of ``headers``."""

    def write(batches):
        for batch in batches:
            kind = batch.column("kind").to_numpy(zero_copy_only=False)
            index = np.full(len(kind), -1)
            parts, done = [], 0
            for name, header in headers.items():
                rows = np.flatnonzero(kind == name)
                if len(rows):
                    structs = batch.column(COLUMN_OF[name]).take(pa.array(rows))
                    parts.append(_framed(header, structs, TYPE_OF[name]))
                    index[rows] = done + np.arange(len(rows))
                    done += len(rows)
            frames = pa.concat_arrays(parts) if parts else pa.nulls(0, pa.large_binary())
            value = frames.take(pa.array(index, mask=index < 0)).cast(pa.binary())
            yield pa.RecordBatch.from_pydict(
                {"key": batch.column("key"), "seq": batch.column("seq"), "value": value}
            )

    return write
