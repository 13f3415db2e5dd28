"""Removal of every byte covered by a long string that also starts elsewhere.

Sorting all suffixes of all documents would move each text some hundred times, so suffixes that
cannot repeat are left out first, by their own content. The anchor of a window (a string of
``length`` bytes) is the place of its least hash of ``GRAM`` bytes, the leftmost of equals. Equal
windows have equal anchors at the same offset, and neighbouring windows mostly share theirs, so
a document falls into segments of starts with one anchor, of about half a window each. A segment
whose anchor's bytes occur once in the corpus has nothing that repeats.

1. Anchors are counted by hash, with partial sums before the shuffle. Those that occur again are
   marked in a bitmap of bounded size; a false mark costs work, never a result.
2. Segments with a marked anchor are dealt to ranges of their leading bytes (those of the
   anchor), by splitters from a sample of the marked. Equal anchors fall into one range, so two
   suffixes of a window's length never stand on different sides of a splitter; there is nothing
   left to compare across one.
3. Within a range, the suffixes at all starts of the segments of one anchor are sorted by
   multikey quicksort: by eight bytes at a time, each time within groups still equal, leaving
   groups of one. What is left after the last eight bytes repeats. The bytes decide, no hash.
4. An anchor may be in a third of all documents. From ``HOT`` occurrences on, its segments are
   not gathered. Their windows are compared by two hashes of 64 bits each: first where they
   are, batch by batch, which settles what repeats within one; then each batch sends a window
   once at most, to the part its hash falls in. So a window of any number of copies reaches a
   part no more often than there are batches, and there are as many parts as windows need.
5. Spans go back to their documents, which cut them out.

Matches never cross documents. Windows are judged on the input, whatever else is removed.

Defined results: a null text is empty; a text shorter than a window loses nothing; repeated rows
are documents that repeat each other; a null id is an id like any other; an empty table gives
none; further columns are ignored.
"""

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventfold.llm.bitmaps import bitmap_of, marked, no_marks
from eventfold.llm.common import kept_table, row_key, whole

GRAM = 32
HOT = 4_096
SLICE = 1 << 19  # starts looked at together
SORTED_AT_ONCE = 1 << 19  # suffixes
WINDOWS_AT_ONCE = 1 << 19  # of hot anchors, compared in a batch
WINDOWS_OF_PART = 1 << 21  # and about as many in a part, of 40 bytes each
SAMPLE = 100_000  # leading bytes that splitters are drawn from
OUT_BYTES = 8 << 20
GIVEN_AT_ONCE = 20_000

_numbers = np.random.default_rng(20).integers(0, 2**64, (3, 256), dtype=np.uint64)
STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((32, 0xBF58476D1CE4E5B9), (29, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(32))


def _rolling(data: np.ndarray, width: int, numbers: np.ndarray, step: int) -> np.ndarray:
    """A 64-bit hash of every ``width`` bytes, put together from powers of two."""
    power, factor = numbers[data], step
    out, done = None, 0
    size = 1
    while True:
        if width & size:
            if out is None:
                out = power
            else:
                n = len(power) - done
                out = out[:n] * np.uint64(factor) + power[done : done + n]
            done += size
        if done == width:
            return _mixed(out)
        n = len(power) - size
        power = power[:n] * np.uint64(factor) + power[size:]
        factor = factor * factor % 2**64
        size *= 2


def window_hashes(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of every window."""
    return tuple(
        _rolling(data, length, _numbers[k], s)
        for k, s in ((1, 0xD1342543DE82EF95), (2, 0xA0761D6478BD642F))
    )


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, by least values up to and from block borders."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def segments(data: bytes, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of window starts with one anchor: ``first, last, anchor, gram`` arrays, by slices."""
    width = length - GRAM + 1
    for begin in range(0, len(data) - length + 1, SLICE):
        part = np.frombuffer(data[begin : begin + SLICE + length - 1], np.uint8)
        grams = _rolling(part, GRAM, _numbers[0], int(STEP))
        places = np.arange(len(grams), dtype=np.uint64)
        keys = (grams & np.uint64(0xFFFFFFFF00000000)) | places
        anchors = (_least(keys, width) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.flatnonzero(np.diff(anchors, prepend=-1))
        last = np.append(new[1:], len(anchors)) - 1
        anchor = anchors[new]
        yield new + begin, last + begin, anchor + begin, grams[anchor]


def anchor_counts(docs: DataFrame, length: int) -> DataFrame:
    """``gram, lead, times`` of anchors that occur again; ``lead`` is their first eight bytes."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, leads = [], []
            for text in batch.column(0).to_pylist():
                data = text.encode()
                for _, _, anchor, gram in segments(data, length):
                    grams.append(gram)
                    raw = np.frombuffer(data, np.uint8)
                    leads.append(raw[anchor[:, None] + np.arange(8)].copy().view(">u8").ravel())
            if grams:
                gram, lead = np.concatenate(grams), np.concatenate(leads).astype(np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram.view(np.int64)), pa.array(lead.view(np.int64))], ["gram", "lead"]
                )

    rows = docs.select(whole().alias("text")).where(F.octet_length("text") >= length)
    counted = rows.mapInArrow(look, "gram long, lead long").groupBy("gram")
    counted = counted.agg(F.count(F.lit(1)).alias("times"), F.min("lead").alias("lead"))
    return kept_table(docs.sparkSession, counted.where("times > 1"), "anchors")


def _splitters(anchors: DataFrame, ranges: int) -> list[bytes]:
    """Borders of ranges of leading bytes, hashes of equal ones beside them, from a sample."""
    some = anchors.sample(fraction=min(1.0, SAMPLE / max(1, anchors.count())), seed=7)
    found = some.select("lead", "gram").toArrow()
    leads, grams = (found.column(c).to_numpy().view(np.uint64) for c in ("lead", "gram"))
    keys = sorted(_key(lead, gram) for lead, gram in zip(leads.tolist(), grams.tolist()))
    return [keys[len(keys) * i // ranges] for i in range(1, ranges)] if keys else []


def _key(lead: int, gram: int) -> bytes:
    return lead.to_bytes(8, "big") + gram.to_bytes(8, "big")


def repeated_starts(data: np.ndarray, starts: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Which windows equal another of their group: multikey quicksort, eight bytes a key.

    ``data`` must have eight bytes beyond the last window.
    """
    words = np.zeros(len(data) - 7, np.uint64)
    for k in range(8):
        words = (words << np.uint64(8)) | data[k : len(data) - 7 + k]
    alive = np.argsort(group, kind="stable")
    groups = group[alive]
    offsets = [*range(0, length - 7, 8)] + ([length - 8] if length % 8 else [])
    for offset in [None, *offsets]:
        if offset is not None:
            key = words[starts[alive] + offset]
            first = np.flatnonzero(np.diff(groups, prepend=groups[0] - 1 if len(groups) else 0))
            sizes = np.diff(np.append(first, len(groups)))
            if (key == np.repeat(key[first], sizes)).all():
                continue
            order = np.lexsort((key, groups))
            alive, groups, key = alive[order], groups[order], key[order]
            new = np.ones(len(alive), bool)
            new[1:] = (groups[1:] != groups[:-1]) | (key[1:] != key[:-1])
        else:
            new = np.ones(len(alive), bool)
            new[1:] = groups[1:] != groups[:-1]
        groups = np.cumsum(new)
        several = np.bincount(groups, minlength=1)[groups] > 1
        alive, groups = alive[several], groups[several]
        if not len(alive):
            break
    found = np.zeros(len(starts), bool)
    found[alive] = True
    return found


def runs(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Bytes covered by windows at these ascending starts, as separate runs."""
    if not len(starts):
        return []
    gap = np.flatnonzero(np.diff(starts) > length)
    first, last = starts[np.append(0, gap + 1)], starts[np.append(gap, len(starts) - 1)]
    return list(zip(first.tolist(), (last + length).tolist()))


SPANS = pa.schema([("kid", pa.int64()), ("kth", pa.int64()), ("b", pa.int64()), ("e", pa.int64())])
SPANS_DDL = "kid long, kth long, b long, e long"
SEGMENTS = pa.schema(
    [("bucket", pa.int32()), ("lead", pa.binary()), ("seg", pa.binary()), ("kid", pa.int64())]
    + [("kth", pa.int64()), ("first", pa.int64()), ("at", pa.int32()), ("data", pa.binary())]
)
SEGMENTS_DDL = (
    "bucket int, lead binary, seg binary, kid long, kth long, first long, at int, data binary"
)


def marked_segments(
    docs: DataFrame, length: int, marks: np.ndarray, hot: np.ndarray, splitters: list[bytes]
) -> DataFrame:
    """Segments whose anchor is marked and not hot, with their bytes once per batch."""
    shared = docs.sparkSession.sparkContext.broadcast((marks, hot, splitters))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, hot, splitters = shared.value
        out, seen = [], set()
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("kid", "kth", "text"))
            for kid, kth, text in zip(*columns):
                data = text.encode()
                for first, last, anchor, gram in segments(data, length):
                    some = np.flatnonzero(marked(gram, marks) & ~marked(gram, hot))
                    for i in some.tolist():
                        b, a = int(first[i]), int(anchor[i])
                        own = data[b : int(last[i]) + length]
                        key = data[a : a + 8] + int(gram[i]).to_bytes(8, "big")
                        seg = xxhash.xxh3_128_digest(own)
                        bucket = bisect.bisect_right(splitters, key)
                        out.append((bucket, key, seg, kid, kth, b, a - b, None if seg in seen else own))
                        seen.add(seg)
                        if len(out) >= GIVEN_AT_ONCE:
                            yield pa.RecordBatch.from_pydict(
                                dict(zip(SEGMENTS.names, zip(*out))), schema=SEGMENTS
                            )
                            out, seen = [], set()
        if out:
            yield pa.RecordBatch.from_pydict(dict(zip(SEGMENTS.names, zip(*out))), schema=SEGMENTS)

    rows = docs.select(*row_key(), whole().alias("text")).where(F.octet_length("text") >= length)
    return rows.mapInArrow(look, SEGMENTS_DDL)


def _sorted_spans(length: int):
    """Segments in order of their anchors to the spans that repeat."""

    def spans(held: list[tuple]) -> pa.RecordBatch | None:
        """Of whole groups of segments; a segment is ``lead, seg, kid, kth, first, at, data``."""
        distinct: dict[tuple, list] = {}
        for lead, seg, kid, kth, first, at, data in held:
            known = distinct.setdefault((lead, seg), [at, None, 0])
            known[1] = known[1] or data
            known[2] += 1
        leads: dict[bytes, int] = {}
        for lead, _ in distinct:
            leads[lead] = leads.get(lead, 0) + 1
        compared = [k for k in distinct if leads[k[0]] > 1]
        found: dict[tuple, list] = {}
        if compared:
            number = {lead: i for i, lead in enumerate(leads)}
            sizes = [len(distinct[k][1]) for k in compared]
            counts = np.array(sizes) - length + 1
            base = np.cumsum([0, *sizes[:-1]])
            data = np.frombuffer(b"".join([*(distinct[k][1] for k in compared), bytes(8)]), np.uint8)
            own = np.repeat(np.arange(len(compared)), counts)
            offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            # equal windows have their anchor at one offset
            ahead = np.array([distinct[k][0] for k in compared])[own] - offset
            group = np.array([number[k[0]] for k in compared], np.int64)[own] * length + ahead
            again = repeated_starts(data, base[own] + offset, group, length)
            ends = np.cumsum(counts)
            for k, end, count in zip(compared, ends, counts):
                found[k] = runs(np.flatnonzero(again[end - count : end]), length)
        out = []
        for lead, seg, kid, kth, first, _, _ in held:
            _, data, times = distinct[lead, seg]
            for b, e in [(0, len(data))] if times > 1 else found.get((lead, seg), ()):
                out.append((kid, kth, first + b, first + e))
        return pa.RecordBatch.from_pydict(dict(zip(SPANS.names, zip(*out))), schema=SPANS) if out else None

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        names = ("lead", "seg", "kid", "kth", "first", "at", "data")
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in names)):
                if size >= SORTED_AT_ONCE and row[0] != held[-1][0]:
                    if (out := spans(held)) is not None:
                        yield out
                    held, size = [], 0
                held.append(row)
                size += max(1, len(row[-1] or b"") - length + 1)
        if held and (out := spans(held)) is not None:
            yield out

    return look


WINDOWS = pa.schema([("part", pa.int32()), *SPANS, ("packed", pa.binary())])
WINDOWS_DDL = f"part int, {SPANS_DDL}, packed binary"


def _repeats(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that puts equal hashes together, which of it are first, and how many are equal."""
    order = np.lexsort((two, one))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(one[order].view(np.int64)) != 0) | (np.diff(two[order].view(np.int64)) != 0)
    sizes = np.diff(np.append(np.flatnonzero(new), len(order)))
    return order, new, np.repeat(sizes, sizes)


def _spans_of(kid: np.ndarray, kth: np.ndarray, start: np.ndarray, length: int) -> list[tuple]:
    """The spans of windows at these starts, by document."""
    order = np.lexsort((start, kth, kid))
    kid, kth, start = kid[order], kth[order], start[order]
    edges = np.flatnonzero((np.diff(kid) != 0) | (np.diff(kth) != 0)) + 1
    out = []
    for b, e in zip([0, *edges.tolist()], [*edges.tolist(), len(start)]):
        if e > b:
            out += [(int(kid[b]), int(kth[b]), *span) for span in runs(start[b:e], length)]
    return out


def hot_spans(docs: DataFrame, length: int, hot: np.ndarray, parts: int) -> DataFrame:
    """Spans of the windows of hot anchors that occur again."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(hot)

    def settled(held: list[tuple]) -> pa.RecordBatch:
        """What repeats in a batch, as spans; each of its windows once, dealt to parts."""
        one, two, kid, kth, start = (np.concatenate(x) for x in zip(*held))
        order, new, sizes = _repeats(one, two)
        again = order[sizes > 1]
        rows = [(None, *x, None) for x in _spans_of(kid[again], kth[again], start[again], length)]
        first, alone = order[new], sizes[new] == 1
        table = np.stack(
            [one[first].view(np.int64), two[first].view(np.int64), kid[first], kth[first]]
            + [np.where(alone, start[first], -1)]  # no start: it is settled here
        )
        part = (one[first] % np.uint64(parts)).astype(np.int64)
        for p in range(parts):
            own = table[:, part == p]
            if own.size:
                rows.append((p, None, None, None, None, own.tobytes()))
        return pa.RecordBatch.from_pydict(dict(zip(WINDOWS.names, zip(*rows))), schema=WINDOWS)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, held, size = shared.value, [], 0
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("kid", "kth", "text"))
            for kid, kth, text in zip(*columns):
                data = text.encode()
                for first, last, _, gram in segments(data, length):
                    for i in np.flatnonzero(marked(gram, hot)).tolist():
                        b, n = int(first[i]), int(last[i] - first[i]) + 1
                        own = np.frombuffer(data[b : b + n + length - 1], np.uint8)
                        keys = np.full(n, kid, np.int64), np.full(n, kth, np.int64)
                        held.append((*window_hashes(own, length), *keys, np.arange(b, b + n)))
                        size += n
                        if size >= WINDOWS_AT_ONCE:
                            yield settled(held)
                            held, size = [], 0
        if held:
            yield settled(held)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for part, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(part, []).append(np.frombuffer(packed, np.int64).reshape(5, -1))
        for part in list(held):
            one, two, kid, kth, start = np.concatenate(held.pop(part), axis=1)
            order, new, sizes = _repeats(one.view(np.uint64), two.view(np.uint64))
            of = np.cumsum(new) - 1
            known = np.bincount(of, weights=start[order] < 0)[of] > 0
            again = order[((sizes > 1) | known) & (start[order] >= 0)]
            if rows := _spans_of(kid[again], kth[again], start[again], length):
                yield pa.RecordBatch.from_pydict(dict(zip(SPANS.names, zip(*rows))), schema=SPANS)

    rows = docs.select(*row_key(), whole().alias("text")).where(F.octet_length("text") >= length)
    dealt = kept_table(spark, rows.mapInArrow(deal, WINDOWS_DDL), "windows")
    sent = dealt.where("packed IS NOT NULL").select("part", "packed").repartition("part")
    here = dealt.where("packed IS NULL").select(*SPANS.names)
    return here.unionAll(sent.mapInArrow(meet, SPANS_DDL))


def repeated_spans(docs: DataFrame, length: int, hot_from: int = HOT) -> DataFrame:
    """``kid, kth, b, e``: bytes of documents covered by windows that occur again."""
    spark = docs.sparkSession
    anchors = anchor_counts(docs, length)
    counts = anchors.agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("times") >= hot_from, 1)).alias("hot"),
        F.sum(F.when(F.col("times") >= hot_from, F.col("times"))).alias("segments"),
    ).first()
    marks = bitmap_of(anchors.select("gram"), counts.n)
    hot_anchors = anchors.where(F.col("times") >= hot_from).select("gram")
    hot = bitmap_of(hot_anchors, counts.hot) if counts.hot else no_marks()
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = marked_segments(docs, length, marks, hot, _splitters(anchors, ranges))
    dealt = found.repartition("bucket").sortWithinPartitions("bucket", "lead", "seg")
    spans = dealt.drop("bucket").mapInArrow(_sorted_spans(length), SPANS_DDL)
    if not counts.hot:
        return spans
    parts = 1 + counts.segments * length // 2 // WINDOWS_OF_PART
    return spans.unionAll(hot_spans(docs, length, hot, parts))


def joined_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that overlap or touch, as one."""
    out: list[tuple[int, int]] = []
    for b, e in sorted(spans):
        if out and b <= out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((b, e))
    return out


def without_repeats(
    docs: DataFrame, length: int, with_row: bool = False, hot_from: int = HOT
) -> DataFrame:
    """``doc_id, n_bytes, spans, kept`` of each row of ``docs`` (doc_id, text).

    ``spans`` are the removed runs of bytes (``b`` to ``e``), ``kept`` the bytes that remain.
    ``with_row`` adds the row's other columns as a struct, ``row``.
    """
    found = repeated_spans(docs, length, hot_from).groupBy("kid", "kth")
    # a set: rows that repeat each other give each span as often as there are of them
    found = found.agg(F.collect_set(F.struct("b", "e")).alias("found"))
    names = ["doc_id", *(["row"] if with_row else [])]
    rest = F.struct(*(c for c in docs.columns if c != "text")).alias("row")
    rows = docs.select("doc_id", *([rest] if with_row else []), *row_key(), whole().alias("text"))
    joined = rows.join(found, ["kid", "kth"], "left").select(*names, "text", "found")
    spans_type = pa.list_(pa.struct([("b", pa.int64()), ("e", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, spans, kept = [], [], []
            for text, found in zip(*(batch.column(c).to_pylist() for c in ("text", "found"))):
                data = text.encode()
                own = joined_spans([(x["b"], x["e"]) for x in found or ()])
                edges = [0, *(x for span in own for x in span), len(data)]
                sizes.append(len(data))
                spans.append([{"b": b, "e": e} for b, e in own])
                kept.append(b"".join(data[b:e] for b, e in zip(edges[::2], edges[1::2])))
            values = [batch.column(n) for n in names] + [pa.array(sizes, pa.int64())]
            values += [pa.array(spans, spans_type), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(values, [*names, "n_bytes", "spans", "kept"])

    span = T.StructType().add("b", "long").add("e", "long")
    schema = joined.select(*names).schema.add("n_bytes", "long")
    schema = schema.add("spans", T.ArrayType(span)).add("kept", "binary")
    return joined.mapInArrow(cut, schema)


def text_of(kept: str = "kept"):
    """What remains as text; a character that lost some of its bytes goes with them."""

    @F.pandas_udf("string")
    def decoded(parts: pd.Series) -> pd.Series:
        return parts.map(lambda b: bytes(b).decode("utf-8", "ignore"))

    return decoded(kept)
