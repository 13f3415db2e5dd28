"""Byte-level BPE encoding and decoding.

A text is cut into words by a pattern; each word's bytes are merged pair by pair, the pair of
lowest rank first, the leftmost of equals. The merging runs on distinct words only, as a fold of
Spark's higher-order functions: the state is a number for each pair of neighbours, made of its
rank and its place, a step merges the least and ranks the two pairs beside it, in a literal rank map.
The map is a literal array of small maps, found by hash, as Spark looks a map's keys up one by one.

Texts are not exploded, and nothing but words of the sample is shuffled. Words that are frequent in
a bounded sample are folded first, and their codes are broadcast. One pass then turns texts into
codes and a list of the distinct words it could not find, for some documents at a time; a fold over
that list gives their ids where they stand, and a second pass joins the ids of the words and the
bytes of the ids, by numpy for a whole stretch of documents. A word that is
not frequent is so folded once for each stretch of ``STRETCH`` words that has it: 1.02 times as often
as once in all on 60 MB of text (not measured on more, where it may rise). That spares a shuffle of
every text's codes.

Words of more than ``LONG`` bytes would take the fold a number of steps that is quadratic in
their length; they are merged with a heap instead, to the same ids.

Defined results: a null text is empty and has no ids; a null id is an id like any other; repeated
rows each give a row; an empty table gives none; a byte without a rank is an error; further
columns are ignored.
"""

import base64
import functools
import heapq
import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventfold.llm.common import bounded_sample, give_back, once, whole

# Documented bounds: rows of the sample, words whose codes are broadcast, their bytes.
SAMPLE_ROWS = 32_768
FREQUENT = 262_144
WORD_BYTES = 64
LONG = 512
STRETCH = 200_000  # words of documents that are coded together, if one has no more itself
JOINED_AT_ONCE = 1 << 18
BUCKETS = 16_384
FIELD = 10  # bits of a place in a word that is folded, one of 0 to LONG
NONE = 2**31 - 1
GONE = 2**62
PLAN_TEXT = 20_000


@functools.lru_cache(maxsize=2)
def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a ``.tiktoken`` file; ids are ranks."""
    with open(path, "rb") as file:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, file.read().splitlines())}


def checked_ranks(path: str) -> dict[bytes, int]:
    """The ranks, if every byte has one."""
    ranks = read_ranks(path)
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("the ranks lack single bytes")
    return ranks


def rank_map(ranks: dict[bytes, int]) -> Column:
    """A literal array of maps, from bytes (as Latin-1 text) to rank, above the bits of a pair's bounds."""
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for token, rank in ranks.items():
        text = token.decode("latin-1")
        buckets[xxhash.xxh64_intdigest(text.encode(), 42) % BUCKETS][text] = rank << 3 * FIELD
    return F.from_json(F.lit(json.dumps(buckets)), "array<map<string,bigint>>")


def folded(words: Column, ranks: Column) -> Column:
    """The ids of each of an array of words given as text; null for those above ``LONG`` bytes.

    The state of the fold is an array with a number for each byte. Where a token begins, it is made
    of the rank of the pair of that token and the next, ``NONE`` if there is none, then where the token
    begins, where the one before it does, and where it ends; elsewhere it is ``GONE``. So the least number
    is the pair to merge, the leftmost of equals, and tells its place: nothing is searched for, as
    Spark's ``array_position`` ends each search by an exception. A step renews the numbers of the
    pair, of its two neighbours, and of the token taken in; all others stay as they are. The rank map
    is in the plan once, bound to a name, as it is large.
    """
    return once(
        ranks,
        lambda known: F.transform(
            words, lambda w: F.when(F.octet_length(w) <= LONG, _folded(w, known))
        ),
    )


def _folded(word: Column, known: Column) -> Column:
    chars = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")
    none, gone = F.lit(NONE << 3 * FIELD), F.lit(GONE)

    def rank(token: Column) -> Column:
        at = F.xxhash64(token).bitwiseAND(BUCKETS - 1).cast("int")
        return F.coalesce(F.element_at(F.get(known, at), token), none)

    def between(w: Column, begin: Column, end: Column) -> Column:
        return rank(F.substring(w, begin + 1, end - begin))

    def field(number: Column, k: int) -> Column:
        return F.shiftright(number, k * FIELD).bitwiseAND((1 << FIELD) - 1).cast("int")

    def number(rank: Column, begin: Column, before: Column, end: Column) -> Column:
        begin, before = (F.shiftleft(x.cast("long"), k * FIELD) for x, k in ((begin, 2), (before, 1)))
        return rank.bitwiseOR(begin).bitwiseOR(before).bitwiseOR(end.cast("long"))

    def renewed(w: Column, pairs: Column, x: Column) -> Column:
        before, begin, middle, end = (x[c] for c in ("before", "begin", "middle", "end"))
        after = field(F.get(pairs, end), 0)
        # branches are worked out where they hold: each of the two ranks once
        return F.transform(
            pairs,
            lambda p, at: F.when((at < before) | (at > end), p)
            .when(at == begin, number(between(w, begin, after), begin, before, end))
            .when(at == before, between(w, before, end).bitwiseOR(p.bitwiseAND((1 << 3 * FIELD) - 1)))
            .when(at == end, p - F.shiftleft((middle - begin).cast("long"), FIELD))
            .otherwise(gone),
        )

    def step(w: Column, pairs: Column) -> Column:
        def merged(least: Column) -> Column:
            middle = field(least, 0)
            places = F.struct(
                field(least, 1).alias("before"),
                field(least, 2).alias("begin"),
                middle.alias("middle"),
                field(F.get(pairs, middle), 0).alias("end"),
            )
            return F.when(least < none, once(places, lambda x: renewed(w, pairs, x))).otherwise(pairs)

        return once(F.array_min(pairs), merged)

    def ids(w: Column) -> Column:
        last = F.length(w) - 1
        begin = F.transform(
            F.sequence(F.lit(0), last),
            lambda i: number(
                F.when(i < last, between(w, i, i + 2)).otherwise(none),
                i,
                F.greatest(i - 1, F.lit(0)),
                i + 1,
            ),
        )
        pairs = F.aggregate(F.sequence(F.lit(1), last), begin, lambda pairs, _: step(w, pairs))
        tokens = F.filter(pairs, lambda p: p < gone)
        return F.transform(tokens, lambda p: id_of(between(w, field(p, 2), field(p, 0))))

    def id_of(rank: Column) -> Column:
        return F.shiftright(rank, 3 * FIELD).cast("int")

    # a word of one byte has a rank, as every byte does
    whole_word = lambda w: once(
        rank(w), lambda r: F.when(r < none, F.array(id_of(r))).otherwise(ids(w))
    )
    return once(chars, whole_word)


def merged_with_heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a word of any length, in time ``n log n``."""
    if word in ranks:
        return [ranks[word]]
    ends = list(range(1, len(word) + 1))  # of the token that begins here
    begins = list(range(-1, len(word)))  # of the token that ends here
    heap = []

    def offer(begin: int) -> None:
        middle = ends[begin]
        if middle < len(word) and (r := ranks.get(word[begin : ends[middle]])) is not None:
            heapq.heappush(heap, (r, begin, middle, ends[middle]))

    for i in range(len(word) - 1):
        offer(i)
    gone = bytearray(len(word))
    while heap:
        _, begin, middle, end = heapq.heappop(heap)
        if gone[begin] or ends[begin] != middle or gone[middle] or ends[middle] != end:
            continue
        gone[middle], ends[begin], begins[end] = 1, end, begin
        offer(begin)
        if begin:
            offer(begins[begin])
    out, at = [], 0
    while at < len(word):
        out.append(ranks[word[at : ends[at]]])
        at = ends[at]
    return out


def frequent_codes(docs: DataFrame, pattern: str, ranks_path: str) -> pa.Table:
    """``word, n, ids`` of the most frequent words of a bounded sample, most frequent first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, words = regex.compile(pattern).findall, Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words.update(find(text))
        kept = [(w, n) for w, n in words.items() if len(w.encode()) <= WORD_BYTES]
        yield pa.RecordBatch.from_pydict(
            {"word": [w for w, _ in kept], "n": [n for _, n in kept]},
            schema=pa.schema([("word", pa.string()), ("n", pa.int64())]),
        )

    sample = bounded_sample(docs.where("text IS NOT NULL").select("text"), SAMPLE_ROWS)
    counted = sample.mapInArrow(count, "word string, n long")
    top = counted.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word")
    # repartitioned: a limit leaves all rows in one partition, and folding is the work
    words = top.limit(FREQUENT).repartition(
        4 * docs.sparkSession.sparkContext.defaultParallelism, "word"
    )
    ids = folded(F.array("word"), rank_map(checked_ranks(ranks_path)))
    found = words.select("word", "n", F.get(ids, F.lit(0)).alias("ids")).toArrow()
    return found.sort_by([("n", "descending"), ("word", "ascending")])


class Places(dict):
    """The place of each word; a miss takes the next place beyond all, until it is forgotten."""

    def __init__(self, words: pa.Table) -> None:
        super().__init__({w: i for i, w in enumerate(words.column("word").to_pylist())})
        self.missed: list[str] = []

    def __missing__(self, word: str) -> int:
        place = self[word] = len(self)
        self.missed.append(word)
        return place

    def codes(self, words: list[str]) -> tuple[np.ndarray, list[str]]:
        """The place of each word, and the misses among them, which are forgotten."""
        codes = np.fromiter(map(self.__getitem__, words), "<u4", len(words))
        missed, self.missed = self.missed, []
        for word in missed:
            del self[word]
        return codes, missed


class Runs:
    """Runs of values, to be joined by their numbers."""

    def __init__(self, values: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> None:
        self.values, self.begins, self.sizes = values, begins, sizes

    @classmethod
    def of_lists(cls, lists: pa.ListArray) -> "Runs":
        ends = lists.offsets.to_numpy().astype(np.int64)
        return cls(lists.values.to_numpy().astype("<u4"), ends[:-1], np.diff(ends))

    def beside(self, other: "Runs") -> "Runs":
        """These runs, and the others numbered after them."""
        begins = np.concatenate([self.begins, other.begins + len(self.values)])
        values = np.concatenate([self.values, other.values])
        return Runs(values, begins, np.concatenate([self.sizes, other.sizes]))

    def joined(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of the numbered runs, and where each begins and the last ends."""
        ends = np.concatenate([[0], np.cumsum(self.sizes[numbers])])
        out = np.empty(ends[-1], self.values.dtype)
        for k in range(0, len(numbers), JOINED_AT_ONCE):
            some = numbers[k : k + JOINED_AT_ONCE]
            first, sizes = ends[k : k + len(some)], self.sizes[some]
            last = ends[k + len(some)]
            places = np.arange(first[0], last) + np.repeat(self.begins[some] - first, sizes)
            out[first[0] : last] = self.values[places]
        return out, ends


@functools.lru_cache(maxsize=2)
def _vocabulary(path: str) -> Runs:
    """The bytes of every id."""
    ranks = read_ranks(path)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    sizes = np.array([len(t) for t in tokens], np.int64)
    return Runs(np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(sizes) - sizes, sizes)


def _binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Data cut into binary values at these byte offsets."""
    if ends[-1] >= 2**31:
        raise ValueError("documents coded together have more than 2 GB of ids or text")
    offsets = pa.py_buffer(ends.astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, offsets, pa.py_buffer(data)])


OUT = pa.schema(
    [("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary()), ("n_tokens", pa.int64())]
)
CODES = pa.schema(
    [("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32()))]
    + [("codes", pa.binary()), ("missed", pa.list_(pa.string()))]
)


def encoded(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id, ids, decoded, n_tokens`` of each row of ``docs`` (doc_id, text).

    ``ids`` are little-endian 32-bit integers; ``decoded`` is what they decode to.
    """
    spark = docs.sparkSession
    # plans hold the rank map; what the driver keeps of their text need not
    spark.conf.set("spark.sql.maxPlanStringLength", PLAN_TEXT)
    shared = spark.sparkContext.broadcast(
        frequent_codes(docs, pattern, ranks_path).combine_chunks()
    )

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, places = regex.compile(pattern).findall, Places(shared.value)

        def stretch(doc_ids: list, sizes: list[int], words: list[str]) -> pa.RecordBatch:
            codes, missed = places.codes(words)
            row = (doc_ids, sizes, codes.tobytes(), missed)
            return pa.RecordBatch.from_pydict({k: [v] for k, v in zip(CODES.names, row)}, CODES)

        doc_ids, sizes, words = [], [], []
        for batch in batches:
            for doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text"))):
                found = find(text)
                doc_ids.append(doc_id)
                sizes.append(len(found))
                words += found
                if len(words) >= STRETCH:
                    yield stretch(doc_ids, sizes, words)
                    doc_ids, sizes, words = [], [], []
        if doc_ids:
            yield stretch(doc_ids, sizes, words)
        del places, doc_ids, sizes, words
        give_back()

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Runs.of_lists(shared.value.column("ids").combine_chunks())
        ranks, vocabulary = read_ranks(ranks_path), _vocabulary(ranks_path)
        for row in (batch.slice(i, 1) for batch in batches for i in range(batch.num_rows)):
            found = row.column("rare").flatten()
            rare = Runs.of_lists(found)
            for i in np.flatnonzero(found.is_null().to_numpy(zero_copy_only=False)).tolist():
                word = row.column("missed").flatten()[i].as_py()
                ids = np.array(merged_with_heap(word.encode(), ranks), "<u4")
                rare.begins[i], rare.sizes[i] = len(rare.values), len(ids)
                rare.values = np.concatenate([rare.values, ids])
            codes = np.frombuffer(row.column("codes")[0].as_py(), "<u4")
            sizes = row.column("sizes").flatten().to_numpy().astype(np.int64)
            ids, ends = table.beside(rare).joined(codes)
            # from words of documents to ids, from ids to bytes
            id_ends = ends[np.concatenate([[0], np.cumsum(sizes)])]
            text, ends = vocabulary.joined(ids)
            values = [row.column("doc_ids").flatten(), _binaries(ids, 4 * id_ends)]
            values += [_binaries(text, ends[id_ends]), pa.array(np.diff(id_ends), pa.int64())]
            yield pa.RecordBatch.from_arrays(values, schema=OUT)
        del table
        give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"))
    coded = rows.mapInArrow(
        code, "doc_ids array<long>, sizes array<int>, codes binary, missed array<string>"
    )
    rare = folded(F.col("missed"), rank_map(checked_ranks(ranks_path)))
    return coded.withColumn("rare", rare).mapInArrow(
        assemble, "doc_id long, ids binary, decoded binary, n_tokens long"
    )
