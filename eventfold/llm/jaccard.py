"""Exact Jaccard join of documents by their word n-grams, and its connected components.

A document's set is its distinct shingles, as 64-bit hashes; documents of equal sets are one
class. The join works on a token-group matrix: classes are partitioned into groups of similar
ones, the matrix holds which tokens each group has, and a class is compared with members of
another group only if enough of its tokens are in that group's union.

Only tokens that can matter are in the matrix. Under one order of all tokens, two sets that are
similar enough share at least two of their first few (prefix filter), so a class needs its
prefix only: about 15 % of its tokens at a threshold of 0.85. The order puts tokens that are
frequent in the corpus last, so passages that many documents share rarely meet in a prefix. The
frequent ones are counted over all documents by lossy counting, and the top ``FREQUENT`` of them
broadcast; which ones make it changes the order and so the work, but no result.

1. Groups. Classes that share a prefix token are compared with the most central one of them and
   with the one before them in that order: two comparisons a token, however many share it. A
   class is the more central the earlier it has the token, that is, the fewer rare tokens of its
   own it has, so near copies of one text meet its plainest copy. The components of the links
   found are the groups. All their links are real links.
2. Matrix. Tokens of more than one group remain. A class and another group qualify by size and
   by two shared tokens; only members of qualifying groups that share two themselves, and were
   not compared before, are opened. What links is joined to the groups.

Every pair that could link is so compared or already connected. Before sets are compared, a
bound weeds pairs out: tokens fall into ``GROUPS`` groups by hash, and two classes cannot share
more than the lesser of their counts in each. Only sets of what is left are made again from the
texts, found by a bitmap of bounded size in one more pass, so no text is shuffled. Comparing is
exact on the sets: those of the partners of one class stream past its own, and a class of many
partners is dealt to several tasks. Nothing is collected but the bounded list of frequent tokens
and the bitmap.

Defined results: a null, empty or blank text has no shingles and links with nothing, its own id
being its component; repeated rows link, each giving a row; a null id takes part, and is never
the least; an empty table gives none; further columns are ignored. Two different sets of equal
size could be taken for one with odds of 2**-64 a pair.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventfold.llm.bitmaps import bitmap_of, marked
from eventfold.llm.common import NO_ID, give_back, kept_table, row_key, whole
from eventfold.llm.components import components
from eventfold.llm.fingerprints import WordHashes, shingle_hashes

SHARED = 2
FREQUENT = 262_144
COUNTED_AT_ONCE = 1_000_000  # tokens: 8 MB
AT_ONCE = 125_000  # rows given back in one batch
PARTNERS = 256  # of a class in one task
GROUPS = 256  # of tokens, by their first eight bits


def _sets(text: str, hashes: WordHashes, words: int) -> np.ndarray:
    return np.unique(shingle_hashes(text.encode(), hashes, words))


def _class(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def counts_of(tokens: np.ndarray) -> bytes:
    """How many tokens are in each group; 255 stands for that and more."""
    counts = np.bincount((tokens >> np.uint64(56)).astype(np.int64), minlength=GROUPS)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


SIZES = "kid long, kth long, cls long, n int, counts binary, token long, times long"
_SIZES = pa.schema(
    [("kid", pa.int64()), ("kth", pa.int64()), ("cls", pa.int64()), ("n", pa.int32())]
    + [("counts", pa.binary()), ("token", pa.int64()), ("times", pa.int64())]
)


def sizes_and_counts(docs: DataFrame, words: int) -> DataFrame:
    """One pass: class and size of each document, and how often tokens repeat within windows.

    Counts are lossy: a window of tokens gives those that two classes of it have. Rows of counts
    have no class.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen, held, size = WordHashes(), set(), [], 0

        def counted() -> pa.RecordBatch:
            token, times = np.unique(np.concatenate(held), return_counts=True)
            often = times > 1
            token, times = token[often].view(np.int64), times[often]
            none = pa.nulls(len(token))
            columns = [none.cast(t) for t in _SIZES.types[:5]] + [pa.array(token), pa.array(times)]
            return pa.RecordBatch.from_arrays(columns, schema=_SIZES)

        for batch in batches:
            cls, n, groups = [], [], []
            for text in batch.column("text").to_pylist():
                tokens = _sets(text, hashes, words)
                cls.append(_class(tokens))
                n.append(len(tokens))
                groups.append(counts_of(tokens))
                if (cls[-1], n[-1]) not in seen and len(tokens):
                    seen.add((cls[-1], n[-1]))
                    held.append(tokens)
                    size += len(tokens)
                    if size >= COUNTED_AT_ONCE:
                        yield counted()
                        seen, held, size = set(), [], 0
            none = pa.nulls(len(n))
            columns = [batch.column("kid"), batch.column("kth"), pa.array(cls, pa.int64())]
            columns += [pa.array(n, pa.int32()), pa.array(groups, pa.binary())]
            columns += [none.cast(pa.int64()), none.cast(pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=_SIZES)
        if held:
            yield counted()
        del hashes, seen, held
        give_back()

    rows = docs.select(*row_key(), whole().alias("text"))
    return kept_table(docs.sparkSession, rows.mapInArrow(look, SIZES), "sizes")


def _frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent tokens, ascending, and their places in the order, rarest first."""
    top = (
        counts.groupBy("token")
        .agg(F.sum("times").alias("times"))
        .orderBy(F.desc("times"), "token")
        .limit(FREQUENT)
        .toArrow()
    )
    tokens = top.column("token").to_numpy().view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], (len(tokens) - order).astype(np.int64)


def prefix(tokens: np.ndarray, frequent: np.ndarray, place: np.ndarray, percent: int) -> np.ndarray:
    """The first tokens of a set, of which similar sets share at least two."""
    n = len(tokens)
    many = n - (percent * n + 99) // 100 + SHARED
    if many >= n:
        return tokens
    if not len(frequent):
        return tokens[:many]
    at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
    rank = np.where(frequent[at] == tokens, place[at], 0)
    return tokens[np.lexsort((tokens, rank))[:many]]


def matrix_tokens(docs: DataFrame, words: int, percent: int, counts: DataFrame) -> DataFrame:
    """``token, cls, n, pos`` for the prefix of each document's set, in order of ``pos``."""
    shared = docs.sparkSession.sparkContext.broadcast(_frequent(counts))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, (frequent, place) = WordHashes(), shared.value

        def given(out: list, cls: list, n: list) -> pa.RecordBatch:
            lengths = [len(x) for x in out]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(out).view(np.int64)),
                    pa.array(np.repeat(np.array(cls, np.int64), lengths)),
                    pa.array(np.repeat(np.array(n, np.int32), lengths)),
                    pa.array(np.concatenate([np.arange(x, dtype=np.int32) for x in lengths])),
                ],
                ["token", "cls", "n", "pos"],
            )

        seen: set[tuple[int, int]] = set()
        out, cls, n, size = [], [], [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                tokens = _sets(text, hashes, words)
                key = _class(tokens), len(tokens)
                if not len(tokens) or key in seen:
                    continue
                seen.add(key)
                out.append(prefix(tokens, frequent, place, percent))
                cls.append(key[0])
                n.append(key[1])
                size += len(out[-1])
                if size >= AT_ONCE:
                    yield given(out, cls, n)
                    out, cls, n, size = [], [], [], 0
                    seen = set()
        if out:
            yield given(out, cls, n)
        del hashes, seen, out, cls, n
        give_back()

    return docs.select(whole().alias("text")).mapInArrow(look, "token long, cls long, n int, pos int")


def _node(cls: str = "cls", n: str = "n") -> Column:
    """A class as one value; the least of a group is its smallest set."""
    return F.struct(F.col(n).alias("n"), F.col(cls).alias("cls"))


def _needed(n: Column, m: Column, percent: int) -> Column:
    """How many tokens sets of these sizes must share."""
    return F.ceil((n.cast("long") + m) * percent / (100 + percent))


def _may_link(a: str, b: str, percent: int) -> Column:
    """Whether two classes that share a token can be similar enough, by sizes and positions.

    ``a`` and ``b`` are structs of ``n`` and ``pos``. What is shared begins early in both.
    """
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    needed = _needed(n, m, percent)
    early = [F.col(f"{x}.pos") < F.col(f"{x}.n") - needed + SHARED for x in (a, b)]
    return (needed <= F.least(n, m)) & early[0] & early[1]


def shared_tokens(tokens: DataFrame) -> DataFrame:
    """Tokens of more than one class, most central class first.

    ``token, own, first, before``: structs of ``central, n, cls, pos`` of classes with the token.
    """
    by = Window.partitionBy("token")
    central = F.floor(F.col("pos").cast("long") * 1_000_000 / F.col("n")).cast("int").alias("central")
    placed = tokens.select("token", F.struct(central, "n", "cls", "pos").alias("own")).select(
        "token",
        "own",
        F.min("own").over(by).alias("first"),
        F.max("own").over(by).alias("last"),
        F.lag("own").over(by.orderBy("own")).alias("before"),
    )
    return placed.where("first <> last AND (before IS NULL OR before <> own)").drop("last")


def first_pairs(tokens: DataFrame, percent: int) -> DataFrame:
    """The two comparisons of each class of a token: ``a, b``."""

    def met(other: str) -> DataFrame:
        rows = tokens.where(f"{other} <> own").where(_may_link(other, "own", percent))
        return rows.select(
            _node(f"{other}.cls", f"{other}.n").alias("a"), _node("own.cls", "own.n").alias("b")
        )

    return met("first").unionAll(met("before")).distinct()


def classes_of(sizes: DataFrame) -> DataFrame:
    """``node, key, counts``: each class, and the key of a document that stands for it."""
    key = F.min(F.struct("kid", "kth")).alias("k")
    found = sizes.groupBy(_node().alias("node")).agg(key, F.first("counts").alias("counts"))
    found = found.select("node", F.xxhash64("k.kid", "k.kth").alias("key"), "counts")
    return kept_table(sizes.sparkSession, found, "classes")


def bounded(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs that may be similar enough by how many tokens they have in each group."""
    kind = pairs.schema["a"].dataType
    of = lambda name: classes.select(F.col("node").alias(name), F.col("counts").alias(f"of_{name}"))
    met = pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b").select("a", "b", "of_a", "of_b")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            one, two = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, GROUPS)
                for c in ("of_a", "of_b")
            )
            n, m = (batch.column(c).field("n").to_numpy().astype(np.int64) for c in ("a", "b"))
            both = np.minimum(one, two).sum(axis=1, dtype=np.int64)
            may = 100 * both >= percent * (n + m - both)
            may |= (one == 255).any(axis=1) | (two == 255).any(axis=1)
            yield batch.select(["a", "b"]).filter(pa.array(may))

    return met.mapInArrow(look, T.StructType().add("a", kind).add("b", kind))


def verified(
    docs: DataFrame, classes: DataFrame, pairs: DataFrame, words: int, percent: int
) -> DataFrame:
    """The pairs ``a, b`` whose sets are similar enough, exactly."""
    spark = docs.sparkSession
    pairs = kept_table(spark, bounded(pairs, classes, percent), "bounded")
    wanted = pairs.select("a").unionAll(pairs.select("b")).distinct().withColumnRenamed("a", "node")
    keys = kept_table(spark, classes.join(wanted, "node").select("key"), "wanted")
    marks = spark.sparkContext.broadcast(bitmap_of(keys, keys.count()))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            some = marked(batch.column("key").to_numpy().view(np.uint64), marks.value)
            sets = [
                _sets(text, hashes, words)
                for text in batch.column("text").filter(pa.array(some)).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([_class(x) for x in sets], pa.int64()),
                    pa.array([len(x) for x in sets], pa.int32()),
                    pa.array([x.tobytes() for x in sets], pa.binary()),
                ],
                ["cls", "n", "tokens"],
            )

    texts = docs.select(*row_key(), whole().alias("text"))
    texts = texts.select(F.xxhash64("kid", "kth").alias("key"), "text")
    sets = texts.mapInArrow(look, "cls long, n int, tokens binary")
    sets = kept_table(spark, sets.select(_node().alias("node"), "tokens"), "sets")
    # a class of many partners is dealt to several tasks, its own set to each
    deals = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).alias("deals"))
    dealt = pairs.join(deals, "a").withColumn("deal", F.pmod(F.xxhash64("b"), F.col("deals")))
    partners = dealt.join(sets.withColumnRenamed("node", "b"), "b").select("a", "deal", "b", "tokens")
    own = (
        deals.join(sets.withColumnRenamed("node", "a"), "a")
        .withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1)))
        .select("a", "deal", F.lit(None).cast(partners.schema["b"].dataType).alias("b"), "tokens")
    )
    met = own.unionAll(partners).repartition("a", "deal")
    met = met.sortWithinPartitions("a", "deal", F.asc_nulls_first("b"))
    flat = met.select("a.n", "a.cls", F.col("b.n").alias("bn"), F.col("b.cls").alias("bcls"), "tokens")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros(0, np.uint64)
        for batch in batches:
            found = []
            columns = (batch.column(c).to_pylist() for c in ("n", "cls", "bn", "bcls", "tokens"))
            for n, cls, bn, bcls, tokens in zip(*columns):
                other = np.frombuffer(tokens, np.uint64)
                if bn is None:
                    mine = other
                    continue
                both = len(np.intersect1d(mine, other, assume_unique=True))
                if 100 * both >= percent * (len(mine) + len(other) - both):
                    found.append((n, cls, bn, bcls))
            if found:
                n, cls, bn, bcls = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(n, pa.int32()), pa.array(cls, pa.int64())]
                    + [pa.array(bn, pa.int32()), pa.array(bcls, pa.int64())],
                    ["n", "cls", "bn", "bcls"],
                )

    links = flat.mapInArrow(compare, "n int, cls long, bn int, bcls long")
    links = links.select(_node().alias("a"), _node("bcls", "bn").alias("b"))
    return kept_table(spark, links.distinct(), "links")  # repeated documents give theirs twice


def open_groups(tokens: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes in different groups that may still link.

    ``tokens`` is ``token, node, pos``, ``groups`` is ``node, label``; a class in no group is one.
    """
    spark = tokens.sparkSession
    placed = tokens.join(groups, "node", "left").withColumn("label", F.coalesce("label", "node"))
    by = Window.partitionBy("token")
    placed = placed.select(
        "*", F.min("label").over(by).alias("least"), F.max("label").over(by).alias("most")
    )
    apart = kept_table(
        spark, placed.where("least <> most").select("token", "node", "pos", "label"), "matrix"
    )
    matrix = apart.groupBy("token", F.col("label").alias("group")).agg(
        F.min("node.n").alias("low"), F.max("node.n").alias("high")
    )
    n, low, high = (F.col(c).cast("long") for c in ("node.n", "low", "high"))
    least = F.greatest(low, F.ceil(n * percent / 100))  # the smallest member that could link
    early = F.col("pos") < n - _needed(n, least, percent) + SHARED
    near = (100 * high >= percent * n) & (100 * n >= percent * low) & early
    qualified = (
        apart.join(matrix, "token")
        .where((F.col("group") < F.col("label")) & near)
        .groupBy("node", "group")
        .agg(F.count(F.lit(1)).alias("shared"))
        .where(F.col("shared") >= F.least(F.lit(SHARED), F.ceil(n * percent / 100)))
        .select(F.col("node").alias("a"), "group")
    )
    own = apart.select("token", F.col("node").alias("a"), F.struct("node.n", "pos").alias("x"))
    mine = own.join(qualified, "a")
    members = apart.select(
        "token",
        F.col("label").alias("group"),
        F.col("node").alias("b"),
        F.struct("node.n", "pos").alias("y"),
    )
    return (
        mine.join(members, ["token", "group"])
        .where(_may_link("x", "y", percent))
        .groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("shared"))
        .where(F.col("shared") >= F.least(F.lit(SHARED), _needed(F.col("a.n"), F.col("b.n"), percent)))
        .select("a", "b")
    )


def linked(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of each row of ``docs`` (doc_id, text).

    Further columns: the row's key, and the component as a value of its own (``label``).
    """
    spark = docs.sparkSession
    looked = sizes_and_counts(docs, words)
    sizes, counts = looked.where("cls IS NOT NULL"), looked.where("cls IS NULL")
    tokens = shared_tokens(matrix_tokens(docs, words, percent, counts))
    tokens = kept_table(spark, tokens, "tokens")
    classes = classes_of(sizes)
    tried = kept_table(spark, first_pairs(tokens, percent), "pairs")
    links = verified(docs, classes, tried, words, percent)
    groups = components(links)
    placed = tokens.select("token", _node("own.cls", "own.n").alias("node"), "own.pos")
    left = open_groups(placed, groups, percent)
    both = tried.unionAll(tried.select(F.col("b").alias("a"), F.col("a").alias("b")))
    left = kept_table(spark, left.join(both, ["a", "b"], "left_anti"), "pairs")
    if left.head(1):
        links = links.unionAll(verified(docs, classes, left, words, percent))
        groups = components(links)
    placed = sizes.withColumn("node", _node()).join(groups, "node", "left")
    placed = placed.select(
        F.when(F.col("kid") != NO_ID, F.col("kid")).alias("doc_id"),
        "kid",
        "kth",
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.coalesce("label", "node")).alias("label"),
    )
    least = placed.where("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("least"))
    return placed.join(least, "label", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("least"))
        .otherwise(F.col("doc_id"))
        .alias("component_id"),
        "kid",
        "kth",
        "label",
    )


def one_of_each(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The rows of ``docs`` without all but one of each component: that of the least id.

    Rows without shingles all stay.
    """
    found = linked(docs, words, percent).select("kid", "kth", "label").distinct()
    least = F.min(F.struct((F.col("kid") == NO_ID).alias("none"), "kid", "kth")).alias("k")
    first = found.where("label IS NOT NULL").groupBy("label").agg(least)
    stay = first.select("k.kid", "k.kth", F.lit(True).alias("linked")).unionAll(
        found.where("label IS NULL").select("kid", "kth", F.lit(False))
    )
    rows = docs.select(F.struct(*docs.columns).alias("row"), *row_key())
    copy = F.row_number().over(Window.partitionBy("kid", "kth").orderBy(F.lit(0)))
    kept = rows.join(stay, ["kid", "kth"]).withColumn("copy", copy)
    return kept.where("copy = 1 OR NOT linked").select("row.*")
