"""Benchmark passages in documents, by a prefix-filtered join of word shingles.

A window is 13 consecutive words of an item (an item of fewer is one window). A document that
holds a window holds all its shingles, so it is enough to look for one necessary shingle of
each window. Shingles are ordered by rarity, counted over all documents, and a window's prefix
is its rarest. Neighbouring windows mostly share it, so few shingles stand for an item.

Each position of each document is looked up once among the prefix shingles. A hit fixes how
document and item lie on each other; bounds by length and position tell whether a window can
fit around it at all; then both are compared word by word to either side, as far as windows
with that shingle reach. What agrees over a window's length or more is an occurrence. The
comparison is exact; hashes only find candidates.

The shingles of the items are broadcast in blocks of at most ``BLOCK_ROWS`` rows, one pass over
the documents for each, so no broadcast grows with the benchmark. Nothing of a document is
shuffled but its count and its occurrences.

Defined results: a null or wordless document has no words and is clean; a null or wordless item
has no windows; an item without an id marks words but is not listed; items that repeat an id
are listed once; repeated documents each give a row; with an empty benchmark all are clean;
further columns are ignored.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventfold.llm.common import kept_table, row_key, whole

WINDOW = 13
SHINGLE = 3
# A row of the broadcast holds at most two windows of words, however long its item.
BLOCK_ROWS = 100_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased and no other letter."""
    plain = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, LOWER))
    return F.regexp_extract_all(plain.otherwise(F.lower(text)), F.lit(WORD), F.lit(0))


def _hash(array: str, at: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), *(F.get(array, at + i) for i in range(size)))


def item_shingles(items: DataFrame) -> DataFrame:
    """Every shingle of every item: ``item_id, item, m, q, size, span, h, at, words``.

    ``span`` is the length of the item's windows, ``m`` its own; ``item`` tells items apart whatever
    their id. ``words`` are those that windows with the shingle can hold, which stands at ``at`` of
    them and at ``q`` of the item.
    """
    n = F.size("words")
    split = items.select("item_id", words(whole()).alias("words")).where(n > 0)
    split = split.select(
        "item_id",
        F.xxhash64("item_id", "words").alias("item"),
        "words",
        n.alias("m"),
        F.least(n, F.lit(WINDOW)).alias("span"),
        F.least(n, F.lit(SHINGLE)).alias("size"),
    ).distinct()
    at = split.withColumn("q", F.explode(F.sequence(F.lit(0), n - F.col("size"))))
    hashes = reduce(
        lambda tail, k: F.when(F.col("size") == k, _hash("words", F.col("q"), k)).otherwise(tail),
        range(1, SHINGLE + 1),
        F.lit(None).cast("long"),
    )
    reach = F.col("span") - F.col("size")
    first = F.greatest(F.col("q") - reach, F.lit(0))
    return at.withColumn("h", hashes).select(
        "item_id", "item", "m", "q", "size", "span", "h",
        (F.col("q") - first).alias("at"),
        F.slice("words", first + 1, F.col("span") + reach).alias("words"),
    )


def _positions(docs: DataFrame, shingles: DataFrame, size: int, how: str) -> DataFrame:
    """Document positions beside the broadcast shingles that may start there.

    Position -1 is a row of its own for each document. The words stay beside each position
    without being copied: generator, lookup and filter run in one generated loop.
    """
    split = docs.select(
        "doc_id",
        F.xxhash64(F.col("text").isNull(), whole()).alias("kth"),
        words(whole()).alias("dwords"),
    )
    marked = F.concat(F.array(F.lit(None).cast("string")), F.col("dwords"))
    at = split.select("doc_id", "kth", "dwords", F.posexplode_outer(marked).alias("p1", "w"))
    at = at.withColumn("p", F.col("p1") - 1)
    rest = [F.get("dwords", F.col("p") + i) for i in range(1, size)]
    key = F.when(F.col("w").isNotNull(), F.xxhash64(F.lit(size), "w", *rest))
    found = F.broadcast(shingles.withColumnRenamed("h", "key"))
    return at.withColumn("key", key).join(found, "key", how)


def _blocks(shingles: DataFrame) -> list[tuple[int, DataFrame]]:
    """Parts of the shingles, each of one size and small enough to broadcast.

    Rows are dealt by all they hold beside words, as one shingle may be in most items.
    """
    counts = {r["size"]: r["n"] for r in shingles.groupBy("size").agg(F.count("*").alias("n")).collect()}
    dealt = F.xxhash64(*(c for c in shingles.columns if c != "words"))
    parts = []
    for size, n in sorted(counts.items()):
        blocks = -(-n // BLOCK_ROWS)
        own = shingles.where(F.col("size") == size)
        parts += [
            (size, own.where(F.pmod(dealt, F.lit(blocks)) == k) if blocks > 1 else own)
            for k in range(blocks)
        ]
    return parts


def prefix_shingles(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rarest shingle of each window, with the item's ``m`` words around it; it is at ``q`` of them."""
    shingles = kept_table(docs.sparkSession, item_shingles(items), "item-shingles")
    distinct = shingles.select("h", "size").distinct()
    counted = [
        _positions(docs, part.select("h"), size, "inner").groupBy("key").agg(F.count("*").alias("n"))
        for size, part in _blocks(distinct)
    ]
    result = ["h", "item_id", "size", "span", F.col("at").alias("q"), "words"]
    if not counted:
        return shingles.select(*result, F.size("words").alias("m"))
    rarity = reduce(DataFrame.unionAll, counted).withColumnRenamed("key", "h")
    ranked = shingles.join(rarity, "h", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    first = F.greatest(F.col("q") - (F.col("span") - F.col("size")), F.lit(0))
    last = F.least(F.col("q"), F.col("m") - F.col("span"))
    rarest = (
        ranked.select("item", "h", "q", "n", F.explode(F.sequence(first, last)).alias("start"))
        .groupBy("item", "start")
        .agg(F.min(F.struct("n", "h", "q")).alias("best"))
        .select("item", F.col("best.q").alias("q"))
        .distinct()
    )
    return shingles.join(rarest, ["item", "q"]).select(*result, F.size("words").alias("m"))


def _agreeing(a: Column, b: Column) -> Column:
    """How many first elements of two arrays are equal."""
    equal = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(equal, F.lit(False))
    return F.when(first == 0, F.size(equal)).otherwise(first - 1).cast("int")


def _side(array: str, at: Column, before: Column, after: Column) -> tuple[Column, Column]:
    """The words before a place, nearest first, and those from it on."""
    left = F.least(before, at)
    return F.reverse(F.slice(array, at - left + 1, left)), F.slice(array, at + 1, after)


def occurrences(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Places of documents that agree with an item over a window or more.

    Columns ``doc_id, kth, n_words, start, stop, item_id, rows``; a row of its own for each
    distinct document, with ``rows`` above 0, has no place.
    """
    prefixes = kept_table(docs.sparkSession, prefix_shingles(docs, items), "prefix-shingles")
    parts = _blocks(prefixes) or [(SHINGLE, prefixes)]
    n, p, q, span = F.size("dwords"), F.col("p"), F.col("q"), F.col("span")
    size, m, own = F.col("size"), F.col("m"), F.col("p") == -1
    reach = span - size
    fits = F.least(p, q, reach) + size + F.least(n - p - size, m - q - size, reach) >= span
    found = []
    for k, (of, part) in enumerate(parts):
        near = _positions(docs, part, of, "left").where(own | F.coalesce(fits, F.lit(False)))
        doc, item = _side("dwords", p, reach, span), _side("words", q, reach, span)
        sides = near.select(
            "doc_id", "kth", "p", "item_id", "span", n.alias("n_words"), own.alias("own"),
            # a generator, as no filter of what follows may move below it: there, it would take
            # the loop over the positions apart and copy the words beside each of them
            F.explode(F.array(F.when(~own, F.struct(*(c.alias(f"c{i}") for i, c in enumerate((*doc, *item))))))).alias("s"),
        )
        before, after = _agreeing(F.col("s.c0"), F.col("s.c2")), _agreeing(F.col("s.c1"), F.col("s.c3"))
        agree = sides.select(
            "doc_id", "kth", "n_words", "own",
            F.when(~F.col("own"), p - before).alias("start"),
            F.when(~F.col("own"), p + after).alias("stop"),
            "span",
            "item_id",
        )
        kept = agree.where(
            (F.col("own") & F.lit(k == 0)) | (~F.col("own") & (F.col("stop") - F.col("start") >= span))
        )
        found.append(kept.drop("span"))
    places = reduce(DataFrame.unionAll, found)
    keys = ["doc_id", "kth", "n_words", "start", "stop", "item_id"]
    return places.groupBy(*keys).agg(F.sum(F.col("own").cast("long")).alias("rows"))


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of each document."""
    of = Window.partitionBy("doc_id", "kth").orderBy("start", "stop")
    until = F.max("stop").over(of.rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.col("stop") - F.greatest("start", F.coalesce(until, F.col("start"))), F.lit(0))
    ids = F.array_sort(F.collect_set(F.col("item_id").cast("string")))
    counted = (
        occurrences(docs, items)
        .withColumn("new", new)
        .groupBy("doc_id", "kth")
        .agg(
            F.max("n_words").cast("long").alias("n_words"),
            F.coalesce(F.sum("new"), F.lit(0)).cast("long").alias("n_hit"),
            ids.alias("ids"),
            F.sum("rows").alias("rows"),
        )
    )
    hit = F.col("n_hit")
    return counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "rows"))).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "ids"), 256).alias("items_sha256"),
        ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated"),
        "kth",
    )


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, w, least(len(w), {WINDOW}) AS span
  FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                                           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)
  WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, span, array_to_string(w[s:s + span - 1], ' ') AS v
  FROM b, unnest(range(1, len(w) - span + 2)) AS u(s)),
spans AS (SELECT DISTINCT span FROM windows),
places AS (
  SELECT r, s, span, array_to_string(w[s:s + span - 1], ' ') AS v
  FROM d, spans, unnest(range(1, len(w) - span + 2)) AS u(s)),
hits AS (SELECT DISTINCT p.r, p.s, p.span, i.item_id FROM places p JOIN windows i USING (span, v)),
covered AS (
  SELECT r, count(DISTINCT s + k) AS n_hit FROM hits, unnest(range(0, span)) AS u(k) GROUP BY r),
listed AS (
  SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN listed USING (r)
"""
