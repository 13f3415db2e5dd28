"""Small tables that hold what operators must cope with."""

import random

from pyspark.sql import types as T

DOCS = (
    T.StructType()
    .add("doc_id", "long")
    .add("text", "string")
    .add("lang", "string")
    .add("source", "string")
    .add("n_chars", "long")
    # names that operators use themselves
    .add("uid", "string")
    .add("kid", "string")
    .add("label", "string")
    .add("row", "string")
    .add("rejected", "string")
    .add("ids", "string")
    .add("n_words", "string")
)


def sentence(rng, words, start=0):
    return " ".join(f"w{rng.randrange(start, start + 4000):04x}" for _ in range(words))


def texts():
    """Id and text: nulls, empties, long texts, copies, near copies, shared passages, odd letters."""
    rng = random.Random(4)
    base = sentence(rng, 120)
    passage = sentence(rng, 90, 5000)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, None),
        (2, ""),
        (3, " \t\n"),
        (4, "one"),
        (5, "One Two"),
        (6, "ONE two three four"),
        (7, base),
        (8, base),
        (9, " ".join(near)),
        (10, base.upper()),
        (11, sentence(rng, 40) + " " + passage + " " + sentence(rng, 40)),
        (12, passage),
        (13, sentence(rng, 9000)),
        (14, "a" * 3000),
        (15, "ab" * 700 + "c" + "ab" * 700),
        (16, "Ünïcödé ÉCOLE straße 日本語テキスト 😀😀 é  x y"),
        (17, "don't we'll I'VE it's ''s <|endoftext|> x<|endoftext|>"),
        (18, "12345 !!! ??? ... ###"),
        (19, sentence(rng, 30) + "\n\n" + passage[:450]),
        (20, "x" * 399),
        (21, "\x00 odd \x1c control \x85 letters"),
        (None, "text without an id " + sentence(rng, 20)),
        (None, None),
        (23, sentence(rng, 60)),
        (23, sentence(rng, 60)),  # an id of two texts
        (8, base),  # a repeated row
        (8, base),
        (2**62, sentence(rng, 50)),
        (-5, sentence(rng, 50)),
    ]
    return rows


def documents(spark, rows=None):
    made = [
        (i, t, None, "s", None, "u", "k", "l", "r", "x", "i", "n")
        for i, t in (texts() if rows is None else rows)
    ]
    return spark.createDataFrame(made, DOCS)


def plain(rows):
    """Rows as sorted tuples."""
    return sorted((tuple(r) for r in rows), key=repr)
