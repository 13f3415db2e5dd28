"""Token counts by a map-side lookup in two tiers.

A byte-level tokenizer cuts a text into pre-tokens and encodes each on its own, so a text's
count is the sum of its pre-tokens' lengths in tokens. Tier one is a table of the lengths of
frequent pre-tokens, fitted on a bounded sample and broadcast; tier two encodes what it misses
with the library and keeps the lengths in a bounded cache of the worker. Every pre-token of
every text is counted, wherever its length comes from, and none is shuffled: the plan is one
narrow stage, whatever the skew.

Defined results: a null text counts as empty (0 bytes, 0 tokens); a null id stays null; repeated
rows each give a row; an empty table gives none; further columns are ignored.
"""

import functools
import os
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventfold.llm.common import added_tokens, bounded_sample, whole

# Documented bounds: rows of the sample, entries of the broadcast table, bytes of an entry
# (so at most 4 MB in all), entries of a worker's cache.
SAMPLE_ROWS = 4_096
FREQUENT = 65_536
ENTRY_BYTES = 64
CACHED = 400_000


class Lengths(dict):
    """Pre-token to its number of tokens; encodes what it does not hold."""

    def __init__(self, tokenizer_json: str, frequent: bytes, sizes: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encode = Tokenizer.from_file(tokenizer_json).encode
        self.frequent = dict(zip(frequent.decode().split("\0"), sizes)) if sizes else {}
        super().__init__(self.frequent)

    def __missing__(self, word: str) -> int:
        if len(self) > len(self.frequent) + CACHED:
            self.clear()
            self.update(self.frequent)
        self[word] = n = len(self.encode(word, add_special_tokens=False).ids)
        return n


@functools.lru_cache(maxsize=2)
def _lengths(tokenizer_json: str, frequent: bytes, sizes: bytes) -> Lengths:
    return Lengths(tokenizer_json, frequent, sizes)


def _pieces(special: list[str]):
    """Text to the parts between special texts, and how many of those there are."""
    if not special:
        return lambda text: ([text], 0)
    split = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))).split
    return lambda text: (parts := split(text), len(parts) - 1)


def frequent_words(docs: DataFrame, pattern: str, special: list[str]) -> list[str]:
    """The most frequent pre-tokens of a bounded sample, counted per task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, find, parts = Counter(), regex.compile(pattern).findall, _pieces(special)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for part in parts(text)[0]:
                    words.update(find(part))
        kept = [(w, n) for w, n in words.items() if len(w.encode()) <= ENTRY_BYTES and "\0" not in w]
        yield pa.RecordBatch.from_pydict({"w": [w for w, _ in kept], "n": [n for _, n in kept]})

    sample = bounded_sample(docs.where("text IS NOT NULL"), SAMPLE_ROWS)
    counted = sample.select("text").mapInArrow(count, "w string, n long")
    top = counted.groupBy("w").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "w").limit(FREQUENT)
    return [row.w for row in top.collect()]


def token_counts(docs: DataFrame, tokenizer_json: str, pattern: str, limit: int) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of each row of ``docs`` (doc_id, text).

    ``tokenizer_json`` is a byte-level BPE file that all executors can read at the same path,
    ``pattern`` what it cuts texts with.
    """
    special = added_tokens(tokenizer_json)
    words = frequent_words(docs, pattern, special)
    fit = Lengths(tokenizer_json, b"", b"")
    sizes = docs.sparkSession.sparkContext.broadcast(
        ("\0".join(words).encode(), bytes(min(fit[w], 255) for w in words))
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, parts = regex.compile(pattern).findall, _pieces(special)
        length = _lengths(tokenizer_json, *sizes.value).__getitem__
        for batch in batches:
            counts = []
            for text in batch.column("text").to_pylist():
                between, n = parts(text)
                counts.append(n + sum(sum(map(length, find(part))) for part in between))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.octet_length(whole()).cast("long").alias("n_bytes"),
        whole().alias("text"),
    )
    counted = rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
