"""Token counts and byte-level BPE against the libraries."""

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from eventfold.llm import bpe, token_counts
from nasty import plain, texts

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={}
    )


@pytest.mark.parametrize("frequent", [token_counts.FREQUENT, 3])
def test_counts_are_the_librarys(docs, monkeypatch, frequent):
    monkeypatch.setattr(token_counts, "FREQUENT", frequent)
    library = Tokenizer.from_file(JSON)
    got = token_counts.token_counts(docs, JSON, public_tokenizers.PATTERN, 100).collect()
    expected = []
    for doc_id, text in texts():
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        expected.append((doc_id, len((text or "").encode()), n, n > 100))
    assert plain(got) == plain(expected)


def test_a_full_cache_is_emptied(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHED", 2)
    lengths = token_counts.Lengths(JSON, b" the", bytes([1]))
    library = Tokenizer.from_file(JSON)
    for word in ["alpha", "beta", " gamma", "delta", "alpha"]:
        assert lengths[word] == len(library.encode(word).ids)
    assert len(lengths) <= 4 and lengths[" the"] == 1


def test_counting_has_no_shuffle_of_texts(docs):
    plan = token_counts.token_counts(docs, JSON, public_tokenizers.PATTERN, 1)._jdf
    assert "Exchange" not in plan.queryExecution().executedPlan().toString().split("InMemory")[0]


@pytest.mark.parametrize(("frequent", "long"), [(bpe.FREQUENT, bpe.LONG), (2, bpe.LONG), (2, 6)])
def test_ids_are_the_librarys(docs, encoding, monkeypatch, frequent, long):
    monkeypatch.setattr(bpe, "FREQUENT", frequent)
    monkeypatch.setattr(bpe, "LONG", long)
    got = bpe.encoded(docs, RANKS, public_tokenizers.PATTERN).collect()
    expected = []
    for doc_id, text in texts():
        ids = encoding.encode_ordinary(text or "")
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        expected.append((doc_id, packed, (text or "").encode(), len(ids)))
    assert plain((r[0], bytes(r[1]), bytes(r[2]), r[3]) for r in got) == plain(expected)


def test_heap_merges_as_the_library(encoding):
    ranks, rng = bpe.read_ranks(RANKS), random.Random(2)
    for _ in range(200):
        letters = rng.choice([b"ab", b"theions ", bytes(range(256))])
        word = bytes(rng.choice(letters) for _ in range(rng.choice([1, 2, 7, 40, 700])))
        assert bpe.merged_with_heap(word, ranks) == encoding._encode_single_piece(word)


def test_a_fold_searches_for_nothing(spark, encoding):
    """Each search by ``array_position`` ends in an exception, most of the fold's time."""
    rng = random.Random(4)
    alphabets = ["ab", "theions ", "aé€😀 ", "a"]
    words = [
        "".join(rng.choice(letters) for _ in range(n))
        for letters in alphabets
        for n in (1, 2, 3, 9, 40, 128)
    ]
    words += ["a" * bpe.LONG, "a" * (bpe.LONG + 1)]
    folded = bpe.folded(F.col("words"), bpe.rank_map(bpe.checked_ranks(RANKS)))
    got = spark.createDataFrame([(words,)], "words array<string>").select(folded.alias("ids"))
    assert "array_position" not in got._jdf.queryExecution().optimizedPlan().toString()
    ids = got.first().ids
    assert ids.pop() is None
    assert ids == [encoding._encode_single_piece(w.encode()) for w in words[:-1]]


def test_runs_are_joined_in_any_chunks(monkeypatch):
    values, begins = np.arange(100, 120, dtype="<u4"), np.array([0, 3, 3, 10])
    sizes = np.array([3, 0, 7, 10])
    first = bpe.Runs(values, begins, sizes)
    both = first.beside(bpe.Runs(values + 50, begins, sizes))
    numbers = np.array([7, 0, 1, 1, 2, 4, 5, 3, 0], "<u4")
    runs = [v[b : b + n].tolist() for v in (values, values + 50) for b, n in zip(begins, sizes)]
    for chunk in (1, 2, 100):
        monkeypatch.setattr(bpe, "JOINED_AT_ONCE", chunk)
        out, ends = both.joined(numbers)
        assert out.tolist() == [x for k in numbers for x in runs[k]]
        assert np.diff(ends).tolist() == [len(runs[k]) for k in numbers]
    assert [x.tolist() for x in first.joined(numbers[:0])] == [[], [0]]


def test_encoding_has_no_shuffle_of_texts(docs):
    plan = bpe.encoded(docs, RANKS, public_tokenizers.PATTERN)._jdf
    assert "Exchange" not in plan.queryExecution().executedPlan().toString()


def test_empty_tables(no_docs):
    assert token_counts.token_counts(no_docs, JSON, public_tokenizers.PATTERN, 1).count() == 0
    assert bpe.encoded(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0
