"""The pipeline's stages, one by one."""

import hashlib
import re

import pytest
import tiktoken
import public_tokenizers

import corpus_pipeline as pipeline
from eventfold.llm import bpe
from nasty import documents, texts
from test_dedup import brute_components, brute_spans


def test_stages_keep_the_columns_and_lose_no_clean_document(spark, tiny):
    docs = documents(spark, [(i, t) for i, t in texts() if i is not None]).withColumnRenamed("lang", "was")
    docs = docs.selectExpr("doc_id", "text", "'xx' AS lang", "source", "n_chars", "label", "rejected", "row")
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, tiny)
        assert out.columns == docs.columns, name
        assert out.dtypes == docs.dtypes, name
    kept = {r.doc_id for r in pipeline.identify(spark, docs, tiny).collect()}
    assert {1, 2, 3, 18}.isdisjoint(kept) and {7, 11, 12, 13, 23} <= kept
    cut = {r.doc_id: r for r in pipeline.cut_repeats(spark, docs, tiny).collect()}
    assert cut[1].text is None and cut[12].text == "" and cut[13].text == dict(texts())[13]
    assert cut[12].n_chars == 0 and cut[11].n_chars == len(cut[11].text) < len(dict(texts())[11])
    assert pipeline.decontaminate(spark, docs, tiny).count() == docs.count()


def test_the_pipeline_runs_over_the_tables(spark, tiny):
    rows = pipeline.run(spark, tiny).collect()
    assert 0 < len(rows) < 200 and len({r.doc_id for r in rows}) == len(rows)
    path = public_tokenizers.path(pipeline.RANKS)
    encoding = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={}
    )
    for r in rows[:20]:
        ids = [int.from_bytes(r.ids[i : i + 4], "little") for i in range(0, len(r.ids), 4)]
        text = encoding.decode_bytes(ids)
        assert r.n_tokens == len(ids) and encoding.encode_ordinary(text.decode()) == ids
        assert r.decoded_sha256 == hashlib.sha256(text).hexdigest()


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if c < "\x80" else c for c in text))


def contaminated(text, windows):
    own, hit = words_of(text), set()
    for n in {len(w) for w in windows}:
        for i in range(len(own) - n + 1):
            if tuple(own[i : i + n]) in windows:
                hit |= set(range(i, i + n))
    return bool(hit) and 20 * len(hit) >= len(own)


def brute_pipeline(known, items):
    """What the stages after the language come to, on all pairs, windows and words."""
    first = {i: c for i, _, c in brute_components(known, pipeline.WORDS, pipeline.PERCENT)}
    known = [(i, t) for i, t in known if first[i] == i]
    cut = [(i, rest.decode("utf-8", "ignore")) for i, _, _, rest in brute_spans(known, pipeline.REPEATED_BYTES)]
    windows = set()
    for item in map(words_of, items):
        windows |= {tuple(item[i : i + 13]) for i in range(max(1, len(item) - 12))} if item else set()
    return {i: t for i, t in cut if not contaminated(t, windows)}


def test_all_rows_are_those_of_the_brute_force(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    known = sorted((r.doc_id, r.text) for r in pipeline.identify(spark, docs, tiny).collect())
    items = [r.text for r in spark.read.parquet(f"{tiny}/benchmark.parquet").select("text").collect()]
    want = brute_pipeline(known, items)
    assert 0 < len(want) < len(known) and any(want[i] != t for i, t in known if i in want)
    path = public_tokenizers.path(pipeline.RANKS)
    encoding = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={}
    )
    rows = {r.doc_id: r for r in pipeline.run(spark, tiny).collect()}
    assert set(rows) == set(want)
    for i, text in want.items():
        ids = encoding.encode_ordinary(text)
        assert bytes(rows[i].ids) == b"".join(n.to_bytes(4, "little") for n in ids)
        assert rows[i].n_tokens == len(ids)
        assert rows[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("stage", [name for name, _ in pipeline.STAGES])
def test_an_empty_table(spark, no_docs, tiny, stage):
    assert dict(pipeline.STAGES)[stage](spark, no_docs, tiny).count() == 0
