"""Language identification: held-out accuracy, rejection and edge cases."""

import zlib

import numpy as np
import pytest

from eventfold.llm import language
from eventfold.llm.common import table
from nasty import documents, texts


@pytest.fixture(scope="module")
def model(spark):
    return language.learn(table(spark, "/root/testdata/sf0.01", "documents"))


def test_held_out_accuracy(spark, model):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = language.identified(docs, model).where("held_out").collect()
    assert len(got) > 200
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in got]) > 0.97
    assert np.mean([r.rejected for r in got]) < 0.01
    assert all(0 <= r.score <= 1 for r in got)


def test_texts_without_letters_are_undetermined(docs, model):
    got = language.identified(docs, model)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score", "rejected"]
    rows = got.collect()
    assert len(rows) == len(texts())
    for r in rows:
        if r.doc_id in (1, 2, 3, 18):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        elif r.doc_id is not None:
            assert r.lang_pred in model.languages
        if r.doc_id is None:
            assert not r.held_out


def test_nothing_to_learn_from(docs, no_docs):
    assert language.learn(docs) is None  # no row has a language
    rows = language.language_ids(docs).collect()
    assert {(r.lang_pred, r.score, r.rejected) for r in rows} == {("und", 0.0, True)}
    assert language.language_ids(no_docs).count() == 0


def test_held_out_rows_and_rows_without_a_label_teach_nothing(spark):
    rows = [(i, f"word number {i}", "xx" if zlib.crc32(str(i).encode()) % 3 == 1 else None) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language.learn(docs) is None


def test_one_language(spark):
    docs = spark.createDataFrame([(i, "a b c", "xx") for i in range(30)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in language.language_ids(docs).collect()} == {("xx", 1.0)}


def test_slices_do_not_change_subwords(monkeypatch):
    text = "Die Straße À É the quick ... brown-fox 日本 " * 9
    whole = language.subwords(text)
    for size in (5, 16, 33):
        monkeypatch.setattr(language, "SLICE", size)
        # an accented capital cut in two keeps its bytes, so use a text without one
        plain = text.replace("À", "à").replace("É", "é")
        assert (language.subwords(plain) == whole).all()


def test_whole_rows_are_carried(docs, model):
    assert language.identified(docs, model, with_row=True).select("row.*").columns == docs.columns


def test_the_same_model_whatever_the_partitions(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    one, two = language.learn(docs), language.learn(docs.repartition(7))
    assert one.languages == two.languages and np.allclose(one.table, two.table)


def test_the_share_rejected_is_that_of_all_rows_not_fitted(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE_ROWS", 600)
    monkeypatch.setattr(language, "REJECTED", 0.02)
    rng = np.random.default_rng(4)
    words = [["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(30)] for _ in range(5)]

    def text(k):  # a share of its words is of any language
        own = rng.random()
        return " ".join(rng.choice(words[k] if rng.random() < own else words[rng.integers(5)]) for _ in range(12))

    rows = [(i, text(i % 5), f"l{i % 5}") for i in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(docs)
    got = language.identified(docs, model).where("NOT held_out").collect()
    assert 0.1 < model.least < 0.5
    # some 480 rows fitted are among them
    assert 0.017 < np.mean([r.rejected for r in got]) <= 0.02
    held_out = language.identified(docs, model).where("held_out").collect()
    assert 0.012 < np.mean([r.rejected for r in held_out]) < 0.03


@pytest.mark.parametrize(("n", "low"), [(0, 0), (400, 0), (1999, 0), (3999, 1), (10_000, 4)])
def test_the_least_score(n, low):
    counts = np.zeros(language.BINS + 1, np.int64)
    counts[100 : 100 + min(n, 10)] = 1
    counts[-1] = n - counts.sum()
    assert language.least_score(counts) == (
        (100 + low) / language.BINS * language.CEILING if n else language.CEILING
    )
