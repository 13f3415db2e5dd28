"""Chat perspectives, decontamination and sharding against SQL and brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as contract
from compare import compare, database
from eventfold.llm import chat, decontamination, sharding
from nasty import documents, plain, sentence, texts


@pytest.mark.parametrize("name", ["op4_chat_perspectives", "op6_decontamination"])
def test_queries_equal_their_sql(spark, tiny, name):
    db = database(tiny)
    assert compare(spark, db, tiny, name, contract.queries()[name], contract.oracle_sql()[name]) is None


TURNS = [
    (1, 0, "system", "Be kind."),
    (1, 1, "ann", "Hello <|im_end|>"),
    (1, 2, "bob lee", "Hi,\nann"),
    (1, 2, "ann", "at once"),
    (1, 2, "ann", "at once"),
    (1, None, "ann", "before all"),
    (1, 600, None, None),
    (2, 0, "system", "alone"),
    (None, 0, "x", ""),
]


def test_every_speaker_is_the_assistant_once(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    extra = turns.selectExpr("*", "1 AS speaker", "2 AS part", "3 AS header")
    rows = {(r.conv_id, r.speaker, r.part): r for r in chat.dialogues(extra).collect()}
    assert set(rows) == {(1, s, p) for s in ("ann", "bob lee", "unknown") for p in (0, 2)} | {(None, "x", 0)}
    ann = rows[1, "ann", 0]
    assert ann.rendered == (
        "<|im_start|>assistant\nbefore all<|im_end|>\n"
        "<|im_start|>system\nBe kind.<|im_end|>\n"
        "<|im_start|>assistant\nHello < |im_end|><|im_end|>\n"
        "<|im_start|>assistant\nat once<|im_end|>\n"
        "<|im_start|>user name=bob_lee\nHi,\nann<|im_end|>\n"
    )
    spans = [ann.rendered[m.start : m.end] for m in ann.mask]
    assert spans == ["before all<|im_end|>", "Hello < |im_end|><|im_end|>", "at once<|im_end|>"]
    assert (ann.n_turns, ann.n_rows, ann.n_trained) == (5, 6, 3)
    assert rows[1, "bob lee", 2].rendered == "<|im_start|>user name=unknown\n<|im_end|>\n"
    assert chat.dialogues(turns.limit(0)).count() == 0


@pytest.mark.parametrize("query", ["op4_chat_perspectives", "op6_decontamination"])
def test_native_queries_run_no_python(spark, tiny, query):
    plan = contract.queries()[query](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute_contamination(rows, items):
    out = []
    for doc_id, text in rows:
        w = words(text)
        hit, ids = set(), set()
        for item_id, item in items:
            v = words(item)
            span = min(13, len(v))
            windows = {tuple(v[k : k + span]) for k in range(len(v) - span + 1)} if v else set()
            for s in range(len(w) - span + 1):
                if windows and tuple(w[s : s + span]) in windows:
                    hit |= set(range(s, s + span))
                    ids.add(item_id)
        listed = ",".join(sorted(str(i) for i in ids if i is not None))
        out.append(
            (doc_id, len(w), len(hit), len(ids - {None}), hashlib.sha256(listed.encode()).hexdigest(),
             bool(hit) and 20 * len(hit) >= len(w))
        )
    return out


def planted():
    rng = random.Random(12)
    item, other = sentence(rng, 40), sentence(rng, 25)
    short, tiny = sentence(rng, 6), "Zebra"
    again = " ".join(["tick tock"] * 20)
    items = [(3, item), (20, item), (100, other), (4, short), (5, tiny), (6, ""), (7, None), (8, again), (None, other)]
    items.append((9, "straße ÉCOLE two"))
    part = " ".join(item.split()[7:25])
    rows = texts() + [
        (200, sentence(rng, 50) + " " + part.upper() + " " + sentence(rng, 50)),
        (201, sentence(rng, 300) + " " + " ".join(item.split()[:13])),
        (202, sentence(rng, 30) + " " + " ".join(item.split()[:12]) + " end"),
        (203, f"{other}! {other}? {item}."),
        (204, "a zebra, here"),
        (205, sentence(rng, 20) + ", " + short.replace(" ", " -- ")),
        (206, "tick tock " * 9),
        (207, "STRAßE ÉCOLE Two, but école straße two"),
        (208, item),
        (208, item),
    ]
    return rows, items


@pytest.mark.parametrize("block", [decontamination.BLOCK_ROWS, 7])
def test_contamination_is_exact(spark, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK_ROWS", block)
    rows, items = planted()
    benchmark = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS h", "2 AS q")
    got = decontamination.contamination(documents(spark, rows).repartition(3), benchmark).drop("kth")
    assert plain(got.collect()) == plain(brute_contamination(rows, items))


def test_rows_of_the_broadcast_are_bounded(spark, monkeypatch):
    """By long items, and by one text under many ids: its shingles are dealt over the blocks."""
    monkeypatch.setattr(decontamination, "BLOCK_ROWS", 200)
    long = " ".join(f"w{i}" for i in range(2_000))
    items = [(0, long)] + [(i, "same words in each of many items") for i in range(1, 60)]
    rows = [(1, "x " + " ".join(long.split()[700:740]) + " y"), (2, "the same words in each of many items")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, rows)
    prefixes = decontamination.prefix_shingles(docs, benchmark).cache()
    assert prefixes.selectExpr("max(size(words)) AS n").first().n < 2 * decontamination.WINDOW
    parts = decontamination._blocks(prefixes)
    assert sum(part.count() for _, part in parts) == prefixes.count()
    assert max(part.where("item_id > 0").count() for _, part in parts) < 59
    got = decontamination.contamination(docs, benchmark).drop("kth")
    assert plain(got.collect()) == plain(brute_contamination(rows, items))


def test_contamination_of_empty_tables(spark, docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontamination.contamination(docs, none)
    assert got.count() == len(texts()) and got.where("contaminated OR n_hit > 0").count() == 0
    assert decontamination.contamination(no_docs, none).count() == 0


@pytest.mark.parametrize("rows", [1, 2, 3, 10, 97, 1000, 4097])
def test_the_permutation_is_one(rows):
    for key in (0, 5):
        got = sharding.permuted(np.arange(rows), rows, key)
        assert sorted(got.tolist()) == list(range(rows))
    assert rows < 10 or (sharding.permuted(np.arange(rows), rows, 0) != np.arange(rows)).any()


def test_shards_are_even_gapless_and_reproducible(spark, docs):
    got = [plain(sharding.sharded(docs.repartition(n), 5).collect()) for n in (1, 4)]
    assert got[0] == got[1]
    rows = sharding.sharded(docs, 5).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts()
    )
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(k, [])) for k in range(5)]
    assert max(sizes) - min(sizes) <= 1
    n = len(rows)
    for r in rows:  # both follow from the row's number alone
        at = int(sharding.permuted(np.array([r.number]), n, 0)[0])
        assert (r.shard, r.slot) == (at % 5, at // 5)


def test_shards_of_an_empty_table(no_docs):
    assert sharding.sharded(no_docs, 24).count() == 0
