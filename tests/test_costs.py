"""What the replay and its streams must not spend: sorts, counts and numbers that nobody needs."""

import datetime
import time

import pytest
from events import bill, failed, frame, request
from pyspark.sql import functions as F
from test_kept import Stream

from eventfold.operators import billing
from eventfold.operators.counts import event_counts
from eventfold.plans import queries, replay
from eventfold.schemas import EVENT
from eventfold.session import prepare
from eventfold.sources import tables
from eventfold.streaming import kept, state


def test_row_numbers_of_state_are_not_kept(spark):
    name = "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows"
    assert prepare(spark).conf.get(name) == "false"


def test_replay_writes_stretches_without_a_sort_and_gives_the_setting_back(spark, monkeypatch):
    name, seen = "spark.sql.maxConcurrentOutputFileWriters", []
    move = replay._move

    def recorded(spark, name, value, of=replay._set):
        seen.append((name, value))
        return of(spark, name, value)

    monkeypatch.setattr(replay, "_set", recorded)
    was = spark.conf.get(name)
    events = spark.createDataFrame([(f"K{i % 3}", i, "Bill") for i in range(9)], "key string, seq long, kind string")
    events = events.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in EVENT.fields[3:]])
    found = []

    def begin(stream):
        def each(rows, i):
            found.extend((r.key, r.seq) for r in rows.select("key", "seq").collect())

        to = replay.scratch(spark, "checkpoint") if not found else begin.to
        begin.to = to
        return stream.writeStream.foreachBatch(each).option("checkpointLocation", to).trigger(availableNow=True).start()

    replay.replay(events, F.floor(F.col("seq") / 3).cast("int"), 3, begin)
    assert seen == [(name, 4)] and spark.conf.get(name) == was and move is replay._move
    assert sorted(found) == sorted((f"K{i % 3}", i) for i in range(9))
    assert [s // 3 for _, s in found] == sorted(s // 3 for _, s in found)


def _tables(spark, folder, orders, lines, beats):
    day = datetime.datetime(2024, 1, 1)
    rows = {
        "orders": [(k, 1, s, 10.0, day, "1") for k, s in orders],
        "lineitem": [(k, 1, 1, n, 1.0, 5.0, 0.0, 0.0, "N", "O", day) for k, n in lines],
        "events": [(i, day, 1, "click", 1.0, None) for i in beats],
    }
    for name, found in rows.items():
        spark.createDataFrame(found, tables.TABLES[name]).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize(
    "orders, lines",
    [
        ([(1, "O"), (2, "P"), (9, "P"), (9, "O")], [(1, 1), (2, 1), (2, 2), (9, 1), (77, 1)]),
        ([(19, "P"), (19, "P"), (19, "P")], [(19, 1)]),  # most bills of all, under a key apart
        ([(None, "P"), (None, None), (3, None)], [(None, 1), (None, None)]),
        ([], []),
    ],
)
def test_span_of_seq_needs_no_numbering(spark, tmp_path, orders, lines):
    folder = _tables(spark, tmp_path, orders, lines, [4, 5])
    log = tables.billing_log(spark, folder)
    span = tables.billing_span(spark, folder)
    assert span.first() == log.agg(F.min("seq"), F.max("seq")).first()
    assert "Window" not in span._jdf.queryExecution().executedPlan().toString()


def test_stretches_of_the_replay_in_order_are_told_from_counts(spark, tmp_path, monkeypatch):
    folder = _tables(spark, tmp_path, [(1, "P"), (9, "O")], [(1, n) for n in range(5)], [3, 4])
    told = []
    monkeypatch.setattr(queries, "_stretch", lambda at, lo, hi: told.append((lo, hi)) or F.lit(0))
    monkeypatch.setattr(queries, "replay", lambda *_: None)
    monkeypatch.setattr(tables, "_ordered", lambda rows: told.append("numbered") or rows.withColumn("seq", F.lit(1)))
    queries._play_in_order(spark, folder, None)
    assert told == ["numbered", (1, 7)]  # numbered once: for the log itself


def test_counts_of_a_micro_batch_are_made_once(spark, monkeypatch):
    made = []
    agg = kept._Batch.count_by_key
    monkeypatch.setattr(kept._Batch, "count_by_key", lambda self: made.append(agg(self)) or made[-1])
    s = Stream(spark, kept.keep_counts, "counts", changelog=True)
    events = [bill("a", 1), bill("a", 2), bill("b", 1), bill(None, 3)]
    s.play(events[:3])
    s.play(events[3:] + [bill("a", 4)])
    assert {r.count_key: r.n for r in kept.kept_counts(spark, s.table).collect()} == {
        r.count_key: r.n for r in event_counts(frame(spark, [*events, bill("a", 4)])).collect()
    }
    assert len(made) == 2


def test_hot_keys_of_a_damaged_topic_are_measured_once(spark, tmp_path, monkeypatch):
    folder = _tables(spark, tmp_path, [(1, "P"), (9, "O")], [(1, n) for n in range(5)], [])
    measured, hot_keys = [], tables.hot_keys
    monkeypatch.setattr(tables, "hot_keys", lambda *args: measured.append(args) or hot_keys(*args))
    queries.damaged_topic_billing(spark, folder)
    assert len(measured) == 1


SOME = [e for k in "abc" for e in (bill(k, 1), request(k, 2, "P1"), request(k, 3, "P2"), failed(k, 4))]


def _shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for i in range(found.size()) if (n := found.apply(i).getName()).startswith("shuffle_")}


def test_a_billing_micro_batch_holds_nothing_in_memory_and_leaves_no_shuffle_files(spark, monkeypatch):
    commit, held = state.commit, []

    def counted(*args):
        held.append(spark.sparkContext._jsc.getPersistentRDDs().size())
        commit(*args)

    monkeypatch.setattr(state, "commit", counted)
    s = Stream(spark, kept.keep_billing, "billing", changelog=True, publish=True, hot_rows=100)
    known, cached = _shuffle_files(spark), spark.sparkContext._jsc.getPersistentRDDs().size()
    s.play(SOME)
    s.play([bill("a", 5, 7), request("d", 1)])
    assert held == [cached] * 3  # the table's making and two micro-batches
    until = time.time() + 20
    while _shuffle_files(spark) - known and time.time() < until:
        time.sleep(0.2)
    assert not _shuffle_files(spark) - known
    assert state._names(spark, f"{s.table}/{state.STAGED}") == []


def test_what_a_killed_micro_batch_staged_is_removed(spark):
    s = Stream(spark, kept.keep_billing, "billing")
    s.play(SOME)
    state.stage(spark, s.table, frame(spark, SOME), 1)
    assert state._names(spark, f"{s.table}/{state.STAGED}")
    s.run()
    assert state._names(spark, f"{s.table}/{state.STAGED}") == []


def test_kept_files_are_small(spark):
    """Compressed by zstd, and a bill that is all of current, lowest and highest is there once."""
    s = Stream(spark, kept.keep_billing, "billing", changelog=True, publish=True)
    s.play([*SOME, bill("b", 5, 7)])
    known = state.latest(spark, s.table)
    for part in known.parts:
        found = state.read(spark, s.table, known, part).inputFiles()
        assert found and all(f.endswith(".zstd.parquet") for f in found)
    stored = {r.key: r for r in state.read(spark, s.table, known, "state").collect()}
    assert {k: (r.bill_low is None, r.bill_high is None) for k, r in stored.items()} == {
        "a": (True, True), "b": (True, False), "c": (True, True),
    }
    assert {r.key: r.errored for r in kept.kept_billing(spark, s.table).collect()} == {"a": False, "b": True, "c": False}


def test_packed_states_come_back_whole(spark):
    one, two = ("b", "c", "o", 1, "USD", 1, 2), ("b", "c", "o", 2, "USD", 1, 2)
    kind = tables.BILL.simpleString()
    rows = [(one, one, one), (two, one, two), (one, one, two), (None, None, None), (None, one, two), (None, one, one)]
    states = spark.createDataFrame(rows, f"bill {kind}, bill_low {kind}, bill_high {kind}")
    small = billing.packed(states)
    assert small.where("bill_low IS NULL").count() == 3 and small.where("bill_high IS NULL").count() == 3
    assert billing.unpacked(small).collect() == states.collect()


def test_pages_are_assembled_in_one_shuffle(spark):
    s = Stream(spark, kept.keep_billing, "billing", publish=True, page_size=1)
    s.play(SOME)
    s.play([request("a", 5, "P3")])
    got = kept.assembled_billing(kept.kept_log(spark, s.table, "pages"))
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted((r.key, r.page, r.paymentCount) for r in got.collect()) == [
        ("a", 0, 3), ("a", 1, 3), ("a", 2, 3), *[(k, p, 2) for k in "bc" for p in (0, 1)],
    ]
