"""Streams give what the batch operators give, over restarts and in any order inside a batch."""

import random

import pytest
from events import bill, chaser, failed, frame, request
from pyspark.sql import functions as F
from test_folds import records

import fold
from eventfold.plans.replay import replay
from eventfold.schemas import EVENT
from eventfold.session import scratch
from eventfold.sources.catalog import SCHEMA_IDS, schema_catalog
from eventfold.sources.frames import decode_frames, encode_frames, good
from eventfold.sources.log import Log, from_topic, read_events, topic_rejects
from eventfold.streaming import streams
from eventfold.streaming.sinks import aggregate_frames, read_batches


def some_events(n=300):
    rng = random.Random(11)
    events = []
    for seq in range(n):
        key = rng.choice(["hot"] * 6 + ["k1", "k2", "k3"])
        kind = rng.random()
        if kind < 0.05:
            events.append(bill(key, seq, rng.choice([1, 1, 2])))
        elif kind < 0.3:
            events.append(request(key, seq, f"PAY-{rng.randrange(25)}"))
        elif kind < 0.4:
            events.append(failed(key, seq, f"PAY-{rng.randrange(25)}"))
        else:
            events.append(chaser(key, seq, f"n{rng.randrange(12)}", rng.randrange(99), rng.randrange(99)))
    rng.shuffle(events)
    return events


@pytest.fixture(scope="module")
def events():
    return some_events()


def play(spark, events, begin):
    replay(frame(spark, events), F.floor(F.col("seq") / 100).cast("int"), 3, begin)


def test_counts(spark, events):
    table, checkpoint = scratch(spark, "counts"), scratch(spark, "checkpoint")
    play(spark, events, lambda s: streams.stream_counts(s, table, checkpoint))
    total, _ = fold.counts(events)
    assert {r.count_key: r.n for r in streams.current_counts(spark, table).collect()} == total
    places = streams.state_locations(spark, checkpoint)
    assert {r.key for r in places.collect()} == set(total)


def test_chasers(spark, events):
    table, checkpoint = scratch(spark, "chasers"), scratch(spark, "checkpoint")
    published = []

    def publish(rows, i):
        published.append((i, records(rows, "names")))

    play(spark, events, lambda s: streams.stream_chasers(s, table, checkpoint, publish=publish))
    expected, _ = fold.chaser_states(events)
    for limits in ({}, {"hot_rows": 1, "run_bits": 2, "page_size": 3}):
        got = records(streams.current_chasers(spark, table, **limits), "names")
        assert {
            k: (names, s["count"], s["latest"], s["longest"]) for k, (names, s) in got.items()
        } == expected
    # each publication holds the state after its micro-batch
    assert [i for i, _ in published] == [0, 1, 2]
    for i, got in published:
        so_far, _ = fold.chaser_states([e for e in events if e["seq"] < 100 * (i + 1)])
        assert {k: (n, s["count"], s["latest"], s["longest"]) for k, (n, s) in got.items()} == {
            k: so_far[k] for k in got
        }


def test_billing(spark, events):
    table, checkpoint = scratch(spark, "billing"), scratch(spark, "checkpoint")
    published = []

    def publish(rows, i):
        published.append((i, records(rows, "paymentRequests")))

    def begin(s):
        return streams.stream_billing(s, table, checkpoint, publish=publish, run_bits=4)

    def states(got):
        return {
            k: (s["bill"], listed, s["lastPaymentFailed"], s["errored"])
            for k, (listed, s) in got.items()
        }

    play(spark, events, begin)
    expected, _ = fold.billing_states(events)
    for limits in ({}, {"hot_rows": 1, "run_bits": 2, "page_size": 3}):
        got = records(streams.current_billing(spark, table, **limits), "paymentRequests")
        assert states(got) == expected
    for i, got in published:
        so_far, _ = fold.billing_states([e for e in events if e["seq"] < 100 * (i + 1)])
        assert states(got) == {k: so_far[k] for k in got}
    assert read_batches(spark, f"{table}/runs").select("batch").distinct().count() == 3


def test_compaction_between_restarts(spark, events):
    """Each stretch goes on from what the earlier ones were compacted into."""
    kinds = ["counts", "chasers", "billing"]
    checkpoints = {kind: scratch(spark, "checkpoint") for kind in kinds}
    tables = {kind: [] for kind in kinds}

    def begin(kind, stream, compact):
        def run(s):
            now = scratch(spark, kind)
            if tables[kind]:
                compact(spark, tables[kind][-1], now)
            tables[kind].append(now)
            return stream(s, now, checkpoints[kind])

        return run

    play(spark, events, begin("counts", streams.stream_counts, streams.compact_counts))
    play(spark, events, begin("chasers", streams.stream_chasers, streams.compact_chasers))

    def narrow_runs(*args):
        return streams.stream_billing(*args, run_bits=3)

    play(spark, events, begin("billing", narrow_runs, streams.compact_billing))
    total, _ = fold.counts(events)
    current = streams.current_counts(spark, tables["counts"][-1]).collect()
    assert {r.count_key: r.n for r in current} == total
    got = records(streams.current_chasers(spark, tables["chasers"][-1]), "names")
    assert {
        k: (names, s["count"], s["latest"], s["longest"]) for k, (names, s) in got.items()
    } == fold.chaser_states(events)[0]
    got = records(streams.current_billing(spark, tables["billing"][-1]), "paymentRequests")
    assert {
        k: (s["bill"], listed, s["lastPaymentFailed"], s["errored"]) for k, (listed, s) in got.items()
    } == fold.billing_states(events)[0]


def test_replayed_batch_changes_nothing(spark, events):
    """A micro-batch that runs twice, as after a lost driver, is written once."""
    from eventfold.operators.billing import billing_runs
    from eventfold.streaming.sinks import write_batch

    table = scratch(spark, "twice")
    for _ in range(2):
        write_batch(billing_runs(frame(spark, events).where("kind = 'Bill'")), table, 0)
    assert read_batches(spark, table).groupBy("key", "run").count().where("count > 1").count() == 0


def test_console_tap_and_observed_meters(spark, events):
    from eventfold.operators.meters import observed
    from eventfold.streaming.sinks import console_tap

    path = scratch(spark, "log")
    frame(spark, events).write.parquet(path)
    stream = observed(read_events(spark, Log(path=path), streaming=True), "meters")
    query = console_tap(stream.select("key", "kind"), scratch(spark, "checkpoint"))
    query.awaitTermination()
    seen = [p.observedMetrics["meters"] for p in query.recentProgress if p.observedMetrics]
    assert sum(m.chaser_received for m in seen) == sum(e["kind"] == "Chaser" for e in events)


def test_published_records_decode(spark, events):
    from eventfold.operators.billing import billing_aggregate

    batch = billing_aggregate(frame(spark, events))
    frames = aggregate_frames(batch, "BillAggregate", SCHEMA_IDS).withColumnRenamed("page", "seq")
    decoded = good(decode_frames(frames, schema_catalog(spark, "billing"), ["BillAggregate"]))
    expected, _ = fold.billing_states(events)
    got = {r.key: r.bill_aggregate.asDict(recursive=True) for r in decoded.collect()}
    assert {
        k: (v["bill"], v["paymentRequests"], v["lastPaymentFailed"], v["errored"])
        for k, v in got.items()
    } == expected


def test_topic_rows_fit_the_sink(spark, events):
    from eventfold.operators.chaser import chaser_aggregate
    from eventfold.streaming.sinks import topic_rows

    rows = topic_rows(chaser_aggregate(frame(spark, events)), "Aggregate", SCHEMA_IDS)
    assert [f.dataType.simpleString() for f in rows.schema] == [
        "string", "binary", "array<struct<key:string,value:binary>>",
    ]
    assert {bytes(r.headers[0].value) for r in rows.collect()} == {b"0"}
    again = topic_rows(chaser_aggregate(frame(spark, events)), "Aggregate", SCHEMA_IDS, 7).collect()
    assert {tuple((h.key, bytes(h.value)) for h in r.headers) for r in again} == {
        (("page", b"0"), ("batch", b"7"))
    }


@pytest.mark.parametrize("limits", [{}, {"hot_rows": 1, "run_bits": 2}])
def test_every_page_is_a_record_that_encodes(spark, events, limits):
    from eventfold.operators.billing import billing_aggregate
    from eventfold.operators.chaser import chaser_aggregate
    from eventfold.streaming.sinks import topic_rows

    df = frame(spark, events)
    for kind, fold_ in (("Aggregate", chaser_aggregate), ("BillAggregate", billing_aggregate)):
        pages = fold_(df, page_size=1, **limits)
        assert pages.where("page > 0").count()
        assert topic_rows(pages, kind, SCHEMA_IDS).collect()
        frames = aggregate_frames(pages, kind, SCHEMA_IDS).withColumnRenamed("page", "seq")
        read = decode_frames(frames, schema_catalog(spark, "t"), [kind])
        assert good(read).count() == pages.count()


def test_a_topic_is_folded_frame_by_frame(spark, events):
    """Topic records on disk, streamed: decode, drop what is damaged, count."""
    encoded = encode_frames(frame(spark, events), SCHEMA_IDS)
    records = encoded.select(
        F.col("key").cast("binary").alias("key"),
        F.when(F.col("seq") % 10 == 0, F.unhex(F.lit("07"))).otherwise(F.col("value")).alias("value"),
        F.col("seq").alias("offset"),
        F.lit(2).alias("partition"),
    )
    path, table = scratch(spark, "topic"), scratch(spark, "counts")
    records.write.parquet(path)
    log = Log(format="kafka", topic="input", partitions=3)
    stream = from_topic(spark.readStream.schema(records.schema).parquet(path), log)
    streams.stream_counts(stream, table, scratch(spark, "checkpoint")).awaitTermination()
    total, _ = fold.counts([e for e in events if e["seq"] % 10])
    assert {r.count_key: r.n for r in streams.current_counts(spark, table).collect()} == total
    seqs = {r.seq for r in from_topic(spark.read.parquet(path), log).select("seq").collect()}
    assert seqs == {e["seq"] * 3 + 2 for e in events if e["seq"] % 10}

    aside = scratch(spark, "rejects")
    refused = topic_rejects(spark.readStream.schema(records.schema).parquet(path), log)
    streams.stream_rejects(refused, aside, scratch(spark, "checkpoint")).awaitTermination()
    kept = spark.read.parquet(aside).select("seq", "rejected_kind", "reject_reason").collect()
    assert {tuple(r) for r in kept} == {
        (e["seq"] * 3 + 2, None, "too_short") for e in events if not e["seq"] % 10
    }


def test_a_damaged_frame_is_not_folded(spark):
    """A bill, a failure, and a request that cannot be read: the failure stays outstanding."""
    from eventfold.operators.billing import billing_aggregate
    from eventfold.operators.counts import event_counts
    from eventfold.operators.meters import processing_meters

    bill = dict(billId="K", customerId="C", orderId="O", amountCents=1, currency="USD", issuedAt=1, dueDate=2)
    failed = dict(paymentId="P", billId="K", customerId="C", failureReason="NSF", failedAt=3)
    request = dict(paymentId="P", billId="K", customerId="C", amountCents=1, currency="USD", requestedAt=4)
    rows = [
        ("K", 1, "Bill", None, bill, None, None),
        ("K", 2, "PaymentFailed", None, None, None, failed),
        ("K", 3, "PaymentRequest", None, None, request, None),
    ]
    frames = encode_frames(spark.createDataFrame(rows, EVENT), SCHEMA_IDS)
    value = F.when(F.col("seq") == 3, F.substring("value", 1, 8)).otherwise(F.col("value"))
    records = frames.select("key", value.alias("value"), F.col("seq").alias("offset"), F.lit(0).alias("partition"))
    log = Log(format="kafka", topic="input")
    read = from_topic(records, log)
    state = billing_aggregate(read).collect()[0]
    assert (state.paymentCount, state.lastPaymentFailed.paymentId) == (0, "P")
    assert {r.count_key for r in event_counts(read).collect()} == {"Bill-K", "PayFail-K"}
    assert processing_meters(read).collect()[0].billing_aggregation == 2
    refused = topic_rejects(records, log).collect()
    assert [(r.seq, r.rejected_kind, r.reject_reason) for r in refused] == [(3, "PaymentRequest", "bad_body")]


def test_log_sources(spark, events):
    path = scratch(spark, "log")
    frame(spark, events).write.parquet(path)
    assert read_events(spark, Log(path=path)).schema == EVENT
    assert read_events(spark, Log(path=path)).count() == len(events)
    assert read_events(spark, Log(path=path), streaming=True).isStreaming
    with pytest.raises(ValueError, match="no such log format"):
        read_events(spark, Log(format="csv", path=path))


def streamed(spark, batches, start):
    """Play lists of events, one micro-batch each."""
    path = scratch(spark, "log")
    for batch in batches:
        frame(spark, batch).write.mode("append").parquet(path)
        start(read_events(spark, Log(path=path), streaming=True)).awaitTermination()


@pytest.mark.parametrize(
    "batches",
    [
        [[failed("k", 1, "P1"), failed("k", 3, "P2")], [request("k", 2, "P1")]],
        [[request("k", 5, "P1")], [failed("k", 3, "P1")]],
        [[bill("k", 4), request("k", 6, "P1")], [request("k", 2, "P2"), failed("k", 1, "P2")]],
    ],
)
def test_late_events_are_applied_late(spark, batches):
    table, checkpoint = scratch(spark, "billing"), scratch(spark, "checkpoint")
    streamed(spark, batches, lambda s: streams.stream_billing(s, table, checkpoint))
    arrived = [
        {**e, "seq": i}
        for i, e in enumerate(e for batch in batches for e in sorted(batch, key=lambda e: e["seq"]))
    ]
    expected, _ = fold.billing_states(arrived)
    got = records(streams.current_billing(spark, table), "paymentRequests")
    assert {
        k: (s["bill"], listed, s["lastPaymentFailed"], s["errored"]) for k, (listed, s) in got.items()
    } == expected
    streams.compact_billing(spark, table, f"{table}-2")
    again = records(streams.current_billing(spark, f"{table}-2"), "paymentRequests")
    assert again == got


def test_tables_can_be_read_before_the_first_batch(spark):
    path = scratch(spark, "log")
    frame(spark, []).write.parquet(path)
    for start, read in (
        (streams.stream_counts, streams.current_counts),
        (streams.stream_chasers, streams.current_chasers),
        (streams.stream_billing, streams.current_billing),
    ):
        table = scratch(spark, "table")
        start(read_events(spark, Log(path=path), streaming=True), table, scratch(spark, "c")).awaitTermination()
        assert read(spark, table).count() == 0
