"""Streams that keep state: records, changelogs, pages, lookups and meters, over restarts and faults."""

import math

import pytest
from events import bill, chaser, failed, frame, request
from pyspark.sql import functions as F
from test_folds import records
from test_streaming import some_events

import fold
from eventfold.operators.meters import processing_meters
from eventfold.schemas import EVENT
from eventfold.session import scratch
from eventfold.sources.log import Log, read_events
from eventfold.streaming import kept, state

SMALL = {"buckets": 4, "run_bits": 3}
STRETCH = 40


class Stream:
    """Events put into a log stretch by stretch, and a stream restarted for each."""

    def __init__(self, spark, keep, name, **limits):
        self.spark, self.keep, self.limits = spark, keep, {**SMALL, **limits}
        self.log, self.table, self.checkpoint = (scratch(spark, n) for n in ("log", name, "checkpoint"))

    def play(self, events):
        frame(self.spark, events).coalesce(1).write.mode("append").parquet(self.log)
        self.run()

    def run(self):
        stream = read_events(self.spark, Log(path=self.log), streaming=True)
        query = self.keep(stream, self.table, self.checkpoint, **self.limits)
        query.awaitTermination()
        if query.exception():
            raise query.exception()


def stretches(events, length=STRETCH):
    top = max(e["seq"] for e in events) + 1
    return [[e for e in events if lo <= e["seq"] < lo + length] for lo in range(0, top, length)]


@pytest.fixture(scope="module")
def events():
    return some_events(200)


def billing_of(pages):
    return {
        k: (s["bill"], listed, s["lastPaymentFailed"], s["errored"])
        for k, (listed, s) in records(pages, "paymentRequests").items()
    }


def chasers_of(pages):
    return {
        k: (names, s["count"], s["latest"], s["longest"]) for k, (names, s) in records(pages, "names").items()
    }


def rows_of(df):
    return sorted((tuple(r.asDict(recursive=True).items()) for r in df.collect()), key=repr)


def test_billing_over_stretches(spark, events):
    from eventfold.operators.billing import billing_changelog

    s = Stream(spark, kept.keep_billing, "billing", changelog=True, publish=True, page_size=3)
    so_far = []
    for i, part in enumerate(stretches(events)):
        s.play(part)
        so_far += part
        expected, _ = fold.billing_states(so_far)
        assert billing_of(kept.kept_billing(spark, s.table, page_size=3)) == expected
        pages = kept.kept_log(spark, s.table, "pages")
        assert billing_of(kept.assembled_billing(pages)) == expected
        # only keys of the micro-batch are published
        touched = {e["key"] for e in part if e["kind"] != "Chaser"}
        assert {r.key for r in kept.kept_log(spark, s.table, "pages", i - 1).collect()} == touched
        assert {r.key for r in kept.kept_keys(spark, s.table).collect()} == set(expected)
    want = billing_changelog(frame(spark, events))
    assert rows_of(kept.kept_log(spark, s.table)) == rows_of(want)
    for key in ("hot", "k1"):
        one = billing_of(kept.kept_billing_of(spark, s.table, key, page_size=2))
        assert one == {key: expected[key]}
    assert kept.kept_billing_of(spark, s.table, "no such key").collect() == []


def test_chasers_over_stretches(spark, events):
    from eventfold.operators.chaser import chaser_changelog

    s = Stream(spark, kept.keep_chasers, "chasers", changelog=True, publish=True, page_size=3)
    so_far = []
    for part in stretches(events):
        s.play(part)
        so_far += part
        expected, _ = fold.chaser_states(so_far)
        assert chasers_of(kept.kept_chasers(spark, s.table, page_size=2, run_bits=2)) == expected
        pages = kept.kept_log(spark, s.table, "pages")
        assert chasers_of(kept.assembled_chasers(pages)) == expected
        assert {r.key for r in kept.kept_keys(spark, s.table).collect()} == set(expected)
    assert rows_of(kept.kept_log(spark, s.table)) == rows_of(chaser_changelog(frame(spark, events)))
    assert chasers_of(kept.kept_chaser_of(spark, s.table, "hot")) == {"hot": expected["hot"]}


def test_counts_over_stretches(spark, events):
    from eventfold.operators.counts import event_count_changelog

    s = Stream(spark, kept.keep_counts, "counts", changelog=True)
    for part in stretches(events):
        s.play(part)
    total, _ = fold.counts(events)
    assert {r.count_key: r.n for r in kept.kept_counts(spark, s.table).collect()} == total
    assert rows_of(kept.kept_log(spark, s.table)) == rows_of(event_count_changelog(frame(spark, events)))


def test_meters_over_restarts(spark, events):
    one = Stream(spark, kept.keep_chasers, "chasers")
    two = Stream(spark, kept.keep_billing, "billing")
    assert rows_of(kept.kept_meters(spark)) == rows_of(processing_meters(frame(spark, [])))
    so_far = []
    for part in stretches(events, 70):
        for s in (one, two):
            s.play(part)
            s.run()  # a restart with nothing new
        so_far += part
        want = processing_meters(frame(spark, so_far))
        assert rows_of(kept.kept_meters(spark, one.table, two.table)) == rows_of(want)


def test_a_killed_batch_shows_nothing_and_runs_again(spark, events, monkeypatch):
    """Killed between its writes, before its commit, and after it but before the checkpoint's."""
    first, second = stretches(events, 100)
    s = Stream(spark, kept.keep_billing, "billing", changelog=True, publish=True)
    s.play(first)
    before, _ = fold.billing_states(first)
    after, _ = fold.billing_states(events)
    write, commit, faults = state.write, state.commit, iter(["write", "commit", "late"])
    now = next(faults)

    def broken_write(*args):
        out = write(*args)
        if now == "write":
            raise RuntimeError("killed between two writes")
        return out

    def broken_commit(*args):
        if now == "commit":
            raise RuntimeError("killed before the commit")
        commit(*args)
        if now == "late":
            raise RuntimeError("killed after the commit")

    monkeypatch.setattr(state, "write", broken_write)
    monkeypatch.setattr(state, "commit", broken_commit)
    with pytest.raises(Exception, match="killed between"):
        s.play(second)
    for kill in ("before", "after"):
        assert billing_of(kept.kept_billing(spark, s.table)) == before
        assert billing_of(kept.assembled_billing(kept.kept_log(spark, s.table, "pages"))) == before
        assert kept.kept_log(spark, s.table, after=0).count() == 0
        now = next(faults)
        with pytest.raises(Exception, match=f"killed {kill}"):
            s.run()
    assert billing_of(kept.kept_billing(spark, s.table)) == after
    now = None
    s.run()  # the batch is committed, so it is not taken twice
    assert billing_of(kept.kept_billing(spark, s.table)) == after
    n = sum(e["kind"] in ("Bill", "PaymentRequest", "PaymentFailed") for e in events)
    assert kept.kept_log(spark, s.table).count() == n
    assert kept.kept_meters(spark, bills=s.table).first().billing_aggregation == n
    # what the killed batches left is gone
    named = {f"gen={g}" for _, g, _ in state._pairs(state.latest(spark, s.table))}
    older = {f"gen={g}" for b in state._batches(spark, s.table) for _, g, _ in state._pairs(state._load(spark, s.table, b))}
    found = {n for part in ("state", "requests", "pages") for n in state._names(spark, f"{s.table}/{part}")}
    assert {n for n in found if n.startswith("gen=")} <= named | older


def test_an_event_that_comes_late_is_applied_late(spark):
    s = Stream(spark, kept.keep_billing, "billing", changelog=True)
    s.play([bill("K", 1, 5), failed("K", 4), request("K", 6, "P")])
    s.play([failed("K", 2), request("K", 3, "P"), request("K", 5, "Q")])
    (key, (_, requests, failure, wrong)), = billing_of(kept.kept_billing(spark, s.table)).items()
    assert [r["paymentId"] for r in requests] == ["P", "Q"] and failure is None and not wrong
    c = Stream(spark, kept.keep_chasers, "chasers")
    c.play([chaser("K", 5, "a"), chaser("K", 6, "b")])
    c.play([chaser("K", 1, "a")])
    assert chasers_of(kept.kept_chasers(spark, c.table))["K"][0] == ["a", "b"]


def test_what_a_batch_reads_stays_level(spark, monkeypatch):
    """Over ten micro-batches: files read for state and payments, and rows written again."""
    read, files = state.read, []

    def counted(*args, **named):
        out = read(*args, **named)
        files[-1] += len(out.inputFiles())
        return out

    monkeypatch.setattr(state, "read", counted)
    s = Stream(spark, kept.keep_billing, "billing", buckets=2)
    batches = 10
    for i in range(batches):
        files.append(0)
        s.play([e for k in range(8) for e in (bill(f"k{k}", 2 * i), request(f"k{k}", 2 * i + 1, f"P{i % 3}"))])
    assert files[0] == 0
    most = 2 * 2 * (math.floor(math.log2(batches)) + 1)  # parts, buckets, generations
    assert max(files) <= most and files[-1] <= files[2] + 4
    live = state.latest(spark, s.table).parts["state"]["live"]
    assert all(len(g) <= math.floor(math.log2(batches)) + 1 for g in live.values())
    assert kept.kept_billing(spark, s.table).count() == 8
    assert len(state._batches(spark, s.table)) == state.KEPT


def test_published_pages_follow_the_names_that_changed(spark):
    s = Stream(spark, kept.keep_chasers, "chasers", publish=True, page_size=10)
    s.play([chaser("K", i, f"n{i}") for i in range(200)])
    assert kept.kept_log(spark, s.table, "pages").count() == 20
    for i in range(3):
        s.play([chaser("K", 300 + i, f"n{50 * i}")])
        changed = kept.kept_log(spark, s.table, "pages", i).collect()
        # the page that the name left, and the one it came to
        assert {r.page for r in changed} == {5 * i, 20}
        assert sum(len(r.names) for r in changed) <= 20
    names = [f"n{50 * i}" for i in range(3)]
    want = names[::-1] + [f"n{i}" for i in reversed(range(200)) if f"n{i}" not in names]
    pages = kept.assembled_chasers(kept.kept_log(spark, s.table, "pages"))
    assert chasers_of(pages)["K"][0] == want == chasers_of(kept.kept_chasers(spark, s.table))["K"][0]


def test_published_billing_pages_are_the_last_ones(spark):
    s = Stream(spark, kept.keep_billing, "billing", publish=True, page_size=10)
    s.play([request("K", i, f"P{i}") for i in range(95)])
    s.play([failed("K", 100)])
    s.play([request("K", 101 + i, f"Q{i}") for i in range(7)])
    got = [{r.page for r in kept.kept_log(spark, s.table, "pages", i - 1).where(F.col("batch") == i).collect()} for i in range(3)]
    assert got == [set(range(10)), {9}, {9, 10}]
    got = billing_of(kept.assembled_billing(kept.kept_log(spark, s.table, "pages")))
    assert [r["paymentId"] for r in got["K"][1]] == [f"P{i}" for i in range(95)] + [f"Q{i}" for i in range(7)]


def test_a_lookup_reads_one_bucket(spark, events):
    s = Stream(spark, kept.keep_billing, "billing", buckets=16)
    for part in stretches(events):
        s.play(part)
    for key in ("hot", "k2"):
        found = state.read_key(spark, s.table, state.latest(spark, s.table), "requests", key, ["key", "paymentId"])
        assert len({f.split("/bucket=")[1].split("/")[0] for f in found.inputFiles()}) == 1
    with pytest.raises(ValueError, match="blank"):
        kept.kept_billing_of(spark, s.table, " ")


def test_a_hot_key_does_not_fill_one_task(spark):
    """The requests of a hot key are rebalanced when written, and folded in runs."""
    from eventfold.operators.billing import billing_events

    rows = spark.range(4000).select(
        F.lit("hot").alias("key"), F.col("id").alias("seq"), F.lit("PaymentRequest").alias("kind"),
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in EVENT if f.name in ("chaser", "bill")],
        F.struct(*[F.concat(F.lit("P"), "id").alias("paymentId"), *[F.lit("x").alias(n) for n in ("billId", "customerId")],
                   F.lit(1).cast("long").alias("amountCents"), F.lit("USD").alias("currency"),
                   F.lit(1).cast("long").alias("requestedAt")]).alias("payment_request"),
        F.lit(None).cast(EVENT["payment_failed"].dataType).alias("payment_failed"),
    )
    s = Stream(spark, kept.keep_billing, "billing", run_bits=8)
    rows.write.parquet(s.log)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16k")
    try:
        s.run()
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    requests = state.read(spark, s.table, state.latest(spark, s.table), "requests")
    assert requests.count() == 4000 and len(requests.inputFiles()) > 2
    runs = __import__("eventfold.operators.billing", fromlist=["x"]).billing_runs(billing_events(rows), 8)
    assert runs.count() == 16


def test_a_table_belongs_to_one_stream(spark, events):
    s = Stream(spark, kept.keep_counts, "counts")
    s.play(events[:20])
    s.checkpoint = scratch(spark, "checkpoint")
    with pytest.raises(ValueError, match="is kept by"):
        s.run()


def test_null_keys_are_counted_and_not_folded(spark):
    some = [bill(None, 1), chaser(None, 2, "a"), request("", 3, "P"), chaser("é", 4, "b")]
    for keep, keys in ((kept.keep_billing, {""}), (kept.keep_chasers, {"é"}), (kept.keep_counts, {"Bill-null", "a", "PayReq-", "b"})):
        s = Stream(spark, keep, "odd")
        s.play(some)
        assert {r.key for r in kept.kept_keys(spark, s.table).collect()} == keys
