"""Meters, lookups, envelopes, freshness, backlog."""

import random

import pytest
from events import bill, chaser, failed, frame, nothing, request
from pyspark.sql import Observation
from pyspark.sql import functions as F

from eventfold.operators import billing, freshness, lookup, meters
from eventfold.schemas import BILLING_KINDS
from eventfold.sources.envelope import read_envelopes, write_envelopes
from eventfold.sources.query import sql_rows


def test_meters(spark):
    events = [
        bill("BILL-1", 1), request("BILL-1", 2), failed("BILL-1", 3), request("BILL-1", 4),
        bill("BILL-1", 5, 2000), chaser("key-1", 6, "A", 1000, 300), chaser("key-1", 7, "A", 2000, 450),
        chaser(None, 8, "A", 1, 999), bill(None, 9), nothing("k", 10),
    ]
    row = meters.processing_meters(frame(spark, events)).first()
    assert row.asDict() == {
        "chaser_received": 2, "chaser_ttl_value": 450, "billing_aggregation": 5,
        "billing_customer_bills": 1,
    }
    assert meters.processing_meters(frame(spark, [bill("K", 1)])).first().chaser_ttl_value == 0


def test_observed_meters(spark):
    seen = Observation("meters")
    events = [chaser("k", 1, "A", 1, 7), bill("K", 2)]
    assert meters.observed(frame(spark, events), seen).count() == 2
    assert seen.get == {"chaser_received": 1, "chaser_ttl_value": 7, "billing_aggregation": 1}


def test_lookups(spark):
    events = frame(spark, [bill("K", 1), bill("L", 2), chaser("c", 3, "A"), bill(None, 4)])
    records = billing.billing_aggregate(events)
    assert [r.bill.billId for r in lookup.of_key(records, "L").collect()] == ["L"]
    assert lookup.of_key(records, "absent").collect() == []
    for blank in ("", "  "):
        with pytest.raises(ValueError, match="blank"):
            lookup.of_key(records, blank)
    assert sorted(r.key for r in lookup.keys(events, BILLING_KINDS).collect()) == ["K", "L"]
    assert [r.key for r in lookup.keys(events, ["Chaser"]).collect()] == ["c"]


def test_json(spark):
    records = billing.billing_aggregate(frame(spark, [request("K", 1)]))
    listed = (
        '[{"paymentId":"PAY-1","billId":"K","customerId":"CUST-1","amountCents":1000,'
        '"currency":"USD","requestedAt":1}]'
    )
    body = f'"bill":null,"paymentRequests":{listed},"lastPaymentFailed":null,"errored":false}}'
    assert lookup.as_json(records).first().json == "{" + body
    assert lookup.as_json(records, "BillAggregate").first().json == '{"type":"BillAggregate",' + body


def test_envelopes(spark):
    line = (
        '{"shop.billing.Bill":{"billId":"B","customerId":"C","orderId":"O","amountCents":1500,'
        '"currency":"USD","issuedAt":1678886400000,"dueDate":1679491200000}}'
    )
    lines = spark.createDataFrame(
        [("B", 1, line), ("x", 2, '{"shop.other.Thing":{}}'), ("x", 3, "not json"), ("x", 4, None)],
        "key string, seq long, json string",
    )
    rows = {r.seq: r for r in read_envelopes(lines, "shop").collect()}
    assert (rows[1].kind, rows[1].bill.amountCents) == ("Bill", 1500)
    assert [rows[i].kind for i in (2, 3, 4)] == [None] * 3
    again = write_envelopes(read_envelopes(lines, "shop"), "shop").collect()
    assert [(r.seq, r.json) for r in again] == [(1, line)]


def test_sql_rows(spark):
    rows = sql_rows(spark, "SELECT max(id) AS m FROM {numbers}", {"numbers": spark.range(5)})
    assert rows.first().m == 4


@pytest.mark.parametrize(
    "registered_at, fresh, beats, valid",
    [
        (0, True, [500], True),  # exactly one margin ago
        (0, True, [499], False),
        (0, True, [100, 700], True),
        (500, True, [], True),  # counts from its registration
        (499, True, [], False),
        (1000, False, [], True),  # registered as stale, one margin earlier
        (999, False, [], False),
        (999, False, [600], True),
    ],
)
def test_freshness(spark, registered_at, fresh, beats, valid):
    registry = spark.createDataFrame(
        [("s", registered_at, fresh)], "source string, registered_at long, fresh boolean"
    )
    beats = spark.createDataFrame([("s", at) for at in beats], "source string, at long")
    checks = freshness.source_freshness(registry, beats, 500, F.lit(1000))
    assert checks.first().valid is valid


def test_rollup(spark):
    def rollup(*valid):
        checks = spark.createDataFrame([(v,) for v in valid], "valid boolean")
        return tuple(freshness.freshness_rollup(checks).first())

    assert rollup() == (True, 0)
    assert rollup(True, True) == (True, 2)
    assert rollup(True, False) == (False, 2)


def test_backlog(spark):
    rng = random.Random(5)
    arrivals = {
        name: [rng.choice([0, 0, 0, 1, most]) for _ in range(200)]
        for name, most in (("calm", 2), ("busy", 4), ("flooded", 9))
    }
    rows = [(name, t) for name, ns in arrivals.items() for t, n in enumerate(ns) for _ in range(n)]
    df = spark.createDataFrame(rows, "instance string, tick long")
    first, last = F.lit(0).cast("long"), F.lit(199).cast("long")
    got = {
        (r.instance, r.tick): (r.backlog, r.ready)
        for r in freshness.backlog_readiness(df, first, last).collect()
    }
    expected = {}
    for name, ns in arrivals.items():
        count, ready = 0, False
        for tick, n in enumerate(ns):
            count += n
            ready = False if count > 5 else True if count == 0 else ready
            expected[name, tick] = (count, ready)
            count = max(count - 1, 0)
    assert got == expected
