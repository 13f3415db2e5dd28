"""Framed records: layout, round trip, rejects."""

import random

import pytest
from events import EMPTY, bill, chaser, failed, frame, nothing, request
from pyspark.sql import types as T

from eventfold.schemas import COLUMN_OF, FRAME, INPUT_KINDS, TYPE_OF
from eventfold.sources.catalog import SCHEMA_IDS, checked, schema_catalog
from eventfold.sources.frames import decode_frames, encode_frames, good, rejects


@pytest.fixture(scope="module")
def catalog(spark):
    return schema_catalog(spark, "input")


def varint(n):
    n = (n << 1) ^ (n >> 63)
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def text(s):
    return varint(len(s.encode())) + s.encode()


def frames_of(spark, values):
    return spark.createDataFrame([("k", i, v) for i, v in enumerate(values)], FRAME)


def test_layout(spark):
    events = frame(spark, [chaser("k", 1, "Peacock", 123, 22, None, "id0")])
    (row,) = encode_frames(events, SCHEMA_IDS).collect()
    body = text("Peacock") + text("id0") + varint(123) + varint(22) + varint(0)
    assert bytes(row.value) == b"\0\0\0\0\x01" + body


def test_round_trip(spark, catalog):
    rng = random.Random(3)
    extremes = [0, 1, -1, 63, 64, -64, -65, 2**31, 2**63 - 1, -(2**63)]
    words = ["", "a", "Peacock", "ünïcode €", "x" * 300]
    events = []
    for seq in range(400):
        pick = rng.choice
        events.append(
            pick(
                [
                    lambda: chaser("k", seq, pick(words), pick(extremes), pick(extremes),
                                   pick([None, *extremes]), pick(words)),
                    lambda: bill("k", seq, pick(extremes), pick(words)),
                    lambda: request("k", seq, pick(words), pick(extremes)),
                    lambda: failed("k", seq, pick(words), pick(extremes)),
                    lambda: nothing("k", seq),
                ]
            )()
        )
    encoded = encode_frames(frame(spark, events), SCHEMA_IDS)
    decoded = good(decode_frames(encoded, catalog, INPUT_KINDS)).collect()
    got = {r.seq: r.asDict(recursive=True) for r in decoded}
    assert got == {e["seq"]: e for e in events if e["kind"]}


def test_aggregates_round_trip(spark, catalog):
    one_bill = bill("K", 1)["bill"]
    requests = [request("K", i, f"PAY-{i}")["payment_request"] for i in range(5)]
    failure = failed("K", 9)["payment_failed"]
    aggregates = [
        {"names": [], "count": 1, "latest": None, "longest": None},
        {"names": ["A", "B", "C"], "count": 9, "latest": 5, "longest": None},
        {"names": ["Z"], "count": 9, "latest": None, "longest": -7},
    ]
    bills = [
        {"bill": None, "paymentRequests": [], "lastPaymentFailed": None, "errored": False},
        {"bill": one_bill, "paymentRequests": requests[:1], "lastPaymentFailed": failure, "errored": True},
        {"bill": None, "paymentRequests": requests, "lastPaymentFailed": failure, "errored": False},
        {"bill": one_bill, "paymentRequests": [], "lastPaymentFailed": None, "errored": True},
    ]
    schema = T.StructType(
        [T.StructField("key", T.StringType()), T.StructField("seq", T.LongType()),
         T.StructField("kind", T.StringType())]
        + [T.StructField(COLUMN_OF[k], TYPE_OF[k]) for k in ("Aggregate", "BillAggregate")]
    )
    rows = [("k", i, "Aggregate", a, None) for i, a in enumerate(aggregates)]
    rows += [("k", 10 + i, "BillAggregate", None, b) for i, b in enumerate(bills)]
    encoded = encode_frames(spark.createDataFrame(rows, schema), SCHEMA_IDS)
    decoded = good(decode_frames(encoded, catalog, ["Aggregate", "BillAggregate"])).collect()
    got = {r.seq: (r.aggregate or r.bill_aggregate).asDict(recursive=True) for r in decoded}
    assert got == {**dict(enumerate(aggregates)), **{10 + i: b for i, b in enumerate(bills)}}


def test_sized_array_blocks(spark, catalog):
    """A negative item count is followed by the size of the block."""
    items = text("A") + text("B")
    body = varint(-2) + varint(len(items)) + items + varint(1) + text("C") + varint(0)
    body += varint(4) + varint(0) + varint(0)
    decoded = decode_frames(frames_of(spark, [b"\0\0\0\0\x02" + body]), catalog).collect()
    assert decoded[0].aggregate.names == ["A", "B", "C"]


def test_rejects(spark, catalog):
    whole = b"\0\0\0\0\x01" + text("Peacock") + text("id0") + varint(1) + varint(2) + varint(0)
    cases = [
        (whole, None),
        (None, "null_value"),
        (b"", "too_short"),
        (whole[:5], "too_short"),
        (b"\x01" + whole[1:], "bad_magic"),
        (b"\0\0\0\0\x63" + whole[5:], "unknown_schema"),
        (b"\0\xff\xff\xff\xff" + whole[5:], "unknown_schema"),
        (b"\0\0\0\x01\x01" + whole[5:], "unknown_schema"),
        (whole[:6], "bad_body"),
        (whole[:-1], "bad_body"),
        (whole[:5] + varint(-3) + whole[6:], "bad_body"),
        (whole[:-1] + varint(2), "bad_body"),
        (whole[:5] + b"\xff" * 12, "bad_body"),
        (whole[:-1] + varint(1) + varint(77), None),
    ]
    decoded = decode_frames(frames_of(spark, [value for value, _ in cases]), catalog)
    got = {r.seq: r.reject_reason for r in decoded.collect()}
    assert got == {i: reason for i, (_, reason) in enumerate(cases)}
    assert rejects(decoded).count() == 12
    kept = {r.seq: r.chaser for r in good(decoded).collect()}
    assert kept[0].previous is None and kept[13].previous == 77


def test_ids_above_the_signed_range(spark):
    ids = {**SCHEMA_IDS, "Chaser": -2}
    encoded = encode_frames(frame(spark, [chaser("k", 1, "A")]), ids)
    assert bytes(encoded.first().value)[:5] == b"\0\xff\xff\xff\xfe"
    (row,) = decode_frames(encoded, schema_catalog(spark, "input", ids)).collect()
    assert row.chaser.name == "A"


def test_catalog(spark, catalog):
    rows = {r.kind: r for r in catalog.collect()}
    assert rows["Bill"].subject == "input-events.billing.Bill"
    assert rows["Chaser"].full_name == "events.chaser.Chaser"
    assert {k: r.schema_id for k, r in rows.items()} == SCHEMA_IDS
    with pytest.raises(ValueError, match="schema_id 1 is registered twice"):
        schema_catalog(spark, "input", {**SCHEMA_IDS, "Bill": 1})
    with pytest.raises(ValueError, match="full_name"):
        checked(catalog.unionByName(catalog))
    assert EMPTY.keys() == {COLUMN_OF[k] for k in INPUT_KINDS}
