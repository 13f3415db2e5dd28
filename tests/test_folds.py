"""Operators against the fold, on ordinary and on hot keys."""

import random

import pytest
from events import bill, chaser, failed, frame, logs, nothing, request
from hypothesis import HealthCheck, given, settings

import fold
from eventfold.operators import billing, counts
from eventfold.operators import chaser as chasers

ORDINARY = {}
# every key with over one event is hot; runs span 4 seq values, pages hold 2 entries
HOT = {"hot_rows": 1, "run_bits": 2}
MODES = pytest.mark.parametrize("limits", [ORDINARY, HOT], ids=["ordinary", "hot"])
CHECKS = settings(
    max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)


def plain(value):
    return value.asDict(recursive=True) if hasattr(value, "asDict") else value


def records(pages, list_name):
    """Put the pages of each key back together; each carries all the state."""
    out = {}
    for row in sorted((r.asDict(recursive=True) for r in pages.collect()), key=lambda r: r["page"]):
        listed = row.pop(list_name)
        page = row.pop("page")
        key = row.pop("key")
        if page == 0:
            assert key not in out
            out[key] = (listed, row)
        else:
            assert row == out[key][1]
            assert len(listed) > 0
            out[key][0].extend(listed)
    return out


def check_billing(spark, events, limits, page_size=2):
    expected, log = fold.billing_states(events)
    df = frame(spark, events)
    got = records(billing.billing_aggregate(df, page_size=page_size, **limits), "paymentRequests")
    assert {
        k: (s["bill"], listed, s["lastPaymentFailed"], s["errored"]) for k, (listed, s) in got.items()
    } == expected
    assert all(len(listed) == s["paymentCount"] for listed, s in got.values())

    rows = [plain(r) for r in billing.billing_changelog(df, **limits).collect()]
    added, seen = {}, {}
    for r in sorted(rows, key=lambda r: r["seq"]):
        listed = added.setdefault(r["key"], [])
        if r["addedRequest"] is not None:
            listed.append(r["addedRequest"])
        assert len(listed) == r["paymentCount"]
        seen[r["key"], r["seq"]] = (
            r["bill"], list(listed), r["lastPaymentFailed"], r["errored"],
        )
    assert len(rows) == len(log)
    assert seen == log


def check_chasers(spark, events, limits, page_size=2, seed=1):
    expected, log = fold.chaser_states(events, seed)
    df = frame(spark, events)
    got = records(
        chasers.chaser_aggregate(df, page_size=page_size, count_seed=seed, **limits), "names"
    )
    assert {
        k: (names, s["count"], s["latest"], s["longest"]) for k, (names, s) in got.items()
    } == expected

    rows = [plain(r) for r in chasers.chaser_changelog(df, count_seed=seed, **limits).collect()]
    names, seen = {}, {}
    for r in sorted(rows, key=lambda r: r["seq"]):
        known = names.get(r["key"], [])
        assert r["name_is_new"] == (r["name"] not in known)
        names[r["key"]] = [r["name"]] + [n for n in known if n != r["name"]]
        assert len(names[r["key"]]) == r["names_count"]
        seen[r["key"], r["seq"]] = (
            names[r["key"]], r["count"], r["latest"], r["longest"],
        )
    assert len(rows) == len(log)
    assert seen == log


def check_counts(spark, events, limits):
    total, log = fold.counts(events)
    df = frame(spark, events)
    assert {r.count_key: r.n for r in counts.event_counts(df).collect()} == total
    rows = counts.event_count_changelog(df, **limits).collect()
    assert sorted((r.count_key, r.seq, r.n) for r in rows) == sorted(log)


@MODES
@CHECKS
@given(events=logs())
def test_random_logs(spark, limits, events):
    check_billing(spark, events, limits)
    check_chasers(spark, events, limits)
    check_counts(spark, events, limits)


@MODES
def test_long_random_log(spark, limits):
    """A thousand events, most of them of one key."""
    rng = random.Random(7)
    events = []
    for seq in range(1000):
        key = rng.choice(["hot"] * 8 + ["warm", "cold"])
        kind = rng.random()
        payment = f"PAY-{rng.randrange(40)}"
        if kind < 0.02:
            events.append(bill(key, seq, rng.choice([1, 1, 1, 2])))
        elif kind < 0.3:
            events.append(request(key, seq, payment))
        elif kind < 0.35:
            events.append(failed(key, seq, payment))
        else:
            events.append(chaser(key, seq, f"n{rng.randrange(30)}", rng.randrange(99), rng.randrange(99)))
    rng.shuffle(events)
    check_billing(spark, events, limits, page_size=7)
    check_chasers(spark, events, limits, page_size=7)
    check_counts(spark, events, limits)


# events of a key; payment requests listed, failedAt of the outstanding failure, errored
CASES = {
    "lifecycle": (
        lambda k: [
            bill(k, 1), request(k, 2), failed(k, 3), request(k, 4, at=130), bill(k, 5, 2000),
        ],
        (1, None, True),
    ),
    "duplicate request clears the failure": (
        lambda k: [bill(k, 1), request(k, 2), failed(k, 3), request(k, 4)], (1, None, False),
    ),
    "two failures, no request between": (
        lambda k: [failed(k, 1), failed(k, 2, "PAY-2")], (0, 1, True),
    ),
    "failure, request, failure": (
        lambda k: [failed(k, 1), request(k, 2), failed(k, 3)], (1, 3, False),
    ),
    "a bill does not clear the failure": (
        lambda k: [failed(k, 1), bill(k, 2), failed(k, 3)], (0, 1, True),
    ),
    "identical bill twice": (lambda k: [bill(k, 1), bill(k, 2)], (0, None, False)),
    "bills A, B, A": (lambda k: [bill(k, 1, 1), bill(k, 2, 2), bill(k, 3, 1)], (0, None, True)),
    "request before the bill": (lambda k: [request(k, 1), bill(k, 2)], (1, None, False)),
    "no bill": (lambda k: [request(k, 1)], (1, None, False)),
    "failures far apart": (lambda k: [failed(k, 1), failed(k, 100)], (0, 1, True)),
    "bills far apart": (lambda k: [bill(k, 1), bill(k, 100, 5)], (0, None, True)),
    "requests far apart": (
        lambda k: [request(k, 1), failed(k, 2), request(k, 90, "PAY-2"), request(k, 200)],
        (2, None, False),
    ),
}


@MODES
def test_billing_cases(spark, limits):
    events = [event for name, (make, _) in CASES.items() for event in make(name)]
    check_billing(spark, events, limits)
    rows = billing.billing_aggregate(frame(spark, events), **limits).where("page = 0").collect()
    assert {
        r.key: (r.paymentCount, r.lastPaymentFailed and r.lastPaymentFailed.failedAt, r.errored)
        for r in rows
    } == {name: expected for name, (_, expected) in CASES.items()}


@MODES
def test_chaser_case(spark, limits):
    """Two chasers of one name: the count starts at one before the first."""
    events = [chaser("key-1", 1, "chaser-A", 1000, 300), chaser("key-1", 2, "chaser-A", 2000, 450, 1000)]
    (row,) = chasers.chaser_aggregate(frame(spark, events), **limits).collect()
    assert (row.names, row["count"], row.latest, row.longest) == (["chaser-A"], 3, 2000, 450)
    (row,) = chasers.chaser_aggregate(frame(spark, events), count_seed=0, **limits).collect()
    assert row["count"] == 2


@MODES
def test_names_are_most_recent_first(spark, limits):
    events = [chaser("k", 1, "A", -5), chaser("k", 2, "B", -4), chaser("k", 3, "A", -3)]
    (row,) = chasers.chaser_aggregate(frame(spark, events), **limits).collect()
    assert (row.names, row.latest) == (["A", "B"], 0)


def test_null_keys_count_but_do_not_fold(spark):
    events = [bill(None, 1), nothing("K", 2), chaser("x", 3, "Bill-K"), bill("K", 3)]
    df = frame(spark, events)
    assert {r.count_key: r.n for r in counts.event_counts(df).collect()} == {
        "Bill-null": 1, "Bill-K": 2,
    }
    assert [r.key for r in billing.billing_aggregate(df).collect()] == ["K"]


def test_customers(spark):
    events = [bill("K", 1), request("K", 2, customer="C2"), failed(None, 3), chaser("K", 4, "A")]
    rows = billing.billing_customers(frame(spark, events)).collect()
    assert {r.customer_id: r.n_events for r in rows} == {"CUST-1": 2, "C2": 1}
