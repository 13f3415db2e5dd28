"""The rules, one event at a time: what the operators are checked against."""

from collections import defaultdict

PREFIX = {"Bill": "Bill-", "PaymentRequest": "PayReq-", "PaymentFailed": "PayFail-"}


def count_key(event):
    if event["kind"] == "Chaser":
        return event["chaser"]["name"]
    return PREFIX[event["kind"]] + (event["key"] if event["key"] is not None else "null")


def counts(events):
    """Final counts and the count after each event, in (seq, kind, key) order."""
    total, log = defaultdict(int), []
    for e in sorted(events, key=lambda e: (e["seq"], e["kind"] or "", e["key"] or "")):
        if e["kind"] is None:
            continue
        total[count_key(e)] += 1
        log.append((count_key(e), e["seq"], total[count_key(e)]))
    return dict(total), log


def chaser_states(events, seed=1):
    """(key, seq) -> (names, count, latest, longest) after each chaser."""
    state, log = {}, {}
    for e in sorted(events, key=lambda e: e["seq"]):
        if e["kind"] != "Chaser" or e["key"] is None:
            continue
        c = e["chaser"]
        names, n, latest, longest = state.get(e["key"], ([], seed, 0, 0))
        names = [c["name"]] + [x for x in names if x != c["name"]]
        now = (names, n + 1, max(latest, c["sent"]), max(longest, c["ttl"]))
        state[e["key"]] = log[e["key"], e["seq"]] = now
    return state, log


def billing_states(events):
    """(key, seq) -> (bill, requests, failure, errored) after each billing event."""
    state, log = {}, {}
    for e in sorted(events, key=lambda e: e["seq"]):
        if e["kind"] not in PREFIX or e["key"] is None:
            continue
        bill, requests, failure, errored = state.get(e["key"], (None, [], None, False))
        if e["kind"] == "Bill":
            errored = errored or (bill is not None and bill != e["bill"])
            bill = e["bill"]
        elif e["kind"] == "PaymentRequest":
            request = e["payment_request"]
            if all(request["paymentId"] != r["paymentId"] for r in requests):
                requests = requests + [request]
            failure = None
        elif failure is not None:
            errored = True
        else:
            failure = e["payment_failed"]
        state[e["key"]] = log[e["key"], e["seq"]] = (bill, requests, failure, errored)
    return state, log
