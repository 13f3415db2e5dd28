"""Event builders and random logs."""

from hypothesis import strategies as st

from eventfold.schemas import EVENT

EMPTY = {"chaser": None, "bill": None, "payment_request": None, "payment_failed": None}


def chaser(key, seq, name, sent=0, ttl=0, previous=None, id="id"):
    value = {"name": name, "id": id, "sent": sent, "ttl": ttl, "previous": previous}
    return {**EMPTY, "key": key, "seq": seq, "kind": "Chaser", "chaser": value}


def bill(key, seq, amount=1000, customer="CUST-1"):
    value = {
        "billId": key or "none", "customerId": customer, "orderId": "ORDER-1", "amountCents": amount,
        "currency": "USD", "issuedAt": 100, "dueDate": 200,
    }
    return {**EMPTY, "key": key, "seq": seq, "kind": "Bill", "bill": value}


def request(key, seq, payment="PAY-1", at=None, customer="CUST-1"):
    value = {
        "paymentId": payment, "billId": key or "none", "customerId": customer, "amountCents": 1000,
        "currency": "USD", "requestedAt": seq if at is None else at,
    }
    return {**EMPTY, "key": key, "seq": seq, "kind": "PaymentRequest", "payment_request": value}


def failed(key, seq, payment="PAY-1", at=None, customer="CUST-1"):
    value = {
        "paymentId": payment, "billId": key or "none", "customerId": customer,
        "failureReason": "NSF", "failedAt": seq if at is None else at,
    }
    return {**EMPTY, "key": key, "seq": seq, "kind": "PaymentFailed", "payment_failed": value}


def nothing(key, seq):
    return {**EMPTY, "key": key, "seq": seq, "kind": None}


def frame(spark, events):
    rows = [tuple(e[f.name] for f in EVENT) for e in events]
    return spark.createDataFrame(rows, EVENT)


def _event(draw, seq):
    key = draw(st.sampled_from(["a", "b", "c", None]))
    kind = draw(st.integers(0, 9))
    payment = f"PAY-{draw(st.integers(0, 6))}"
    if kind < 2:
        return bill(key, seq, draw(st.sampled_from([1000, 1000, 2000])))
    if kind < 4:
        return request(key, seq, payment)
    if kind < 6:
        return failed(key, seq, payment)
    if kind < 9:
        return chaser(
            key, seq, draw(st.sampled_from(["A", "B", "C", "D", "Bill-a"])),
            draw(st.integers(-50, 50)), draw(st.integers(-50, 50)),
        )
    return nothing(key, seq)


@st.composite
def logs(draw, max_size=60):
    """Logs whose ``seq`` values are unique and rise with gaps."""
    events, seq = [], draw(st.integers(0, 3))
    for _ in range(draw(st.integers(1, max_size))):
        events.append(_event(draw, seq))
        seq += draw(st.sampled_from([1, 1, 1, 2, 5]))
    return draw(st.permutations(events))
