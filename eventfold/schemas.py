"""Record types of the event log.

The field names are those of the Avro and JSON records on the wire, so they stay
in camel case inside the structs.
"""

from pyspark.sql import types as T

_S, _L = T.StringType(), T.LongType()


def _record(**fields):
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


CHASER = _record(name=_S, id=_S, sent=_L, ttl=_L, previous=_L)
BILL = _record(
    billId=_S, customerId=_S, orderId=_S, amountCents=_L, currency=_S, issuedAt=_L, dueDate=_L
)
PAYMENT_REQUEST = _record(
    paymentId=_S, billId=_S, customerId=_S, amountCents=_L, currency=_S, requestedAt=_L
)
PAYMENT_FAILED = _record(paymentId=_S, billId=_S, customerId=_S, failureReason=_S, failedAt=_L)
AGGREGATE = _record(names=T.ArrayType(_S), count=_L, latest=_L, longest=_L)
BILL_AGGREGATE = _record(
    bill=BILL,
    paymentRequests=T.ArrayType(PAYMENT_REQUEST),
    lastPaymentFailed=PAYMENT_FAILED,
    errored=T.BooleanType(),
)

# Record kind, schema domain, envelope column, type.
RECORDS = [
    ("Chaser", "chaser", "chaser", CHASER),
    ("Aggregate", "chaser", "aggregate", AGGREGATE),
    ("Bill", "billing", "bill", BILL),
    ("PaymentRequest", "billing", "payment_request", PAYMENT_REQUEST),
    ("PaymentFailed", "billing", "payment_failed", PAYMENT_FAILED),
    ("BillAggregate", "billing", "bill_aggregate", BILL_AGGREGATE),
]
TYPE_OF = {kind: record for kind, _, _, record in RECORDS}
COLUMN_OF = {kind: column for kind, _, column, _ in RECORDS}

# Fields that may be null on the wire; every other field is required.
NULLABLE = {
    "Chaser": {"previous"},
    "Aggregate": {"latest", "longest"},
    "BillAggregate": {"bill", "lastPaymentFailed"},
}

INPUT_KINDS = ["Chaser", "Bill", "PaymentRequest", "PaymentFailed"]
BILLING_KINDS = ["Bill", "PaymentRequest", "PaymentFailed"]

EVENT = T.StructType(
    [T.StructField("key", _S), T.StructField("seq", _L), T.StructField("kind", _S)]
    + [T.StructField(COLUMN_OF[kind], TYPE_OF[kind]) for kind in INPUT_KINDS]
)
FRAME = T.StructType(
    [T.StructField("key", _S), T.StructField("seq", _L), T.StructField("value", T.BinaryType())]
)


def full_name(kind: str, namespace: str = "events") -> str:
    """Full record name, e.g. ``events.billing.Bill``; deployments pass their own root."""
    domain = next(domain for name, domain, _, _ in RECORDS if name == kind)
    return f"{namespace}.{domain}.{kind}"
