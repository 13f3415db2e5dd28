"""Scalar projections of an event."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefix of the count key per billing kind.
COUNT_PREFIX = {"Bill": "Bill-", "PaymentRequest": "PayReq-", "PaymentFailed": "PayFail-"}


def count_key() -> Column:
    """A chaser counts under its name, a billing event under its prefixed key.

    All share one key space. A null key renders as ``null``, so those events count too.
    """
    key = F.coalesce("key", F.lit("null"))
    out = F.when(F.col("kind") == "Chaser", F.col("chaser.name"))
    for kind, prefix in COUNT_PREFIX.items():
        out = out.when(F.col("kind") == kind, F.concat(F.lit(prefix), key))
    return out


def customer_id() -> Column:
    """Customer of a billing event, ``unknown`` for anything else."""
    return F.coalesce(
        "bill.customerId",
        "payment_request.customerId",
        "payment_failed.customerId",
        F.lit("unknown"),
    )
