"""What a stream and its replay may cost: events written once, ordinary keys in one shuffle."""

import random

import pytest
from events import bill, failed, frame, request
from pyspark.sql import Observation
from pyspark.sql import functions as F
from test_kept import Stream, billing_of, rows_of

import fold
from eventfold.operators import billing
from eventfold.plans import replay as replays
from eventfold.session import scratch
from eventfold.sources import tables
from eventfold.streaming import kept


def some(n, seed, start=0):
    rng = random.Random(seed)
    kinds = [lambda k, i: bill(k, i, amount=rng.randrange(2)), lambda k, i: request(k, i, f"P{rng.randrange(9)}"), failed]
    return [rng.choice(kinds)(rng.choice("abcde"), start + i) for i in range(n)]


@pytest.mark.parametrize("hot_rows", [10**6, 0], ids=["ordinary", "hot"])
def test_billing_of_ordinary_and_of_hot_keys(spark, hot_rows):
    s = Stream(spark, kept.keep_billing, "billing", changelog=True, publish=True, page_size=3, hot_rows=hot_rows)
    so_far = []
    for i in range(2):
        part = some(60, i, 60 * i)
        s.play(part)
        so_far += part
    expected, _ = fold.billing_states(so_far)
    assert billing_of(kept.kept_billing(spark, s.table, page_size=3)) == expected
    assert billing_of(kept.assembled_billing(kept.kept_log(spark, s.table, "pages"))) == expected
    assert rows_of(kept.kept_log(spark, s.table)) == rows_of(billing.billing_changelog(frame(spark, so_far)))


def test_ordinary_keys_take_one_shuffle(spark):
    rows = billing.billing_events(frame(spark, some(20, 3)))
    known = rows.select("key", F.lit("P1").alias("paymentId"))
    start = kept._billing_state(
        rows, billing.billing_runs(rows), billing.first_requests(rows), rows.sparkSession.createDataFrame(
            [], "key string, payments long, last_seq long, billed_at long"
        ).join(billing.merge_runs(billing.billing_runs(rows)), "key"), 0,
    )
    start = spark.createDataFrame(start.collect(), start.schema)
    plan = billing.continued(rows, known, start)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_replay_writes_events_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(replays, "scratch", lambda s, name: made.append(scratch(s, name)) or made[-1])
    counted = []
    events = frame(spark, some(50, 4)).observe(seen := Observation(), F.count("*").alias("n"))

    def begin(stream):
        counted.append(spark.read.parquet(made[1]).count())
        return kept.keep_counts(stream, *tables_of, buckets=2)

    tables_of = scratch(spark, "t"), scratch(spark, "c")
    replays.replay(events, (F.col("seq") / 20).cast("int"), 4, begin)
    assert counted == [20, 40, 50, 50] and seen.get["n"] == 50
    assert not [f for f in spark.read.option("recursiveFileLookup", True).schema("key string").parquet(made[0]).inputFiles()]


def test_customers_and_numbers_in_one_shuffle(spark, tmp_path):
    """Payments take the customer of their order, bills keep their own, other keys are numbered apart."""
    at = "TIMESTAMP_NTZ'2020-01-0{}'"
    orders = [(9, 5, "P", 1), (9, 7, "O", 2), (10, 3, "P", 3), (None, 8, "O", 1)]
    lines = [(9, 1, 1), (9, 2, 2), (10, 1, 1), (10, 2, 9), (11, 1, 1), (None, 1, 2)]
    q = " UNION ALL ".join(
        f"SELECT {k or 'CAST(NULL AS BIGINT)'} o_orderkey, {c} o_custkey, '{s}' o_orderstatus, 1.5D o_totalprice, {at.format(d)} o_orderdate, '' o_orderpriority"
        for k, c, s, d in orders
    )
    spark.sql(q).selectExpr("CAST(o_orderkey AS BIGINT) o_orderkey", "CAST(o_custkey AS BIGINT) o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    q = " UNION ALL ".join(
        f"SELECT CAST({k or 'NULL'} AS BIGINT) l_orderkey, 1L l_partkey, 1L l_suppkey, {n} l_linenumber, 1D l_quantity, 2D l_extendedprice, 0D l_discount, 0D l_tax, 'N' l_returnflag, 'F' l_linestatus, {at.format(d)} l_shipdate"
        for k, n, d in lines
    )
    spark.sql(q).write.parquet(f"{tmp_path}/lineitem.parquet")
    log = tables.billing_log(spark, str(tmp_path))
    assert log._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = {(r.key, r.seq, r.kind, (r.bill or r.payment_request).customerId) for r in log.where("key IS NOT NULL").collect()}
    assert got == {
        ("INV-9", 1, "Bill", "CUST-5"), ("INV-9", 2, "Bill", "CUST-7"), ("INV-9", 3, "Bill", "CUST-5"),
        ("BILL-9", 1, "PaymentRequest", "CUST-7"), ("BILL-9", 2, "PaymentRequest", "CUST-7"),
        ("BILL-10", 1, "PaymentRequest", "CUST-3"), ("BILL-10", 2, "Bill", "CUST-3"),
        ("BILL-10", 3, "PaymentRequest", "CUST-3"), ("BILL-10", 4, "Bill", "CUST-3"),
        ("BILL-11", 1, "PaymentRequest", "unknown"),
    }
    assert {r.customerId for r in log.where("key IS NULL").select("payment_request.customerId").collect()} <= {"unknown", None}
