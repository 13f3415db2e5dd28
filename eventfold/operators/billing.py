"""Billing state per key: current bill, payment requests, outstanding failure, error flag.

The rules, per event in ``seq`` order:

* a bill replaces the current one; replacing a different bill is an error;
* a payment request is listed unless its payment id is already, and clears the failure;
* a payment failure becomes the outstanding one; if there is one already, that is an
  error and the first one stays.

Errors stick. None of this needs a fold: a key is in error when its bills are not all
equal, or when a failure directly follows a failure among its requests and failures.
The outstanding failure is the first one after the last request.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventfold.functions.keys import customer_id
from eventfold.functions.ordered import (
    HOT_ROWS,
    MEASURE,
    PAGE_SIZE,
    RUN_BITS,
    before,
    joined,
    number,
    number_in_runs,
    of_each_page,
    page_of,
    run_of,
    split,
    upto,
    whole,
)
from eventfold.operators.lookup import of_key
from eventfold.schemas import BILLING_KINDS

IS_BILL = "kind = 'Bill'"
IS_REQUEST = "kind = 'PaymentRequest'"
IS_FAILURE = "kind = 'PaymentFailed'"
LIMITS = ("bill_low", "bill_high")


def billing_events(events: DataFrame) -> DataFrame:
    """The events that are folded; records without a key take no part."""
    return events.where(F.col("kind").isin(BILLING_KINDS) & F.col("key").isNotNull()).select(
        "key", "seq", "kind", "bill", "payment_request", "payment_failed"
    )


def billing_customers(events: DataFrame) -> DataFrame:
    """``customer_id, n_events`` over all billing events."""
    return (
        events.where(F.col("kind").isin(BILLING_KINDS))
        .groupBy(customer_id().alias("customer_id"))
        .agg(F.count(F.lit(1)).alias("n_events"))
    )


def _steps(in_order) -> dict[str, Column]:
    """Whether the request or failure before a row is a failure, and the last request of all."""
    step = F.when(F.expr(f"{IS_REQUEST} OR {IS_FAILURE}"), F.col("kind"))
    previous = F.last(step, ignorenulls=True).over(before(in_order))
    request_seq = F.when(F.expr(IS_REQUEST), F.col("seq"))
    return {
        "after_failure": F.coalesce(previous == "PaymentFailed", F.lit(False)),
        "last_request": F.max(request_seq).over(whole(in_order)),
    }


def _summary() -> list[Column]:
    """What the rows of a key, or of one run of it, come to.

    Needs the columns of ``_steps`` over the same rows beside the event.
    """
    opening = F.expr(
        f"{IS_FAILURE} AND NOT after_failure AND (last_request IS NULL OR seq > last_request)"
    )
    step_seq = F.when(F.expr(f"{IS_REQUEST} OR {IS_FAILURE}"), F.col("seq"))
    return [
        F.max_by("bill", F.when(F.expr(IS_BILL), F.col("seq"))).alias("bill"),
        F.min("bill").alias("bill_low"),
        F.max("bill").alias("bill_high"),
        F.min_by("payment_failed", F.when(opening, F.col("seq"))).alias("open_failure"),
        F.bool_or(F.expr(f"{IS_FAILURE} AND after_failure")).alias("repeated"),
        (F.min_by("kind", step_seq) == "PaymentFailed").alias("leads_with_failure"),
    ]


def errored() -> Column:
    """Whether a summary is in error."""
    return F.col("repeated") | ~F.col("bill_low").eqNullSafe(F.col("bill_high"))


def packed(states: DataFrame) -> DataFrame:
    """States without ``bill_low`` and ``bill_high`` where these are the ``bill``, as they mostly are."""
    return states.withColumns({n: F.when(~F.col(n).eqNullSafe(F.col("bill")), F.col(n)) for n in LIMITS})


def unpacked(states: DataFrame) -> DataFrame:
    """``packed`` states with all they had: a key with a bill has a lowest and a highest one."""
    return states.withColumns({n: F.coalesce(n, "bill") for n in LIMITS})


def _list_page(order: str = "seq") -> Column:
    listed = F.sort_array(F.collect_list(F.when(F.col("new"), F.struct(order, "payment_request"))))
    return F.transform(listed, lambda item: item["payment_request"]).alias("paymentRequests")


def billing_aggregate(
    events: DataFrame,
    hot: DataFrame | str | None = MEASURE,
    page_size: int = PAGE_SIZE,
    hot_rows: int = HOT_ROWS,
    run_bits: int = RUN_BITS,
) -> DataFrame:
    """The state per key after all events.

    ``key, page, bill, paymentRequests, paymentCount, lastPaymentFailed, errored``.
    Every page is a whole record, with all of the state; a list of more than ``page_size``
    payment requests is spread over pages 0, 1, 2, …, as a sink takes records of a bounded size.
    """
    cold, busy = split(billing_events(events), hot, hot_rows=hot_rows)
    return joined(
        _ordinary_records(cold, page_size), busy and _hot_records(busy, page_size, run_bits)
    )


def billing_of(
    events: DataFrame, key: str, page_size: int = PAGE_SIZE, run_bits: int = RUN_BITS
) -> DataFrame:
    """The state of one key, folded in runs as if it were hot: nothing is measured first."""
    return _hot_records(billing_events(of_key(events, key)), page_size, run_bits)


def _ordinary_records(rows: DataFrame, page_size: int) -> DataFrame:
    """All in one shuffle on the key: two window sorts, then one aggregation."""
    by_payment = Window.partitionBy("key", "kind", "payment_request.paymentId").orderBy("seq")
    in_order = Window.partitionBy("key").orderBy("seq")
    new = F.col("new").cast("long")
    by_page = Window.partitionBy("key").orderBy("page")
    # further pages hold requests that are listed and nothing else, so page 0 knows the state
    state = ["bill", "bill_low", "bill_high", "open_failure", "repeated"]
    return (
        rows.repartition("key")
        .withColumn("new", F.expr(IS_REQUEST) & (F.row_number().over(by_payment) == 1))
        .withColumns(
            {
                **_steps(in_order),
                "position": F.sum(new).over(upto(in_order)),
                "payment_count": F.sum(new).over(whole(in_order)),
            }
        )
        .withColumn("page", F.when(F.col("new"), page_of("position", page_size)).otherwise(0))
        .groupBy("key", "page")
        .agg(_list_page(), F.first("payment_count").alias("payment_count"), *_summary())
        .withColumns({name: F.first(name).over(by_page) for name in state})
        .select(
            "key",
            "page",
            "bill",
            "paymentRequests",
            F.col("payment_count").alias("paymentCount"),
            F.col("open_failure").alias("lastPaymentFailed"),
            errored().alias("errored"),
        )
    )


def _hot_records(rows: DataFrame, page_size: int, run_bits: int) -> DataFrame:
    requests = first_requests(rows).withColumn("run", run_of("seq", run_bits))
    listed = number_in_runs(requests, ["key"], ["run"], [F.col("seq")], "position")
    return billing_records(billing_runs(rows, run_bits), listed, page_size)


def billing_runs(rows: DataFrame, run_bits: int = RUN_BITS) -> DataFrame:
    """One summary row per (key, run): fixed in size and mergeable in ``first_seq`` order."""
    in_order = Window.partitionBy("key", "run").orderBy("seq")
    return (
        rows.drop("payment_request")
        .withColumn("run", run_of("seq", run_bits))
        .withColumns(_steps(in_order))
        .groupBy("key", "run")
        .agg(
            F.min("seq").alias("first_seq"),
            F.bool_or(F.expr(IS_REQUEST)).alias("has_request"),
            *_summary(),
        )
    )


def first_requests(rows: DataFrame) -> DataFrame:
    """``key, paymentId, seq, payment_request``: the first request of each payment id.

    Payments are partially aggregated before the shuffle, which is on the payment and
    not on the key. Merging tables of several micro-batches takes the same call again; their
    rows have the batch they ``arrived`` in, and an earlier one comes first.
    """
    requests = rows.where("payment_request IS NOT NULL")
    if "paymentId" not in requests.columns:
        requests = requests.withColumn("paymentId", F.col("payment_request.paymentId"))
    order = [name for name in ("arrived", "seq") if name in requests.columns]
    first = F.min_by(F.struct(*order, "payment_request"), F.struct(*order)).alias("first")
    return requests.groupBy("key", "paymentId").agg(first).select("key", "paymentId", "first.*")


def _run_order(runs: DataFrame) -> list[str]:
    return [name for name in ("batch", "first_seq") if name in runs.columns]


def settle(runs: DataFrame) -> DataFrame:
    """State of each key after every one of its runs.

    Runs are taken in ``first_seq`` order, those of several micro-batches by ``batch`` first.
    Adds ``bill_after, failure_after, errored_after``. A run with a request leaves its own
    open failure; one without passes on the failure it found.
    """
    order = _run_order(runs)
    in_order = Window.partitionBy("key").orderBy(*order)
    in_stretch = Window.partitionBy("key", "stretch").orderBy(*order)
    return (
        runs.withColumn("stretch", F.sum(F.col("has_request").cast("long")).over(upto(in_order)))
        .withColumn("failure_after", F.first("open_failure", ignorenulls=True).over(upto(in_stretch)))
        .withColumn(
            "repeated",
            F.col("repeated")
            | (
                F.coalesce("leads_with_failure", F.lit(False))
                & F.lag("failure_after").over(in_order).isNotNull()
            ),
        )
        .withColumns(
            {
                "bill_after": F.last("bill", ignorenulls=True).over(upto(in_order)),
                "bill_low": F.min("bill_low").over(upto(in_order)),
                "bill_high": F.max("bill_high").over(upto(in_order)),
                "repeated": F.max("repeated").over(upto(in_order)),
            }
        )
        .withColumn("errored_after", errored())
    )


def number_requests(
    requests: DataFrame, hot: DataFrame | str | None = MEASURE, run_bits: int = RUN_BITS
) -> DataFrame:
    """Add the list ``position`` of each of the ``first_requests``."""
    rows = requests.withColumn("run", run_of("seq", run_bits))
    arrived = [name for name in ("arrived",) if name in rows.columns]
    order = [F.col(name) for name in (*arrived, "seq")]
    return number(rows, "key", [*arrived, "run"], order, "position", hot)


def merge_runs(runs: DataFrame) -> DataFrame:
    """All runs of a key as one run: a summary that stands for its whole history so far."""
    order = F.struct(*_run_order(runs))
    last = F.max_by(F.struct("bill_after", "failure_after", "repeated"), order).alias("last")
    led = F.when(F.col("leads_with_failure").isNotNull(), order)
    return (
        settle(runs)
        .groupBy("key")
        .agg(
            F.min("run").alias("run"),
            F.min("first_seq").alias("first_seq"),
            F.bool_or("has_request").alias("has_request"),
            F.min("bill_low").alias("bill_low"),
            F.max("bill_high").alias("bill_high"),
            F.min_by("leads_with_failure", led).alias("leads_with_failure"),
            last,
        )
        .select(
            "key",
            "run",
            "first_seq",
            "has_request",
            F.col("last.bill_after").alias("bill"),
            "bill_low",
            "bill_high",
            F.col("last.failure_after").alias("open_failure"),
            F.col("last.repeated").alias("repeated"),
            "leads_with_failure",
        )
    )


def billing_records(
    runs: DataFrame, requests: DataFrame, page_size: int = PAGE_SIZE
) -> DataFrame:
    """The records from run summaries and numbered first requests, whatever wrote them.

    Only run summaries and one count per key meet in a task; the requests of a key are
    gathered a page at a time.
    """
    last = F.max_by(
        F.struct("bill_after", "failure_after", "errored_after"), F.struct(*_run_order(runs))
    ).alias("last")
    # a plain count, so that this branch reads neither the requests nor their positions
    counts = requests.groupBy("key").agg(F.count(F.lit(1)).alias("paymentCount"))
    state = (
        settle(runs)
        .groupBy("key")
        .agg(last)
        .join(counts, "key", "left")
        .withColumn("paymentCount", F.coalesce("paymentCount", F.lit(0).cast("long")))
        .select(
            "key",
            page_of(F.greatest("paymentCount", F.lit(1)), page_size).alias("last_page"),
            F.col("last.bill_after").alias("bill"),
            "paymentCount",
            F.col("last.failure_after").alias("lastPaymentFailed"),
            F.col("last.errored_after").alias("errored"),
        )
    )
    pages = (
        requests.withColumn("new", F.lit(True))
        .groupBy("key", page_of("position", page_size).alias("page"))
        .agg(_list_page("position"))
    )
    records = of_each_page(state).join(pages, ["key", "page"], "left").withColumn(
        "paymentRequests", F.coalesce("paymentRequests", F.array())
    )
    return records.select(
        "key", "page", "bill", "paymentRequests", "paymentCount", "lastPaymentFailed", "errored"
    )


def billing_changelog(
    events: DataFrame,
    hot: DataFrame | str | None = MEASURE,
    hot_rows: int = HOT_ROWS,
    run_bits: int = RUN_BITS,
) -> DataFrame:
    """The state after every event, with the list as what the event added to it.

    ``key, seq, kind, bill, addedRequest, paymentCount, lastPaymentFailed, errored``. The
    list after a row is the key's first ``paymentCount`` added requests, so the changelog
    is whole and yet linear in the number of events.
    """
    cold, busy = split(billing_events(events), hot, hot_rows=hot_rows)
    by_payment = Window.partitionBy("key", "kind", "payment_request.paymentId").orderBy("seq")
    cold = cold.repartition("key").withColumns(
        {
            "new": F.expr(IS_REQUEST) & (F.row_number().over(by_payment) == 1),
            "run": F.lit(0).cast("long"),
        }
    )
    return joined(_running(cold), busy and _running(_with_carry(busy, run_bits)))


def changelog_from(
    rows: DataFrame, runs: DataFrame, fresh: DataFrame, start: DataFrame, run_bits: int = RUN_BITS
) -> DataFrame:
    """The changelog of ``billing_events`` of keys that have had others before.

    ``runs`` are the rows' ``billing_runs``, ``fresh`` is ``key, seq`` of the requests whose payment
    id is new, ``start`` the state of the keys by then: a row of ``merge_runs`` with the ``payments``
    listed. Every key is folded in runs.
    """
    return _running(_with_carry(rows, run_bits, runs, fresh, start))


def continued(
    rows: DataFrame, known: DataFrame, start: DataFrame, run_bits: int = RUN_BITS, changelog: bool = True
) -> DataFrame:
    """The changelog of ``billing_events`` of ordinary keys that go on from earlier ones, and their state.

    ``known`` is ``key, paymentId`` of the requests listed so far, ``start`` the state of the keys by
    then, as for ``changelog_from``; both may have other keys. Beside the columns of
    ``billing_changelog`` the last row of a key has its ``state``, a row of ``start`` as it is
    now (with ``billed`` for ``billed_at``, and ``listed`` for the payments it had). Without
    ``changelog`` there are only rows that list a request or have a state.

    One shuffle on the key and two sorts, which take a hash of the key first: keys are alike in
    their leading characters. The shuffle carries nothing twice; what can be told from a row is
    added after it.
    """
    request = F.col("payment_request")
    listed = known.where("paymentId IS NOT NULL").select("key", "paymentId")
    was = F.struct(*[c for c in start.columns if c not in ("key", "open_failure")], "errored")
    before_it = packed(start.withColumn("errored", errored()))
    all_rows = (
        rows.unionByName(listed, allowMissingColumns=True)
        .unionByName(
            before_it.select("key", F.col("open_failure").alias("payment_failed"), was.alias("was")),
            allowMissingColumns=True,
        )
        .repartition("key")
        .withColumns(
            {
                "asks": request.isNotNull() | F.col("paymentId").isNotNull(),
                "paymentId": F.coalesce(request["paymentId"], "paymentId"),
                "arrived": F.col("kind").isNotNull().cast("int"),
                "bill": F.coalesce("bill", "was.bill"),
                "h": F.xxhash64("key"),
            }
        )
    )
    by_payment = Window.partitionBy("h", "key", "asks", "paymentId").orderBy("arrived", "seq")
    in_order = Window.partitionBy("h", "key").orderBy(F.col("seq").asc_nulls_first())
    so_far, earlier, all_of = upto(in_order), before(in_order), whole(in_order)
    is_bill, is_request, is_failure = (F.coalesce(F.expr(k), F.lit(False)) for k in (IS_BILL, IS_REQUEST, IS_FAILURE))
    # a state stands for the events that led to it: an open failure for the failure that left it
    step = F.when(is_request, "request").when(F.col("payment_failed").isNotNull(), "failure")
    follows = F.coalesce(F.last("step", ignorenulls=True).over(earlier) == "failure", F.lit(False))
    bill_before = F.last("bill", ignorenulls=True).over(earlier)
    leads = F.coalesce("was.leads_with_failure", F.when(is_request | is_failure, is_failure))
    state = F.struct(
        F.min(F.coalesce("was.run", run_of("seq", run_bits))).over(all_of).alias("run"),
        F.min(F.coalesce("was.first_seq", "seq")).over(all_of).alias("first_seq"),
        F.max(F.coalesce("was.has_request", is_request)).over(all_of).alias("has_request"),
        F.last("bill", ignorenulls=True).over(all_of).alias("bill"),
        F.min(F.when(F.col("was").isNotNull(), F.coalesce("was.bill_low", "bill")).when(is_bill, F.col("bill"))).over(all_of).alias("bill_low"),
        F.max(F.when(F.col("was").isNotNull(), F.coalesce("was.bill_high", "bill")).when(is_bill, F.col("bill"))).over(all_of).alias("bill_high"),
        F.max(F.coalesce("was.repeated", is_failure & F.col("follows"))).over(all_of).alias("repeated"),
        F.first(leads, ignorenulls=True).over(all_of).alias("leads_with_failure"),
        F.sum(F.coalesce("was.payments", F.col("new").cast("long"))).over(all_of).alias("payments"),
        F.max(F.coalesce("was.last_seq", "seq")).over(all_of).alias("last_seq"),
        F.max(is_bill).over(all_of).alias("billed"),
        F.max("was.billed_at").over(all_of).alias("billed_at"),
        F.max("was.payments").over(all_of).alias("listed"),
    )
    opened = F.last("opening", ignorenulls=True).over(so_far)
    bill = F.last("bill", ignorenulls=True).over(so_far)
    last = F.lead(F.lit(1)).over(in_order).isNull()
    out = (
        all_rows.withColumn("new", F.col("asks") & (F.col("arrived") == 1) & (F.row_number().over(by_payment) == 1))
        .where("kind IS NOT NULL OR was IS NOT NULL")
        .withColumn("step", step)
        .withColumns({"follows": follows, "bill_before": bill_before})
        .withColumns(
            {
                "error": F.coalesce(
                    "was.errored",
                    (is_bill & F.col("bill_before").isNotNull() & ~F.col("bill_before").eqNullSafe(F.col("bill")))
                    | (is_failure & F.col("follows")),
                ),
                "opening": F.when(~F.col("follows"), F.col("payment_failed")),
            }
        )
        .withColumns(
            {
                "addedRequest": F.when(F.col("new"), request),
                "paymentCount": F.sum(F.coalesce("was.payments", F.col("new").cast("long"))).over(so_far),
                "lastPaymentFailed": F.when(F.last("step", ignorenulls=True).over(so_far) == "failure", opened),
                "bill_now": bill,
                "errored": F.max("error").over(so_far),
                "last": last,
                "state": state,
            }
        )
        .where("seq IS NOT NULL")
        .withColumn("state", F.when(F.col("last"), F.col("state")))
    )
    if not changelog:
        keep = F.col("last")
        out = out.where("last OR new").withColumn("lastPaymentFailed", F.when(keep, F.col("lastPaymentFailed")))
        return out.select("key", "seq", "addedRequest", "paymentCount", "lastPaymentFailed", "state")
    return out.select(
        "key", "seq", "kind", F.col("bill_now").alias("bill"), "addedRequest", "paymentCount", "lastPaymentFailed", "errored", "state"
    )


def _mark_first_requests(rows, run_bits, fresh=None):
    """Flag the first request of each payment id by placing a mark right before it."""
    if fresh is None:
        fresh = (
            rows.where(IS_REQUEST)
            .groupBy("key", "payment_request.paymentId")
            .agg(F.min("seq").alias("seq"))
        )
    marks = fresh.select("key", "seq", F.lit(1).alias("mark"))
    inside = Window.partitionBy("key", "run").orderBy("seq", F.col("mark").desc())
    return (
        rows.withColumn("mark", F.lit(0))
        .unionByName(marks, allowMissingColumns=True)
        .withColumn("run", run_of("seq", run_bits))
        .withColumn("new", F.coalesce(F.lag("mark").over(inside) == 1, F.lit(False)))
        .where("mark = 0")
        .drop("mark")
    )


def _with_carry(rows, run_bits, runs=None, fresh=None, start=None):
    """Add to each run a row holding the state before it; it has no ``seq``."""
    marked = _mark_first_requests(rows, run_bits, fresh)
    added = marked.groupBy("key", "run").agg(F.count_if("new").alias("added"))
    runs = billing_runs(rows, run_bits) if runs is None else runs
    runs = runs.join(added, ["key", "run"]).withColumn("batch", F.lit(1))
    if start is not None:
        earlier = start.withColumn("batch", F.lit(0)).withColumn("added", F.col("payments"))
        runs = runs.unionByName(earlier.select(*runs.columns))
    in_order = Window.partitionBy("key").orderBy("batch", "first_seq")
    carried = (
        settle(runs)
        .select(
            "key",
            "run",
            "batch",
            F.sum("added").over(before(in_order)).alias("carried_count"),
            F.lag("bill_after").over(in_order).alias("bill"),
            F.lag("failure_after").over(in_order).alias("payment_failed"),
            F.lag("errored_after").over(in_order).alias("carried_error"),
        )
        .where("batch = 1 AND carried_count IS NOT NULL")
        .drop("batch")
    )
    return marked.unionByName(carried, allowMissingColumns=True)


def _running(rows):
    """The state after every row of each (key, run), starting from its carried row if any."""
    for name, kind in (("carried_count", "long"), ("carried_error", "boolean")):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    in_order = Window.partitionBy("key", "run").orderBy(F.col("seq").asc_nulls_first())
    so_far, earlier = upto(in_order), before(in_order)
    # A carried failure stands for the failure event that left it.
    step = F.when(F.expr(IS_REQUEST), F.lit("request")).when(
        F.col("payment_failed").isNotNull(), F.lit("failure")
    )
    follows_failure = F.coalesce(
        F.last(step, ignorenulls=True).over(earlier) == "failure", F.lit(False)
    )
    bill_before = F.last("bill", ignorenulls=True).over(earlier)
    return (
        rows.withColumns(
            {
                "step": step,
                "follows_failure": follows_failure,
                "conflict": F.expr(IS_BILL)
                & bill_before.isNotNull()
                & ~bill_before.eqNullSafe(F.col("bill")),
            }
        )
        .withColumns(
            {
                "error": F.coalesce(
                    "carried_error",
                    F.col("conflict") | (F.expr(IS_FAILURE) & F.col("follows_failure")),
                ),
                "opening": F.when(~F.col("follows_failure"), F.col("payment_failed")),
            }
        )
        .select(
            "key",
            "seq",
            "kind",
            F.last("bill", ignorenulls=True).over(so_far).alias("bill"),
            F.when(F.col("new"), F.col("payment_request")).alias("addedRequest"),
            F.sum(F.coalesce("carried_count", F.col("new").cast("long")))
            .over(so_far)
            .alias("paymentCount"),
            F.when(
                F.last("step", ignorenulls=True).over(so_far) == "failure",
                F.last("opening", ignorenulls=True).over(so_far),
            ).alias("lastPaymentFailed"),
            F.max("error").over(so_far).alias("errored"),
        )
        .where("seq IS NOT NULL")
    )
