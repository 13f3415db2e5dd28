"""The three folds as streams that keep current state, its changelog and its pages.

Each stream takes micro-batches of plain events and keeps a table of ``state``. A micro-batch
reads the state of the keys it touches, from the buckets they fall in, folds its events on top with
the batch operators, and writes what changed. So the cost of a micro-batch follows what it touches,
not the life of the stream; a record is served from state, not folded again.

* ``changelog`` adds a row for each event, as the batch changelogs give, to a log part. Runs of a
  micro-batch are seeded with a carry row from state, so stretches join without a seam.
* ``publish`` keeps the record pages that changed in a log part, one version for each micro-batch.
  A billing page changes if requests were added to it; a key whose list stayed shows its state on
  its last page. A chaser page is a stretch of *slots*: a name that is seen takes the next slot of
  its key and leaves its old one empty, so only the page it left and the page it came to change,
  and no other name moves. Readers put pages together by ``assembled_billing`` and
  ``assembled_chasers``.
* Meters are added up in the manifest, so they survive restarts and count nothing twice.

State, changelog, pages and meters of a micro-batch become visible together (``streaming.state``).
Counts and chasers are folded in runs whatever the key, which bounds what a task holds of a hot one.
Billing counts the events of each key of a micro-batch first, from the key column alone: ordinary
keys take one shuffle on the key, hot ones runs. So the rows of a billing micro-batch are read twice.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from eventfold.functions.keys import count_key
from eventfold.functions.ordered import (
    BROADCAST_KEYS,
    PAGE_SIZE,
    RUN_BITS,
    number_in_runs,
    of_each_page,
    page_of,
    run_of,
    split,
)
from eventfold.operators import billing, chaser
from eventfold.operators.counts import countable
from eventfold.operators.lookup import not_blank
from eventfold.schemas import EVENT
from eventfold.session import DROP_SHUFFLES
from eventfold.streaming import state
from eventfold.streaming.sinks import start as started
from eventfold.streaming.state import BUCKETS, Manifest

BY_KEY = ["key"]


def _still(rows: DataFrame) -> DataFrame:
    """An empty table of the stream's columns."""
    return rows.sparkSession.createDataFrame([], rows.schema)


class _Batch:
    """A micro-batch being folded: what it starts from, what it keeps, what it writes."""

    def __init__(self, rows: DataFrame, table: str, known: Manifest, number: int, hold: bool = True):
        self.spark, self.table, self.known, self.number = rows.sparkSession, table, known, number
        # streams turn it off for their own plans; what is planned here is plain batch work
        self.spark.conf.set("spark.sql.adaptive.enabled", "true")
        self.spark.conf.set(DROP_SHUFFLES, "true")
        self.held: list[DataFrame] = []
        self.rows = self.keep(rows) if hold else rows
        self.next = known

    def keep(self, df: DataFrame) -> DataFrame:
        self.held.append(df.persist())
        return df

    def stage(self, df: DataFrame) -> DataFrame:
        """As ``keep``, for what is as large as the micro-batch: in files, which take no memory."""
        return state.stage(self.spark, self.table, df, self.number)

    def look(self, *totals) -> list:
        """One pass: totals of each bucket that is touched."""
        bucket = state.bucket_of("key", self.known.buckets)
        found = self.rows.groupBy(bucket.alias("bucket")).agg(*totals).collect()
        self.buckets = sorted(r.bucket for r in found)
        return found

    def count_by_key(self) -> DataFrame:
        """One pass over the keys: ``key, n``, and the buckets that are touched."""
        counted = self.keep(self.rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")))
        bucket = state.bucket_of("key", self.known.buckets).alias("bucket")
        self.buckets = sorted(r.bucket for r in counted.select(bucket).distinct().collect())
        return counted

    def look_by_key(self, hot_rows: int) -> tuple[list, DataFrame | None]:
        """One pass over the keys: rows of each bucket that is touched, and the hot keys if any."""
        counted = self.rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        bucket = state.bucket_of("key", self.known.buckets).alias("bucket")
        found = counted.groupBy(bucket).agg(F.sum("n").alias("n"), F.count_if(F.col("n") > hot_rows).alias("hot")).collect()
        self.buckets = sorted(r.bucket for r in found)
        hot = counted.where(F.col("n") > hot_rows).select("key")
        many = sum(r.hot for r in found)
        if many:  # measured once, as the rows may be costly to read
            hot = self.keep(hot)
            hot = F.broadcast(hot) if many <= BROADCAST_KEYS else hot
        return found, hot if many else None

    def read(self, part: str, keys: list[str] | None = None) -> DataFrame:
        return state.read(self.spark, self.table, self.known, part, self.buckets, keys)

    def write(self, part: str, rows: DataFrame, keys: list[str] | None = None, once: bool = False) -> None:
        args = self.spark, self.table, self.next, part, rows, self.number, self.buckets, keys, once
        self.next = state.write(*args)

    def append(self, part: str, rows: DataFrame) -> None:
        self.next = state.append(self.spark, self.table, self.next, part, rows, self.number)

    def commit(self, meters: dict) -> None:
        done = {**vars(self.next), "batch": self.number, "meters": meters}
        state.commit(self.spark, self.table, Manifest(**done))


def _run(
    rows: DataFrame,
    parts: dict[str, DataFrame],
    fold: Callable[[_Batch], dict],
    table: str,
    checkpoint: str,
    every: str | None,
    buckets: int,
    hold: bool = True,
) -> StreamingQuery:
    """Start a stream whose micro-batches are folded and committed one by one."""
    state.create(rows.sparkSession, table, checkpoint, buckets, parts)

    def each(batch_rows: DataFrame, number: int) -> None:
        known = state.begun(batch_rows.sparkSession, table, number)
        if known is None:
            return
        batch = _Batch(batch_rows, table, known, number, hold)
        try:
            batch.commit(fold(batch))
        finally:
            for df in batch.held:
                df.unpersist()
            state.unstage(batch.spark, table)

    return started(rows.writeStream.foreachBatch(each), checkpoint, every)


# --- counts ----------------------------------------------------------------------------------


def keep_counts(
    events: DataFrame,
    table: str,
    checkpoint: str,
    every: str | None = None,
    buckets: int = BUCKETS,
    changelog: bool = False,
    run_bits: int = RUN_BITS,
) -> StreamingQuery:
    """Keep ``key, n`` of the count keys; with ``changelog`` the count after each event."""
    rows = countable(events).select(count_key().alias("key"), "seq", "kind", F.col("key").alias("of"))

    def fold(batch: _Batch) -> dict:
        keys = batch.count_by_key()
        start = batch.read("state", BY_KEY).join(keys.select("key"), "key", "left_semi")
        if changelog:
            in_runs = batch.rows.withColumn("run", run_of("seq", run_bits))
            order = [F.col("seq"), F.col("kind"), F.col("of")]
            begin = start.select("key", F.col("n").alias("count"))
            numbered = number_in_runs(in_runs, BY_KEY, ["run"], order, "n", begin)
            batch.append("changelog", numbered.select(F.col("key").alias("count_key"), "seq", "n"))
        total = keys.unionByName(start.select("key", "n")).groupBy("key").agg(F.sum("n").alias("n"))
        batch.write("state", total.withColumn("batch", _at(batch)), BY_KEY)
        return {}

    spark = events.sparkSession
    parts = {"state": _like(spark, "key string, n long, batch long")}
    if changelog:
        parts["changelog"] = _like(spark, "count_key string, seq long, n long")
    return _run(rows, parts, fold, table, checkpoint, every, buckets)


def kept_counts(spark: SparkSession, table: str) -> DataFrame:
    """``count_key, n`` as of the last micro-batch."""
    rows = state.read(spark, table, state.latest(spark, table), "state", keys=BY_KEY)
    return rows.select(F.col("key").alias("count_key"), "n")


def _events_of(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], EVENT)


def _at(batch: _Batch):
    return F.lit(batch.number).cast("long")


def _like(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


# --- chasers ---------------------------------------------------------------------------------

CHASER_STATE = "key string, n long, sent long, ttl long, slots long, names long, last_seq long, batch long"


def keep_chasers(
    events: DataFrame,
    table: str,
    checkpoint: str,
    every: str | None = None,
    buckets: int = BUCKETS,
    changelog: bool = False,
    publish: bool = False,
    count_seed: int = 1,
    page_size: int = PAGE_SIZE,
    run_bits: int = RUN_BITS,
) -> StreamingQuery:
    """Keep the chaser records: totals by key, and each name with its slot."""
    rows = chaser.chasers(events)
    by_name = ["key", "name"]

    def fold(batch: _Batch) -> dict:
        last = F.max(F.struct("seq", "ttl")).alias("last")
        looked = batch.look(F.count(F.lit(1)).alias("n"), last)
        seen = batch.keep(chaser.names_seen(batch.rows))
        keys = seen.select("key").distinct()
        start = batch.keep(batch.read("state", BY_KEY).join(keys, "key", "left_semi"))
        before = batch.read("names", by_name)
        held = batch.keep(before.join(seen.select(*by_name), by_name, "left_semi"))
        if changelog:
            begin = start.select("key", "n", F.col("names").alias("new"), "sent", "ttl")
            log = chaser.changelog_from(batch.rows, held, begin, count_seed, run_bits)
            batch.append("changelog", log)
        in_runs = seen.select(*by_name, "last_seq", run_of("last_seq", run_bits).alias("run"))
        begin = start.select("key", F.col("slots").alias("count"))
        placed = number_in_runs(in_runs, BY_KEY, ["run"], [F.col("last_seq")], "slot", begin)
        placed = batch.keep(placed.select(*by_name, "slot", _at(batch).alias("batch")))
        one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
        now = (
            start.select("key", "n", "sent", "ttl", "slots", "names", "last_seq")
            .unionByName(seen.select("key", "n", "sent", "ttl", one.alias("slots"), one.alias("names"), "last_seq"))
            .unionByName(held.select("key", (-one).alias("names")), allowMissingColumns=True)
            .groupBy("key")
            .agg(*(F.sum(c).alias(c) for c in ("n", "slots", "names")), *(F.max(c).alias(c) for c in ("sent", "ttl", "last_seq")))
        )
        now = batch.keep(now.withColumn("batch", _at(batch)))
        if publish:
            page = page_of("slot", page_size).alias("page")
            changed = held.select("key", page).unionByName(placed.select("key", page)).distinct()
            touched = before.join(keys, "key", "left_semi").join(seen.select(*by_name), by_name, "left_anti")
            names = touched.select(*by_name, "slot").unionByName(placed.select(*by_name, "slot"))
            batch.append("pages", _chaser_pages(changed, names, now, page_size, count_seed))
        batch.write("names", placed, by_name)
        batch.write("state", now, BY_KEY)
        return _chaser_meters(batch.known.meters, looked)

    spark = events.sparkSession
    parts = {
        "state": _like(spark, CHASER_STATE),
        "names": _like(spark, "key string, name string, slot long, batch long"),
    }
    still = _still(rows)
    if changelog:
        parts["changelog"] = chaser.chaser_changelog(_events_of(spark), None)
    if publish:
        names = still.select("key", "name", F.lit(1).cast("long").alias("slot"))
        changed = names.select("key", page_of("slot", page_size).alias("page"))
        parts["pages"] = _chaser_pages(changed, names, parts["state"], page_size, count_seed)
    return _run(rows, parts, fold, table, checkpoint, every, buckets)


def _chaser_meters(meters: dict, looked: list) -> dict:
    latest = max([(meters.get("last_seq"), meters.get("ttl")), *((r.last.seq, r.last.ttl) for r in looked)],
                 key=lambda x: (x[0] is not None, x[0] or 0))
    return {"received": meters.get("received", 0) + sum(r.n for r in looked), "last_seq": latest[0], "ttl": latest[1]}


def _chaser_pages(changed: DataFrame, names: DataFrame, totals: DataFrame, page_size: int, count_seed: int) -> DataFrame:
    """The pages that changed, also those left empty: latest names first, with the state of the key."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct("slot", "name")), False), lambda x: x["name"])
    full = names.withColumn("page", page_of("slot", page_size)).join(changed, ["key", "page"], "left_semi")
    pages = changed.join(full.groupBy("key", "page").agg(listed.alias("names")), ["key", "page"], "left")
    state_of = totals.select(
        "key",
        (F.col("n") + count_seed).alias("count"),
        F.greatest("sent", F.lit(0).cast("long")).alias("latest"),
        F.greatest("ttl", F.lit(0).cast("long")).alias("longest"),
        "last_seq",
        "batch",
    )
    pages = pages.withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    return pages.join(state_of, "key")


def kept_chasers(
    spark: SparkSession, table: str, count_seed: int = 1, page_size: int = PAGE_SIZE, run_bits: int = RUN_BITS
) -> DataFrame:
    """The chaser records as of the last micro-batch."""
    known = state.latest(spark, table)
    names = state.read(spark, table, known, "names", keys=["key", "name"])
    totals = state.read(spark, table, known, "state", keys=BY_KEY)
    return chaser.records_of_slots(names, totals, count_seed, page_size, run_bits)


def kept_chaser_of(
    spark: SparkSession, table: str, key: str, count_seed: int = 1, page_size: int = PAGE_SIZE, run_bits: int = RUN_BITS
) -> DataFrame:
    """The record of one key, from one bucket."""
    not_blank(key)
    known = state.latest(spark, table)
    names = state.read_key(spark, table, known, "names", key, ["key", "name"])
    totals = state.read_key(spark, table, known, "state", key, BY_KEY)
    return chaser.records_of_slots(names, totals, count_seed, page_size, run_bits)


def assembled_chasers(pages: DataFrame) -> DataFrame:
    """``key, page, names, count, latest, longest`` from published pages, page 0 most recent.

    Of a page its last version counts, of a key the state published last. Pages keep the slots'
    stretches, so some may be short; empty ones are left out.
    """
    newest = state.newest(pages, ["key", "page"])
    whole = Window.partitionBy("key")
    last = F.max_by(F.struct("count", "latest", "longest"), "batch").over(whole)
    order = whole.orderBy(F.col("page").desc())
    kept = newest.withColumn("last", last).where(F.size("names") > 0)
    return kept.select("key", (F.row_number().over(order) - 1).alias("page"), "names", "last.*")


# --- billing ---------------------------------------------------------------------------------


def keep_billing(
    events: DataFrame,
    table: str,
    checkpoint: str,
    every: str | None = None,
    buckets: int = BUCKETS,
    changelog: bool = False,
    publish: bool = False,
    page_size: int = PAGE_SIZE,
    run_bits: int = RUN_BITS,
    hot_rows: int | None = None,
) -> StreamingQuery:
    """Keep the billing records: a row of state by key, and each payment's first request.

    Keys of at most ``hot_rows`` events in a micro-batch (by default the rows of a run) are folded
    in one shuffle on the key, hot ones in runs.
    """
    rows = billing.billing_events(events)
    hot_rows = 2**run_bits if hot_rows is None else hot_rows

    def fold(batch: _Batch) -> dict:
        looked, hot = batch.look_by_key(hot_rows)
        cold, busy = split(batch.rows, hot)
        was, known = billing.unpacked(batch.read("state", BY_KEY)), batch.read("requests")
        done = batch.stage(billing.continued(cold, known.select("key", "paymentId"), was, run_bits, changelog))
        fresh, now = _of_ordinary(done, batch)
        log = done.drop("state")
        if busy is not None:
            busy_log, busy_fresh, busy_now = _of_hot(batch, batch.stage(busy), was, known, run_bits, changelog)
            fresh, now = fresh.unionByName(busy_fresh), now.unionByName(batch.stage(busy_now))
            log = log.unionByName(busy_log) if changelog else log
        if changelog:
            batch.append("changelog", log)
        first = Observation()
        told = now.drop("listed").observe(first, F.count_if(F.col("billed_at") == batch.number).alias("bills"))
        if publish:
            # what was listed before matters where the first page that changed had begun by then
            begun = F.coalesce("listed", F.lit(0).cast("long"))
            from_page = page_of(F.least(begun + 1, F.greatest("payments", F.lit(1))), page_size)
            touched = now.withColumn("from_page", from_page)
            shared = touched.where((begun > 0) & ((begun % page_size != 0) | (begun == F.col("payments"))))
            listed = known.drop("batch").join(shared.select("key", "from_page"), "key")
            listed = listed.where(page_of("position", page_size) == F.col("from_page")).drop("from_page")
            listed = listed.unionByName(fresh.drop("batch"))
            pages = _billing_pages(touched, listed, page_size, F.col("from_page"), "last_seq", "batch")
            batch.append("pages", pages)
        batch.write("requests", fresh, ["key", "paymentId"], once=True)
        batch.write("state", billing.packed(told), BY_KEY)
        meters = batch.known.meters
        return {
            "aggregated": meters.get("aggregated", 0) + sum(r.n for r in looked),
            "bills": meters.get("bills", 0) + first.get["bills"],
        }

    still = _still(rows)
    requests = billing.first_requests(still).withColumns({"position": F.lit(0).cast("long"), "batch": F.lit(0).cast("long")})
    like = billing.merge_runs(billing.billing_runs(still, run_bits)).withColumns(
        {name: F.lit(0).cast("long") for name in ("payments", "last_seq", "billed_at", "batch")}
    )
    parts = {"state": like, "requests": requests}
    if changelog:
        parts["changelog"] = billing.billing_changelog(_events_of(events.sparkSession), None)
    if publish:
        parts["pages"] = _billing_pages(like, requests, page_size, None, "last_seq", "batch")
    return _run(rows, parts, fold, table, checkpoint, every, buckets, hold=False)


def _of_ordinary(done: DataFrame, batch: _Batch) -> tuple[DataFrame, DataFrame]:
    """The requests that ``billing.continued`` has listed, and the state of its keys."""
    fresh = done.where("addedRequest IS NOT NULL").select(
        "key",
        F.col("addedRequest.paymentId").alias("paymentId"),
        "seq",
        F.col("addedRequest").alias("payment_request"),
        F.col("paymentCount").alias("position"),
        _at(batch).alias("batch"),
    )
    billed_at = F.coalesce("state.billed_at", F.when(F.col("state.billed"), _at(batch)))
    names = ("run", "first_seq", "has_request", "bill", "bill_low", "bill_high", "repeated", "leads_with_failure", "payments", "last_seq", "listed")
    now = done.where("state IS NOT NULL").select(
        "key",
        *[F.col(f"state.{n}").alias(n) for n in names],
        F.col("lastPaymentFailed").alias("open_failure"),
        billed_at.alias("billed_at"),
        _at(batch).alias("batch"),
    )
    return fresh, now


def _of_hot(
    batch: _Batch, rows: DataFrame, was: DataFrame, known: DataFrame, run_bits: int, changelog: bool
) -> tuple[DataFrame | None, DataFrame, DataFrame]:
    """The changelog of hot keys, the requests they list, and their state; folded in runs."""
    by_payment = ["key", "paymentId"]
    keys = rows.select("key").distinct()
    start = batch.keep(was.join(keys, "key", "left_semi"))
    fresh = billing.first_requests(rows).join(known, by_payment, "left_anti")
    begin = start.select("key", F.col("payments").alias("count"))
    in_runs = fresh.withColumn("run", run_of("seq", run_bits))
    fresh = number_in_runs(in_runs, BY_KEY, ["run"], [F.col("seq")], "position", begin)
    fresh = batch.keep(fresh.withColumn("batch", _at(batch)).drop("run"))
    runs = batch.keep(billing.billing_runs(rows, run_bits))
    log = billing.changelog_from(rows, runs, fresh, start, run_bits) if changelog else None
    now = _billing_state(rows, runs, fresh, start, batch.number)
    return log, fresh, now.join(begin.withColumnRenamed("count", "listed"), "key", "left")


def _billing_state(rows: DataFrame, runs: DataFrame, fresh: DataFrame, start: DataFrame, number: int) -> DataFrame:
    """The state of the keys of a micro-batch after it: what was, then its runs, as one run."""
    runs = runs.withColumn("batch", F.lit(1))
    earlier = start.withColumn("batch", F.lit(0)).select(*runs.columns)
    merged = billing.merge_runs(runs.unionByName(earlier))
    at = F.lit(number).cast("long")
    counted = (
        start.select("key", "payments", "last_seq", "billed_at")
        .unionByName(fresh.select("key", F.lit(1).cast("long").alias("payments")), allowMissingColumns=True)
        .unionByName(
            rows.select("key", F.col("seq").alias("last_seq"), F.when(F.expr(billing.IS_BILL), at).alias("billed_at")),
            allowMissingColumns=True,
        )
        .groupBy("key")
        .agg(
            F.coalesce(F.sum("payments"), F.lit(0).cast("long")).alias("payments"),
            F.max("last_seq").alias("last_seq"),
            F.min("billed_at").alias("billed_at"),
        )
    )
    return merged.join(counted, "key").withColumn("batch", at)


def _billing_pages(totals: DataFrame, requests: DataFrame, page_size: int, first, *more: str) -> DataFrame:
    """The pages from ``first`` on, each a whole record."""
    listed = F.transform(
        F.sort_array(F.collect_list(F.struct("position", "payment_request"))), lambda x: x["payment_request"]
    )
    pages = requests.groupBy("key", page_of("position", page_size).alias("page")).agg(listed.alias("paymentRequests"))
    last_page = page_of(F.greatest("payments", F.lit(1)), page_size)
    states = totals.withColumns({"last_page": last_page, "errored": billing.errored()}).drop("bill_low", "bill_high")
    of_page = of_each_page(states, first)
    records = of_page.join(pages, ["key", "page"], "left")
    return records.select(
        "key",
        "page",
        "bill",
        F.coalesce("paymentRequests", F.array()).alias("paymentRequests"),
        F.col("payments").alias("paymentCount"),
        F.col("open_failure").alias("lastPaymentFailed"),
        "errored",
        *more,
    )


def kept_billing(spark: SparkSession, table: str, page_size: int = PAGE_SIZE) -> DataFrame:
    """The billing records as of the last micro-batch."""
    known = state.latest(spark, table)
    requests = state.newest_of_none(state.read(spark, table, known, "requests"), ["key", "paymentId"])
    totals = billing.unpacked(state.read(spark, table, known, "state", keys=BY_KEY))
    return _billing_pages(totals, requests, page_size, None)


def kept_billing_of(spark: SparkSession, table: str, key: str, page_size: int = PAGE_SIZE) -> DataFrame:
    """The record of one key, from one bucket."""
    not_blank(key)
    known = state.latest(spark, table)
    requests = state.read_key(spark, table, known, "requests", key, ["key", "paymentId"])
    totals = billing.unpacked(state.read_key(spark, table, known, "state", key, BY_KEY))
    return _billing_pages(totals, requests, page_size, None)


def assembled_billing(pages: DataFrame) -> DataFrame:
    """The billing records from published pages: of a page its last version, of a key its last state."""
    # both windows in one shuffle and sort of the pages; the second gathers those of a key anyway
    newest = state.newest(pages.repartition("key"), ["key", "page"])
    fields = ("bill", "paymentCount", "lastPaymentFailed", "errored")
    last = F.max_by(F.struct(*fields), F.struct("batch", "page")).over(Window.partitionBy("key"))
    return newest.withColumn("last", last).select("key", "page", "paymentRequests", "last.*")


# --- all -------------------------------------------------------------------------------------


def kept_keys(spark: SparkSession, table: str) -> DataFrame:
    """The keys that have a record as of the last micro-batch, from the state's key column alone."""
    return state.read(spark, table, state.latest(spark, table), "state").select("key").distinct()


def kept_log(spark: SparkSession, table: str, part: str = "changelog", after: int = -1) -> DataFrame:
    """Rows of the changelog, or of the published pages, of batches later than ``after``."""
    return state.read_log(spark, table, state.latest(spark, table), part, after)


def kept_meters(spark: SparkSession, chasers: str | None = None, bills: str | None = None) -> DataFrame:
    """The meters of the tables of ``keep_chasers`` and ``keep_billing``, as ``processing_meters`` gives them."""
    one = state.latest(spark, chasers).meters if chasers else {}
    two = state.latest(spark, bills).meters if bills else {}
    row = (one.get("received", 0), one.get("ttl") or 0, two.get("aggregated", 0), two.get("bills", 0))
    names = ("chaser_received", "chaser_ttl_value", "billing_aggregation", "billing_customer_bills")
    return spark.createDataFrame([row], ", ".join(f"{n} long" for n in names))
