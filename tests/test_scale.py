"""Plans and hot keys: what must hold when the data is a thousand times larger."""

import random
import re

import pytest
from events import bill, chaser, failed, frame, request
from pyspark.sql import functions as F

from eventfold.functions.ordered import hot_keys, number_in_runs, run_of
from eventfold.operators import billing, counts
from eventfold.operators import chaser as chasers
from eventfold.session import fit_shuffles, scratch
from eventfold.sources import tables
from eventfold.sources.log import Log, read_events


@pytest.fixture(scope="module")
def log(spark):
    """A parquet log in which one key holds most of the events."""
    rng, events = random.Random(2), []
    for seq in range(3000):
        key = rng.choice(["hot"] * 5 + [f"k{seq % 40}"])
        kind = rng.random()
        if kind < 0.05:
            events.append(bill(key, seq))
        elif kind < 0.4:
            events.append(request(key, seq, f"PAY-{rng.randrange(900)}"))
        elif kind < 0.5:
            events.append(failed(key, seq))
        else:
            events.append(chaser(key, seq, f"n{rng.randrange(300)}"))
    path = scratch(spark, "log")
    frame(spark, events).repartition(4).write.parquet(path)
    return read_events(spark, Log(path=path))


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def exchanges(df):
    return len(re.findall(r"\bExchange ", plan_of(df)))


@pytest.mark.parametrize(
    "fold, shuffles",
    [
        (counts.event_counts, 1),
        (counts.event_count_changelog, 1),
        (chasers.chaser_changelog, 1),
        (billing.billing_aggregate, 1),
        (billing.billing_changelog, 1),
        (chasers.chaser_aggregate, 2),  # by (key, name), then by key
    ],
)
def test_shuffles_of_ordinary_keys(log, fold, shuffles):
    plan = fold(log)
    assert exchanges(plan) == shuffles
    assert "Python" not in plan_of(plan)


def test_scans_read_what_they_need(log):
    plan = plan_of(chasers.chaser_aggregate(log))
    chaser_fields = "chaser:struct<name:string,sent:bigint,ttl:bigint>"
    assert f"ReadSchema: struct<key:string,seq:bigint,kind:string,{chaser_fields}>" in plan
    assert "EqualTo(kind,Chaser)" in plan


def test_lookup_reaches_the_scan(log):
    from eventfold.operators.lookup import of_key

    assert "EqualTo(key,k1)" in plan_of(of_key(billing.billing_aggregate(log, hot=None), "k1"))
    assert "EqualTo(key,k1)" in plan_of(billing.billing_of(log, "k1"))
    assert "EqualTo(key,k1)" in plan_of(chasers.chaser_of(log, "k1"))


@pytest.mark.parametrize("query", ["billing_lookup", "chaser_lookup"])
def test_lookups_start_no_job_before_their_own(spark, tiny, query):
    from eventfold.plans.queries import registry

    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(query, query)
    registry()[query](spark, tiny)
    started = tracker.getJobIdsForGroup(query)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # reading a file's schema is a job of its own
    assert len(started) <= 3


def test_a_key_looked_up_is_the_key_folded(log):
    from eventfold.operators.lookup import of_key

    for key in ("hot", "k1"):
        for one, all_ in ((billing.billing_of, billing.billing_aggregate), (chasers.chaser_of, chasers.chaser_aggregate)):
            got = one(log, key, page_size=50, run_bits=6).collect()
            expected = of_key(all_(log, page_size=50), key).collect()
            assert sorted(got, key=lambda r: r.page) == sorted(expected, key=lambda r: r.page)


def test_runs_of_a_topic_hold_offsets():
    from eventfold.functions.ordered import RUN_BITS
    from eventfold.sources.log import run_bits_of

    assert run_bits_of(Log(partitions=1)) == RUN_BITS
    bits = run_bits_of(Log(partitions=1000))
    assert 2**RUN_BITS <= 2**bits / 1000 < 2 ** (RUN_BITS + 1)


def below(lines, i):
    """The operators below line ``i`` of a plan."""
    depth = re.search(r"\w|\*", lines[i]).start()
    for line in lines[i + 1 :]:
        if re.search(r"\w|\*", line).start() <= depth:
            return
        yield line


@pytest.mark.parametrize("fold", [billing.billing_aggregate, chasers.chaser_aggregate])
def test_lists_of_hot_keys_are_not_shuffled_by_key(log, fold):
    """Pages are gathered by (key, page) and stay there; a copy of the state comes to each."""
    plan = plan_of(fold(log, hot_rows=1000, run_bits=6, page_size=50))
    lines = [line for line in plan.splitlines() if re.search(r"\w", line)]
    by_key = [i for i, line in enumerate(lines) if re.search(r"Exchange hashpartitioning\(key#\d+, \d", line)]
    assert by_key and "LeftSemi" in plan
    for i in by_key:
        under = list(below(lines, i))
        assert not any("collect_list" in line for line in under)


def test_shuffles_fit_the_input(spark, log):
    fit_shuffles(spark, log)
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    assert spark.conf.get(name) == spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.unset(name)


def test_hot_keys(log):
    assert [r.key for r in hot_keys(log, hot_rows=1000).collect()] == ["hot"]
    assert hot_keys(log, hot_rows=10**6) is None


def test_long_lists_of_hot_keys_are_not_broadcast(log, monkeypatch):
    def hints():
        return hot_keys(log, hot_rows=10)._jdf.queryExecution().logical().toString().count("broadcast")

    assert hints() == 1
    monkeypatch.setattr("eventfold.functions.ordered.BROADCAST_KEYS", 5)
    assert hints() == 0


def test_runs_are_bounded(log):
    """The rows of a hot key meet in groups of at most one run."""
    rows = billing.billing_events(log)
    largest = rows.groupBy("key", run_of("seq", 5)).count().agg(F.max("count")).first()[0]
    assert largest <= 2**5
    runs = billing.billing_runs(rows, 5).where("key = 'hot'").count()
    assert runs <= 3000 / 2**5 + 1


def test_pages_are_bounded_and_whole(log):
    whole = billing.billing_aggregate(log).where("key = 'hot'").first()
    pages = billing.billing_aggregate(log, page_size=50, hot_rows=1000, run_bits=6)
    pages = sorted(pages.where("key = 'hot'").collect(), key=lambda r: r.page)
    assert [len(p.paymentRequests) for p in pages[:-1]] == [50] * (len(pages) - 1)
    assert [p.page for p in pages] == list(range(len(pages)))
    assert [r for p in pages for r in p.paymentRequests] == whole.paymentRequests
    assert {p.paymentCount for p in pages} == {whole.paymentCount} == {len(whole.paymentRequests)}


def test_names_of_hot_keys(log):
    whole = chasers.chaser_aggregate(log).where("key = 'hot'").first()
    pages = chasers.chaser_aggregate(log, page_size=50, hot_rows=1000, run_bits=6)
    pages = sorted(pages.where("key = 'hot'").collect(), key=lambda r: r.page)
    assert [n for p in pages for n in p.names] == whole.names
    assert all(tuple(p)[3:] == tuple(whole)[3:] for p in pages)


def test_numbering_in_runs(spark):
    rows = spark.range(500).select(
        F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("key"), F.col("id").alias("seq")
    )
    got = number_in_runs(rows.withColumn("run", run_of("seq", 3)), ["key"], ["run"], [F.col("seq")], "n")
    for key in "ab":
        of_key = got.where(F.col("key") == key).orderBy("seq").collect()
        assert [r.n for r in of_key] == list(range(1, len(of_key) + 1))


def test_table_log_numbers_hot_keys_alike(spark, tiny):
    plain = tables.billing_log(spark, tiny, hot=None)
    hot = tables.hot_bills(spark, tiny, hot_rows=6)
    assert hot.count() > 100
    runs = tables.billing_log(spark, tiny, hot=hot)
    assert plain.exceptAll(runs).count() == 0 and runs.exceptAll(plain).count() == 0
