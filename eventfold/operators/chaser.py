"""Chaser summary per key: names by recency, count, latest, longest."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventfold.functions.ordered import (
    HOT_ROWS,
    MEASURE,
    PAGE_SIZE,
    RUN_BITS,
    before,
    hot_keys,
    joined,
    number_in_runs,
    of_each_page,
    page_of,
    run_of,
    split,
    upto,
    whole,
)
from eventfold.operators.lookup import of_key


def chasers(events: DataFrame) -> DataFrame:
    """``key, seq, name, sent, ttl`` of chasers; records without a key take no part."""
    return events.where("kind = 'Chaser' AND key IS NOT NULL").select(
        "key", "seq", "chaser.name", "chaser.sent", "chaser.ttl"
    )


def names_seen(rows: DataFrame) -> DataFrame:
    """One row per (key, name). Every column merges with sum or max, in any order."""
    return rows.groupBy("key", "name").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("seq").alias("last_seq"),
        F.max("sent").alias("sent"),
        F.max("ttl").alias("ttl"),
    )


def _floored(column):
    return F.greatest(column, F.lit(0).cast("long"))


def _list_page():
    listed = F.sort_array(F.collect_list(F.struct("position", "name")))
    return F.transform(listed, lambda item: item["name"]).alias("names")


def chaser_records(
    seen: DataFrame,
    hot: DataFrame | str | None = MEASURE,
    count_seed: int = 1,
    page_size: int = PAGE_SIZE,
    hot_rows: int = HOT_ROWS,
    run_bits: int = RUN_BITS,
) -> DataFrame:
    """``key, page, names, count, latest, longest`` from ``names_seen`` rows.

    Every page is a whole record, with all of ``count, latest, longest``; a list of more than
    ``page_size`` names is spread over pages 0, 1, 2, …, as a sink takes records of a bounded size.
    """
    cold, busy = split(seen, hot, hot_rows=hot_rows)
    pages = joined(_ordinary_pages(cold, page_size), busy and _hot_pages(busy, page_size, run_bits))
    return _records(pages, count_seed)


def _records(pages, count_seed):
    return pages.select(
        "key",
        "page",
        "names",
        (F.col("n") + count_seed).alias("count"),
        _floored("sent").alias("latest"),
        _floored("ttl").alias("longest"),
    )


def _totals() -> dict:
    return {"n": F.sum("n"), "sent": F.max("sent"), "ttl": F.max("ttl")}


def _ordinary_pages(seen, page_size):
    by_recency = Window.partitionBy("key").orderBy(F.col("last_seq").desc())
    return (
        seen.withColumns(
            {
                "position": F.row_number().over(by_recency).cast("long"),
                **{name: total.over(whole(by_recency)) for name, total in _totals().items()},
            }
        )
        .groupBy("key", page_of("position", page_size).alias("page"))
        .agg(_list_page(), *[F.first(name).alias(name) for name in _totals()])
    )


def _hot_pages(seen, page_size, run_bits):
    names = seen.select(
        "key", "name", "last_seq", run_of(-F.col("last_seq"), run_bits).alias("run")
    )
    listed = page_of(F.count(F.lit(1)), page_size).alias("last_page")
    totals = seen.groupBy("key").agg(
        listed, *[total.alias(name) for name, total in _totals().items()]
    )
    return _listed(names, totals, page_size)


def _listed(names, totals, page_size):
    """Pages of names in runs, latest first, with the totals of their keys."""
    pages = (
        number_in_runs(names, ["key"], ["run"], [F.col("last_seq").desc()], "position")
        .groupBy("key", page_of("position", page_size).alias("page"))
        .agg(_list_page())
    )
    return pages.join(of_each_page(totals), ["key", "page"])


def records_of_slots(
    names: DataFrame,
    totals: DataFrame,
    count_seed: int = 1,
    page_size: int = PAGE_SIZE,
    run_bits: int = RUN_BITS,
) -> DataFrame:
    """The records from ``key, name, slot`` and ``key, names, n, sent, ttl``; a later slot is more recent."""
    placed = names.select(
        "key", "name", F.col("slot").alias("last_seq"), run_of(-F.col("slot"), run_bits).alias("run")
    )
    totals = totals.select("key", page_of("names", page_size).alias("last_page"), "n", "sent", "ttl")
    return _records(_listed(placed, totals, page_size), count_seed)


def chaser_aggregate(
    events: DataFrame,
    hot: DataFrame | str | None = MEASURE,
    count_seed: int = 1,
    page_size: int = PAGE_SIZE,
    hot_rows: int = HOT_ROWS,
    run_bits: int = RUN_BITS,
) -> DataFrame:
    """The summary per key after all events; see ``chaser_records`` for the columns.

    ``count`` starts at ``count_seed`` before the first event. ``latest`` and ``longest``
    never fall below zero.
    """
    rows = chasers(events)
    if isinstance(hot, str):
        # events bound the names of a key, and counting them reads the key column only
        hot = hot_keys(rows, "key", hot_rows)
    return chaser_records(names_seen(rows), hot, count_seed, page_size, hot_rows, run_bits)


def chaser_of(
    events: DataFrame,
    key: str,
    count_seed: int = 1,
    page_size: int = PAGE_SIZE,
    run_bits: int = RUN_BITS,
) -> DataFrame:
    """The summary of one key, folded in runs as if it were hot: nothing is measured first."""
    pages = _hot_pages(names_seen(chasers(of_key(events, key))), page_size, run_bits)
    return _records(pages, count_seed)


def chaser_changelog(
    events: DataFrame,
    hot: DataFrame | str | None = MEASURE,
    count_seed: int = 1,
    hot_rows: int = HOT_ROWS,
    run_bits: int = RUN_BITS,
) -> DataFrame:
    """The summary after every event, as what the event changed.

    ``key, seq, name, name_is_new, names_count, count, latest, longest``. ``name`` moves
    to the front of the list, so the rows up to a ``seq`` give the list at that point
    (``chaser_aggregate`` over them does it) while the changelog stays linear in the
    number of events.
    """
    cold, busy = split(chasers(events), hot, hot_rows=hot_rows)
    first_of_name = Window.partitionBy("key", "name").orderBy("seq")
    cold = (
        cold.repartition("key")
        .withColumn("new", (F.row_number().over(first_of_name) == 1).cast("long"))
        .withColumns({"run": F.lit(0).cast("long"), "n": F.lit(1).cast("long")})
    )
    return joined(
        _running(cold, count_seed),
        busy and _running(_with_carry(_mark_new_names(busy, run_bits)), count_seed),
    )


def changelog_from(
    rows: DataFrame, known: DataFrame, start: DataFrame, count_seed: int = 1, run_bits: int = RUN_BITS
) -> DataFrame:
    """The changelog of ``chasers`` rows of keys that have had others before.

    ``known`` is ``key, name`` of the names seen by then, ``start`` ``key, n, new, sent, ttl``
    of the keys: events, names, latest and longest so far. Every key is folded in runs.
    """
    new = rows.groupBy("key", "name").agg(F.min("seq").alias("seq"))
    new = new.join(known.select("key", "name"), ["key", "name"], "left_anti")
    return _running(_with_carry(_mark_new_names(rows, run_bits, new), start), count_seed)


def _mark_new_names(rows, run_bits, new=None):
    """Flag the first event of each (key, name) by placing a mark right before it."""
    new = rows.groupBy("key", "name").agg(F.min("seq").alias("seq")) if new is None else new
    marks = new.drop("name")
    marked = (
        rows.withColumn("mark", F.lit(0))
        .unionByName(marks.withColumn("mark", F.lit(1)), allowMissingColumns=True)
        .withColumn("run", run_of("seq", run_bits))
    )
    inside = Window.partitionBy("key", "run").orderBy("seq", F.col("mark").desc())
    return (
        marked.withColumn("new", F.coalesce(F.lag("mark").over(inside), F.lit(0)).cast("long"))
        .where("mark = 0")
        .drop("mark")
        .withColumn("n", F.lit(1).cast("long"))
    )


def _with_carry(rows, start=None):
    """Add to each run a row holding the totals of the runs before it; it has no ``seq``.

    Totals begin with those of ``start``, which has no run and so comes first.
    """
    earlier = before(Window.partitionBy("key").orderBy("run"))
    summary = rows.groupBy("key", "run").agg(
        F.sum("n").alias("n"), F.sum("new").alias("new"), F.max("sent").alias("sent"),
        F.max("ttl").alias("ttl"),
    )
    if start is not None:
        summary = summary.unionByName(start, allowMissingColumns=True)
    carried = summary.select(
        "key",
        "run",
        F.sum("n").over(earlier).alias("n"),
        F.sum("new").over(earlier).alias("new"),
        F.max("sent").over(earlier).alias("sent"),
        F.max("ttl").over(earlier).alias("ttl"),
    ).where("n IS NOT NULL")
    return rows.unionByName(carried, allowMissingColumns=True)


def _running(rows, count_seed):
    so_far = upto(Window.partitionBy("key", "run").orderBy(F.col("seq").asc_nulls_first()))
    return (
        rows.select(
            "key",
            "seq",
            "name",
            (F.col("new") > 0).alias("name_is_new"),
            F.sum("new").over(so_far).alias("names_count"),
            (F.sum("n").over(so_far) + count_seed).alias("count"),
            _floored(F.max("sent").over(so_far)).alias("latest"),
            _floored(F.max("ttl").over(so_far)).alias("longest"),
        )
        .where("seq IS NOT NULL")
    )
