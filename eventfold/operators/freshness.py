"""Source freshness from heartbeats, its roll-up, and backlog readiness."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventfold.functions.ordered import upto


def source_freshness(
    registry: DataFrame, beats: DataFrame, margin: int, as_of: Column
) -> DataFrame:
    """``source, latest, valid`` for ``registry(source, registered_at, fresh)``.

    A source is valid while latest + margin >= as_of. One without a beat yet counts from
    its registration, or from one margin earlier when registered with ``fresh = false``.
    """
    latest = beats.groupBy("source").agg(F.max("at").alias("beat"))
    start = F.col("registered_at") - F.when(F.col("fresh"), 0).otherwise(margin)
    return (
        registry.join(latest, "source", "left")
        .withColumn("latest", F.coalesce("beat", start))
        .select("source", "latest", (F.col("latest") + margin >= as_of).alias("valid"))
    )


def freshness_rollup(checks: DataFrame) -> DataFrame:
    """``valid, n_checks``: all sources valid; no source at all is valid."""
    return checks.agg(
        F.coalesce(F.bool_and("valid"), F.lit(True)).alias("valid"),
        F.count(F.lit(1)).alias("n_checks"),
    )


def backlog_readiness(arrivals: DataFrame, first: Column, last: Column, busy_above: int = 5) -> DataFrame:
    """``instance, tick, backlog, ready`` for ``arrivals(instance, tick)``, one row per arrival.

    At each tick a backlog above ``busy_above`` sets busy, an empty one sets ready, and
    anything between keeps the state (busy at first); then one item is worked off. The
    backlog is a reflected running sum, so no loop is needed. Arrivals are counted per
    tick before the shuffle: a window holds one row per tick, however many arrive.
    """
    per_tick = arrivals.groupBy("instance", "tick").agg(F.count(F.lit(1)).alias("n"))
    grid = per_tick.select("instance").distinct().select(
        "instance", F.explode(F.sequence(first, last)).alias("tick")
    )
    in_order = Window.partitionBy("instance").orderBy("tick")
    state = F.when(F.col("backlog") > busy_above, False).when(F.col("backlog") == 0, True)
    return (
        grid.join(per_tick, ["instance", "tick"], "left")
        .withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
        .withColumn("net", F.sum(F.col("n") - 1).over(upto(in_order)))
        .withColumn("floor", F.least(F.lit(0), F.min("net").over(upto(in_order))))
        .withColumn(
            "backlog",
            F.coalesce(F.lag(F.col("net") - F.col("floor")).over(in_order), F.lit(0)) + F.col("n"),
        )
        .select(
            "instance",
            "tick",
            "backlog",
            F.coalesce(F.last(state, ignorenulls=True).over(upto(in_order)), F.lit(False)).alias(
                "ready"
            ),
        )
    )
