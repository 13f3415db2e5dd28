"""Ordered work per key that does not rely on a key fitting in one task.

Most keys are small: one shuffle on the key and a window do the job. A *hot* key has
more than ``HOT_ROWS`` rows; its rows are cut into *runs* of consecutive ``seq``
values. As ``seq`` is unique within a key, a run never has more than ``2**RUN_BITS``
rows, whatever the skew. What a run needs to know of the runs before it is carried
in from a per-run summary, which is tiny next to the rows.

Hot keys are measured before the plan is made, by a key-only count (partial
aggregation, no payload). Every entry of their list stands for more than ``HOT_ROWS``
rows, so it holds at most rows / HOT_ROWS keys; its size is checked before it is
broadcast. If there are none, the plan has no hot branch at all.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000
RUN_BITS = 17
PAGE_SIZE = 10_000
BROADCAST_KEYS = 1_000_000


# Default of the ``hot`` arguments: measure the hot keys of the events given.
MEASURE = "measure"


def hot_keys(rows: DataFrame, key: str = "key", hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """Keys with more than ``hot_rows`` rows, or None if there are none. Runs the count.

    The list is marked for broadcast if it has at most ``BROADCAST_KEYS`` keys. A longer one
    is left to Spark, which can split the hot side of a semi or anti join.
    """
    hot = rows.groupBy(key).count().where(F.col("count") > hot_rows).select(key)
    found = hot.count()
    if found == 0:
        return None
    return F.broadcast(hot) if found <= BROADCAST_KEYS else hot


def split(
    rows: DataFrame, hot: DataFrame | str | None, key: str = "key", hot_rows: int = HOT_ROWS
) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ordinary keys, rows of hot keys if there are any)."""
    if isinstance(hot, str):
        hot = hot_keys(rows, key, hot_rows)
    if hot is None:
        return rows, None
    return rows.join(hot, key, "left_anti"), rows.join(hot, key, "left_semi")


def joined(cold: DataFrame, busy: DataFrame | None) -> DataFrame:
    """Put the results of both parts together."""
    return cold if busy is None else cold.unionByName(busy)


def run_of(seq: Column | str, run_bits: int = RUN_BITS) -> Column:
    """Number of the run a ``seq`` falls in; rises with ``seq``."""
    return F.shiftright(seq, run_bits)


def page_of(position: Column | str, page_size: int = PAGE_SIZE) -> Column:
    """Page of a 1-based list position."""
    position = F.col(position) if isinstance(position, str) else position
    return F.floor((position - 1) / page_size).cast("int")


def of_each_page(states: DataFrame, first: Column | None = None) -> DataFrame:
    """A copy of each key's state for every page from ``first``, or 0, up to ``last_page``.

    Pages and states then meet by (key, page): the pages of a hot key stay spread out.
    """
    first = F.lit(0) if first is None else first
    return states.withColumn("page", F.explode(F.sequence(first, "last_page"))).drop("last_page")


def upto(window):
    """The rows of a window from its start to the current row."""
    return window.rowsBetween(Window.unboundedPreceding, 0)


def before(window):
    """The rows of a window from its start to just before the current row."""
    return window.rowsBetween(Window.unboundedPreceding, -1)


def whole(window):
    """All rows of a window, keeping its order so one sort serves both."""
    return window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def number_in_runs(
    rows: DataFrame,
    group: list[str],
    run: list[str],
    order: list[Column],
    name: str,
    start: DataFrame | None = None,
) -> DataFrame:
    """Number the rows of each group 1, 2, … without gathering a group in one task.

    Each (group, run) receives one extra row with the number of rows before it, so the
    running sum inside the run gives the position in the group; the rows themselves are
    shuffled once. ``start`` has a ``count`` for groups that go on from an earlier one.
    """
    earlier = before(Window.partitionBy(*group).orderBy(*run))
    counts = rows.groupBy(*group, *run).count()
    if start is not None:  # without a run, so it comes first
        counts = counts.unionByName(start.select(*group, "count"), allowMissingColumns=True)
    carried = (
        counts.select(*group, *run, F.sum("count").over(earlier).alias("_carry"))
        .where("_carry IS NOT NULL")
    )
    inside = Window.partitionBy(*group, *run).orderBy(F.col("_carry").isNull(), *order)
    return (
        rows.unionByName(carried, allowMissingColumns=True)
        .withColumn(name, F.sum(F.coalesce("_carry", F.lit(1))).over(upto(inside)))
        .where("_carry IS NULL")
        .drop("_carry")
    )


def number(
    rows: DataFrame,
    key: str,
    run: list[str],
    order: list[Column],
    name: str,
    hot: DataFrame | str | None = MEASURE,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Number the rows of each key: a plain window for ordinary keys, runs for hot ones."""
    cold, busy = split(rows, hot, key, hot_rows)
    in_order = Window.partitionBy(key).orderBy(*order)
    return joined(
        cold.withColumn(name, F.row_number().over(in_order).cast("long")),
        busy and number_in_runs(busy, [key], run, order, name),
    )
