"""Dialogues rendered from every participant's point of view.

For each speaker of a conversation the dialogue is rendered once with that speaker as the
assistant, everyone else as a user with a name, and the roles of ``CONTEXT`` as they are. The
mask lists the spans to train on: the assistant's words and the marker that ends its turn.

All of it is DataFrame functions: turns meet their conversation's speakers in a join, which
adaptive execution splits where one conversation is large; offsets are running sums; a row of
the result holds the turns numbered within one stretch of ``PART_TURNS``, so that no row grows
with a conversation of any length (``part`` counts the stretches, and spans are relative to one).

Defined results: rows equal in conversation, turn, role and text are one turn (``n_rows`` counts
them); different texts of one turn follow each other by role, then text; a null turn comes
first, in part 0; a null role is a speaker named ``unknown``; a null text is empty; a null id is a
conversation; a conversation without a speaker has no rows; markers inside a text lose their
meaning by a space after their first character; further columns are ignored.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONTEXT = ("system",)
PART_TURNS = 256
BEGIN, END = "<|im_start|>", "<|im_end|>"


def _plain(text: Column) -> Column:
    return F.replace(text, F.lit("<|im_"), F.lit("< |im_"))


def _name(role: Column) -> Column:
    return F.regexp_replace(_plain(role), r"[\s<>]+", "_")


def _header() -> Column:
    """What stands before a turn's text."""
    role, speaker = F.col("role"), F.col("speaker")
    who = F.when(role == speaker, F.lit("assistant")).when(role.isin(*CONTEXT), role)
    return F.concat(
        F.lit(BEGIN), F.coalesce(who, F.concat(F.lit("user name="), _name(role))), F.lit("\n")
    )


def perspectives(conversations: DataFrame) -> DataFrame:
    """A row for each turn and speaker of its conversation: ``header``, ``text``, ``trained``."""
    turns = (
        conversations.select(
            "conv_id",
            F.col("turn").cast("long").alias("turn"),
            F.coalesce("role", F.lit("unknown")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        )
        .groupBy("conv_id", "turn", "role", "text")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )
    speakers = (
        conversations.select(
            F.col("conv_id").alias("of"), F.coalesce("role", F.lit("unknown")).alias("speaker")
        )
        .where(~F.col("speaker").isin(*CONTEXT))
        .distinct()
    )
    return turns.join(speakers, F.col("conv_id").eqNullSafe(F.col("of"))).select(
        "conv_id",
        "speaker",
        F.floor(F.greatest(F.coalesce("turn", F.lit(0)), F.lit(0)) / PART_TURNS)
        .cast("long")
        .alias("part"),
        "turn",
        "role",
        "text",
        "n_rows",
        _header().alias("header"),
        (F.col("role") == F.col("speaker")).alias("trained"),
    )


def dialogues(conversations: DataFrame) -> DataFrame:
    """``conv_id, speaker, part, rendered, mask, n_turns, n_rows, n_trained``.

    ``mask`` is an array of ``start, end`` code points of ``rendered``.
    """
    shown = F.concat("header", _plain(F.col("text")), F.lit(END + "\n"))
    order = Window.partitionBy("conv_id", "speaker", "part").orderBy("turn", "role", "text")
    placed = (
        perspectives(conversations)
        .withColumn("shown", shown)
        .withColumn("at", F.row_number().over(order))
        .withColumn("stop", F.sum(F.length("shown")).over(order))
    )
    start = F.col("stop") - F.length("shown") + F.length("header")
    span = F.struct(start.alias("start"), (F.col("stop") - 1).alias("end"))
    rows = placed.groupBy("conv_id", "speaker", "part").agg(
        F.sort_array(F.collect_list(F.struct("at", "shown"))).alias("shown"),
        F.sort_array(F.collect_list(F.when(F.col("trained"), span))).alias("mask"),
        F.count(F.lit(1)).alias("n_turns"),
        F.sum("n_rows").alias("n_rows"),
    )
    return rows.select(
        "conv_id",
        "speaker",
        "part",
        F.array_join("shown.shown", "").alias("rendered"),
        "mask",
        "n_turns",
        "n_rows",
        F.size("mask").cast("long").alias("n_trained"),
    )


def flat(rendered: DataFrame) -> DataFrame:
    """The mask as text: ``start-end`` of each span, joined by commas."""
    spans = F.transform("mask", lambda s: F.concat_ws("-", s["start"], s["end"]))
    return rendered.withColumn("mask", F.array_join(spans, ","))


ORACLE = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         count(*) AS n_rows
  FROM conversations GROUP BY ALL),
speakers AS (SELECT DISTINCT conv_id, role AS speaker FROM turns WHERE role <> 'system'),
shown AS (
  SELECT t.conv_id, s.speaker, t.turn, t.role, t.text, t.n_rows,
         greatest(coalesce(t.turn, 0), 0) // {PART_TURNS} AS part, t.role = s.speaker AS trained,
         '{BEGIN}' || CASE WHEN t.role = s.speaker THEN 'assistant' WHEN t.role = 'system' THEN t.role
           ELSE 'user name=' || regexp_replace(replace(t.role, '<|im_', '< |im_'), '[\\s<>]+', '_', 'g')
           END || chr(10) AS header,
         header || replace(t.text, '<|im_', '< |im_') || '{END}' || chr(10) AS shown
  FROM turns t JOIN speakers s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
placed AS (
  SELECT *, sum(length(shown)) OVER w AS stop, row_number() OVER w AS pos FROM shown
  WINDOW w AS (PARTITION BY conv_id, speaker, part ORDER BY turn NULLS FIRST, role, text
               ROWS UNBOUNDED PRECEDING))
SELECT conv_id, speaker, part::BIGINT AS part, string_agg(shown, '' ORDER BY pos) AS rendered,
       coalesce(string_agg((stop - length(shown) + length(header))::BIGINT || '-' || (stop - 1)::BIGINT,
                ',' ORDER BY pos) FILTER (WHERE trained), '') AS mask,
       count(*) AS n_turns, sum(n_rows)::BIGINT AS n_rows, count(*) FILTER (WHERE trained) AS n_trained
FROM placed GROUP BY conv_id, speaker, part
"""
