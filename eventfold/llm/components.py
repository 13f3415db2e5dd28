"""Connected components of a table of links."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventfold.llm.common import kept_table


def components(links: DataFrame) -> DataFrame:
    """``node, label`` of every node of ``links`` (a, b); the label is its component's least node.

    Rounds of contraction: every node goes over to the one that comes first, by hashes that are
    new in each round, of itself and the nodes linked to it; links then join the nodes gone over
    to, and those within one node drop out. Whatever the graph and its numbers, a third of the
    nodes or more are expected to go in a round, so the rounds, until no link is left, grow with
    the logarithm of the nodes. Each round's tables are written, so lineage stays short and lost
    executors cost a round. Going back through the rounds, each node learns where it ended; the
    least of those that ended together is the label.
    """
    spark = links.sparkSession
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = kept_table(spark, both.where("a <> b").distinct(), "edges")
    rounds = []
    while not rounds or both.head(1):
        here, there = (F.xxhash64(F.lit(len(rounds)), F.col(c)) for c in ("a", "b"))
        first = both.groupBy("a").agg(F.min(there).alias("least"), F.min_by("b", there).alias("b"))
        to = F.when(here < F.col("least"), F.col("a")).otherwise(F.col("b"))
        # written before it is used twice: of equal hashes either node may come first
        rounds.append(kept_table(spark, first.select(F.col("a").alias("node"), to.alias("to")), "labels"))
        ends = [rounds[-1].select(F.col("node").alias(c), F.col("to").alias(f"{c}_to")) for c in ("a", "b")]
        both = both.join(ends[0], "a").join(ends[1], "b")
        both = both.select(F.col("a_to").alias("a"), F.col("b_to").alias("b"))
        both = kept_table(spark, both.where("a <> b").distinct(), "edges")
    ended = rounds.pop()
    while rounds:
        later = ended.select(F.col("node").alias("to"), F.col("to").alias("last"))
        ended = rounds.pop().join(later, "to", "left")
        ended = kept_table(spark, ended.select("node", F.coalesce("last", "to").alias("to")), "labels")
    least = ended.groupBy("to").agg(F.min("node").alias("label"))
    return kept_table(spark, ended.join(least, "to").select("node", "label"), "labels")
