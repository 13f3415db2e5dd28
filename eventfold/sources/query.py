"""Rows of a SQL text."""

from pyspark.sql import DataFrame, SparkSession


def sql_rows(spark: SparkSession, text: str, views: dict[str, DataFrame] | None = None) -> DataFrame:
    """The result of a query over the catalog and the given frames, named in braces."""
    return spark.sql(text, **(views or {}))


def jdbc_rows(
    spark: SparkSession,
    url: str,
    text: str,
    split: tuple[str, int, int, int] | None = None,
    **options,
) -> DataFrame:
    """The result of a query run by a database, whose driver the cluster must provide.

    ``split`` is a numeric column, its least and largest value, and a number of tasks to read
    ranges of it with; without it one task reads all. Not tested: no driver is installed here.
    """
    reader = spark.read.format("jdbc").options(url=url, dbtable=f"({text}) q", **options)
    if split:
        column, low, high, tasks = split
        reader = reader.options(
            partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=tasks
        )
    return reader.load()
