"""Counts of rows, values and partitions."""

from pyspark.sql import DataFrame, functions as F


def row_count(df: DataFrame) -> DataFrame:
    """One row: the number of rows."""
    return df.agg(F.count("*").alias("rows"))


def value_counts(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """Rows per value, most frequent first, ties by value.

    Counts are combined before the shuffle, so a value holding most rows costs
    no more than any other. ``limit`` keeps the top of the report.
    """
    counts = df.groupBy(column).agg(F.count("*").alias("count"))
    ordered = counts.orderBy(F.desc("count"), F.col(column))
    return ordered if limit is None else ordered.limit(limit)


def partition_profile(df: DataFrame) -> DataFrame:
    """Rows per non-empty partition: how many there are, and how uneven."""
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("rows"))
