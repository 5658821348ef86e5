"""Distributed sort by ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sort_partitions(df: DataFrame, column: str, parts: int) -> DataFrame:
    """Rows dealt by range and sorted within: read in partition order they are sorted. Sampling sets the ranges; equal values share a partition unless others follow them, so ties should carry a second column."""
    return df.repartitionByRange(parts, column).sortWithinPartitions(column)


def part_summary(df: DataFrame, column: str, parts: int) -> DataFrame:
    """part, n, low, high of the sorted partitions."""
    return sort_partitions(df, column, parts).groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n"),
        F.min(column).alias("low"), F.max(column).alias("high"))
