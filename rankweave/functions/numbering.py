"""Exact numbers and running totals over a whole table, in any order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.functions.saved import saved

#: monotonically_increasing_id() holds a row's place within its partition in so many low bits.
_PLACE_BITS = 33


def numbered(df: DataFrame, *order: Column | str, number: str = "number", total: str | None = None, of: str | None = None) -> DataFrame:
    """df with a column of row numbers from 0 in the given order; a job runs at once.

    With total, that column has the sum of the column `of` over the rows before each (0 for the first;
    nulls count 0). Rows are range partitioned by the order, numbered within their partition where they
    lie, and moved by the counts of the partitions before, a table with one row for each partition.
    Rows that tie in the order are numbered in an arbitrary one and stand in one partition, so an
    order that many rows tie in should end with columns that tell them apart. The numbered rows are
    saved once, as a second sampling of ranges need not give the same ones. An empty table stays empty.
    """
    columns, by = df.columns, [F.col(o) if isinstance(o, str) else o for o in order]
    placed = saved(df.repartitionByRange(*by).sortWithinPartitions(*by).select("*", F.monotonically_increasing_id().alias("_place")))
    placed = placed.withColumn("_part", F.shiftright("_place", _PLACE_BITS).cast("int")).withColumn("_place", F.col("_place").bitwiseAND((1 << _PLACE_BITS) - 1))
    sums = [F.count("*").alias("_rows")] + ([F.sum(of).alias("_sum")] if total else [])
    parts = placed.groupBy("_part").agg(*sums)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    offsets = parts.select("_part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in parts.columns[1:]))
    out = placed.join(F.broadcast(offsets), "_part")
    news = [(F.col("_rows_before") + F.col("_place")).alias(number)]
    if total:
        inside = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
        news.append((F.col("_sum_before") + F.coalesce(F.sum(of).over(inside), F.lit(0))).alias(total))
    return out.select(*columns, *news)
