"""Row numbers over whole tables without a window that holds them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.staging import broadcast_if_small, staged


def numbered(df: DataFrame, order: list[Column | str], name: str = "row_no", parts: int | None = None) -> DataFrame:
    """df with its row's place in the given order, from 0, as a staged table.

    The table is range-sorted, each task counts in its own range, and the totals of the ranges, one number for
    each, give where a range begins. The order should tell all rows apart: equal rows get places in any order.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()  # partition number in the upper bits, place in the partition in the lower 33
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = staged(ranged.withColumn("__id", at).select("*", F.shiftright("__id", 33).cast("int").alias("__range"), F.col("__id").bitwiseAND((1 << 33) - 1).alias("__at")).drop("__id"), "numbered")
    begins, total = [], 0
    for r in rows.groupBy("__range").agg(F.count("*").alias("n")).orderBy("__range").collect():  # one row for each range
        begins.append((r["__range"], total))
        total += r["n"]
    lookup = spark.createDataFrame(begins, "__range int, __begin long")
    return rows.join(F.broadcast(lookup), "__range").withColumn(name, F.col("__begin") + F.col("__at")).drop("__range", "__at", "__begin")


def numbered_in(df: DataFrame, group: str, order: list[Column | str], name: str = "pos") -> DataFrame:
    """df with its row's place in its group, from 0: the place in the whole table less that of the group's first
    row, so that a group that holds most rows is still cut over tasks."""
    rows = staged(numbered(df, [F.col(group), *order], "__no"), "numbered-in")
    firsts = staged(rows.groupBy(F.col(group).alias("__group")).agg(F.min("__no").alias("__first")), "firsts")
    joined = rows.join(broadcast_if_small(firsts), F.col(group).eqNullSafe(F.col("__group")))
    return joined.withColumn(name, F.col("__no") - F.col("__first")).drop("__no", "__group", "__first")
