"""Positions in a sorted table, whatever its groups' sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glintfield.llm.common import settled


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows(group, copies, ...) with `first`, how many copies of its group stand before it, and `n`, all of its group.

    Rows are dealt by ranges of (group, order), so a group of any size is spread over tasks; each range
    numbers its own rows and adds what the ranges before it hold, one number a range and group. group is
    never null and (group, order) is unique (repeated rows are one row with its `copies`).
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = settled(rows.repartitionByRange(parts, group, *order).withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy("part", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    numbered = dealt.withColumn("first", F.coalesce(F.sum("copies").over(before), F.lit(0)))
    whole = Window.partitionBy(group)
    ahead = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(group, "part").agg(F.sum("copies").alias("copies"))
    ranges = counts.select(group, "part", F.coalesce(F.sum("copies").over(ahead), F.lit(0)).alias("ahead"), F.sum("copies").over(whole).alias("n"))
    return numbered.join(ranges, ["part", group]).withColumn("first", F.col("first") + F.col("ahead")).drop("part", "ahead")
