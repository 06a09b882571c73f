"""Running sums and dense numbers without a one-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(df: DataFrame, group: list[str], bucket: Column, order: list, value: Column, name: str) -> DataFrame:
    """df with name: the sum of value over earlier rows of the group, in the order of (bucket, order).

    bucket must not fall when order rises. Rows are summed inside their bucket, buckets over one row each,
    so the largest window holds one bucket or one group's buckets.
    """
    df = df.withColumn("_bucket", bucket)
    inner = Window.partitionBy(*group, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*group, "_bucket").agg(F.sum(value).alias("_sum"))
    totals = totals.select(*group, "_bucket", F.coalesce(F.sum("_sum").over(outer), F.lit(0)).alias("_before"))
    df = df.withColumn("_inner", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return df.join(totals, [*group, "_bucket"]).withColumn(name, (F.col("_before") + F.col("_inner")).cast("long")).drop("_before", "_inner", "_bucket")
