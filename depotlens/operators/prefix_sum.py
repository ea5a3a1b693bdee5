"""Running sums over ordered groups of any size.

A window over a whole group runs in one task.  Here a group is cut into buckets by its order, the buckets are summed with map-side
combining, the sums of the buckets before are added up in the small table of buckets, and only the rows of one bucket meet in a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(rows: DataFrame, group: Sequence[str], bucket: str, order: Sequence[Column | str], value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows before this one in its group, by (bucket, order); 0 for the first.

    ``bucket``: a column that never decreases along the order and keeps each bucket small enough for a task; the number of
    buckets bounds the second window.  ``order`` must be total within a bucket.  Nulls in ``value`` count as 0.
    """
    value_of = F.coalesce(F.col(value), F.lit(0))
    sums = rows.groupBy(*group, bucket).agg(F.sum(value_of).alias("__sum"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*group, bucket, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("__local", F.coalesce(F.sum(value_of).over(inside), F.lit(0)))
    return local.join(starts, [*group, bucket]).withColumn(out, F.col("__start") + F.col("__local")).drop("__start", "__local")
