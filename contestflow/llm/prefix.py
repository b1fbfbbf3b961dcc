"""Running totals over a global order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize


def running_total(df: DataFrame, order: list[str], value: str, into: str, group: str | None = None) -> DataFrame:
    """Add ``into``: the sum of ``value`` up to and with the row, in ``order``, per ``group``.

    Rows are range-partitioned and written once, so the partitions stay as they are; each has
    its own running sum, and prefix sums over the partitions' totals (one row per partition and
    group) are added. ``order`` starts with ``group``; a group larger than a partition spans
    several. ``value`` has no nulls. Rows equal in ``order`` follow each other in any order.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id())
    fixed = materialize(ranged, "ranged")
    keys = ["_part"] + [group] * bool(group)
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = (Window.partitionBy(group) if group else Window.partitionBy()).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = fixed.groupBy(*keys).agg(F.sum(value).alias("_total"))
    bases = totals.select(*keys, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_base"))
    return fixed.withColumn("_local", F.sum(value).over(upto)).join(bases, keys).withColumn(into, _sum("_local", "_base")).drop("_part", "_local", "_base")


def _sum(a: str, b: str) -> Column:
    return F.col(a) + F.col(b)
