"""Running counts and ranks over whole groups or tables without a single-task window.

Rows are range-partitioned by group and order and kept; each partition counts its own groups, the
few counts are added up over partitions (a row for each group and partition), and each row adds its
place within its partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reckon.store import keep


def running_counts(df: DataFrame, group: list[str], order: list[str], n: str) -> DataFrame:
    """df with `before`: the sum of n over the rows of the same group that come before by `order`."""
    cut = df.repartitionByRange(*group, *order).withColumn("_p", F.spark_partition_id())
    kept = keep(cut, "ranges")  # partition numbers must be the same for both uses
    sums = kept.groupBy(*group, "_p").agg(F.sum(n).alias("_n"))
    over = Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.withColumn("_base", F.coalesce(F.sum("_n").over(over), F.lit(0))).drop("_n")
    own = Window.partitionBy(*group, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    mine = kept.withColumn("_own", F.coalesce(F.sum(n).over(own), F.lit(0)))
    return mine.join(base, [*group, "_p"]).withColumn("before", F.col("_base") + F.col("_own")).drop("_p", "_base", "_own")


def beyond(df: DataFrame, first: int, order: list[str]) -> DataFrame:
    """The rows of df after its first `first` by order."""
    one = df.withColumn("_g", F.lit(0)).withColumn("_one", F.lit(1))
    return running_counts(one, ["_g"], order, "_one").where(F.col("before") >= first).drop("_g", "_one", "before")
