"""Global order without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.lineage import cut


def numbered(rows: DataFrame, *order, name: str = "position") -> DataFrame:
    """The rows with their place (from 0, a long) in a total order.

    Rows are range-partitioned and sorted, and the result is cut off its lineage, so
    that numbers hold when a task runs again. A row's place is its place within its
    partition and the sizes of the partitions before; only these sizes, one row a
    partition, go through a window of one task and a broadcast."""
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = cut(rows.orderBy(*order).select(F.struct("*").alias("row"), F.spark_partition_id().alias("part"), at.alias("at")))
    sizes = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return dealt.join(F.broadcast(before), "part").select("row.*", (F.col("before") + F.col("at")).alias(name))


def running_sum(rows: DataFrame, value: str, *order, total: str = "before", name: str = "position") -> DataFrame:
    """As numbered, with the sum of a whole-number column over all rows before. Sums and
    sizes of parts, one row each, are all that one task sees."""
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = cut(rows.orderBy(*order).select(F.struct("*").alias("row"), F.spark_partition_id().alias("part"), at.alias("at"), F.coalesce(value, F.lit(0)).alias("value")))
    sums = dealt.groupBy("part").agg(F.sum("value").alias("v"), F.count(F.lit(1)).alias("n"))
    over = Window.orderBy("part")
    before = sums.select("part", (F.sum("v").over(over) - F.col("v")).alias("v"), (F.sum("n").over(over) - F.col("n")).alias("n"))
    own = F.sum("value").over(Window.partitionBy("part").orderBy("at")) - F.col("value")
    return dealt.withColumn("own", own).join(F.broadcast(before), "part").select("row.*", (F.col("v") + F.col("own")).alias(total), (F.col("n") + F.col("at")).alias(name))
