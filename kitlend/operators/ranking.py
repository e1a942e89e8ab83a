"""Global ranks and running sums without a single-partition window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def global_rank(df: DataFrame, order_col: str, rank_col: str = "rank",
                partitions: int | None = None) -> DataFrame:
    """Number rows 1..n in ``order_col`` order (unique values).

    ``Window.orderBy`` without a partition moves every row to one task. Here
    rows are range-partitioned on the order column, each partition counts its
    rows, the running offsets (one row per partition, a proven bound) are
    broadcast, and each row's rank is its partition's offset plus its position
    inside the partition. The partitioned rows are checkpointed so both passes
    see the same partitions.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parted = (df.repartitionByRange(n, F.col(order_col))
              .withColumn("_part", F.spark_partition_id())
              .checkpoint(eager=True))
    counts = parted.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    running = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_part").orderBy(order_col)
    return (parted.join(F.broadcast(offsets), "_part")
            .withColumn(rank_col, (F.col("_off") + F.row_number().over(inside)).cast("int"))
            .drop("_part", "_off"))


def running_sum(df: DataFrame, order_col: str, value_col: str, out: str, descending: bool = False) -> DataFrame:
    """Sum of ``value_col`` over all rows up to each row in ``order_col`` order, rows
    of equal order included; partitioned and offset as in ``global_rank``."""
    order = F.col(order_col).desc() if descending else F.col(order_col).asc()
    parted = (df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()).checkpoint(eager=True))
    sums = parted.groupBy("_part").agg(F.sum(value_col).alias("_s"))
    running = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_part", F.coalesce(F.sum("_s").over(running), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_part").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return (parted.join(F.broadcast(offsets), "_part")
            .withColumn(out, (F.col("_off") + F.sum(value_col).over(inside)).cast("long")).drop("_part", "_off"))
