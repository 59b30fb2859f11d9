"""Consecutive numbers inside groups of any size, along an order of any type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertweave.session import cut_lineage


def number_within(df: DataFrame, group: list[str], order: list[Column | str], name: str) -> DataFrame:
    """Add 1, 2, 3... per group along `order`, without one task holding a whole group.

    Rows are dealt out by ranges of (group, order), as Spark samples them, and sorted where they are, so a large group lies
    in several neighbouring tasks. A row's number is its place in its task plus the sizes of the group's parts before,
    one row per group and task. Equal rows get different numbers. The table is stored on the way, so that places stay.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in [*group, *order]]
    placed = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id())
    )
    placed = cut_lineage(placed)
    parts = placed.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_size"), F.min("_place").alias("_first"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_size").over(earlier), F.lit(0)) - F.col("_first") + 1
    renamed = {c: f"_group_{k}" for k, c in enumerate(group)}
    parts = parts.withColumn("_shift", shift).select(*[F.col(c).alias(n) for c, n in renamed.items()], F.col("_part").alias("_group_part"), "_shift")
    same = F.col("_part") == F.col("_group_part")
    for c, n in renamed.items():
        same &= F.col(c).eqNullSafe(F.col(n))
    return (
        placed.join(parts.hint("merge"), same)
        .withColumn(name, (F.col("_place") + F.col("_shift")).cast("long"))
        .drop("_part", "_place", "_group_part", "_shift", *renamed.values())
    )
