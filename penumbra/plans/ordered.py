"""Running sums over groups of any size.

A window over one group runs in one task. Here rows are range-sorted by group and order first, so that a group
of any size lies in consecutive blocks; the window runs within a block, and the sum of the blocks before it is
added as an offset. A range boundary cuts at most one group, so that the offsets that matter, those of groups in
more than one block, are at most two rows for each block: that is the proven bound of the one broadcast here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from penumbra.session import materialize

BLOCK = "_block"


def range_blocks(df: DataFrame, group: list[str], order: list, blocks: int | None = None) -> DataFrame:
    """`df` range-sorted by group and order, with the number of its block as the column `_block`.

    It is written out once: the bounds of a range partitioning are sampled, and blocks computed twice could differ.
    """
    by = [F.col(c) for c in group] + list(order)
    out = (df.repartitionByRange(blocks, *by) if blocks else df.repartitionByRange(*by)).sortWithinPartitions(*by)
    return materialize(out.withColumn(BLOCK, F.spark_partition_id()), "blocks")


def running_sum(blocked: DataFrame, group: list[str], order: list, value: str, out: str, total: str | None = None) -> DataFrame:
    """Adds the inclusive running sum of `value` within each group as `out`, and the group's total as `total`.

    `blocked` comes from range_blocks with the same group and order. Null keys form a group of their own.
    """
    sums = blocked.groupBy(*group, BLOCK).agg(F.sum(value).alias("_sum"))
    w = Window.partitionBy(*group)
    # one row per group and block: small even for a group that spans all blocks
    offs = sums.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_before", F.sum("_sum").over(w.orderBy(BLOCK)) - F.col("_sum")).withColumn("_total", F.sum("_sum").over(w))
    cut = offs.where("_n > 1").select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col(BLOCK).alias("_gb"), "_before", "_total")
    cond = F.col(BLOCK) == F.col("_gb")
    for i, c in enumerate(group):
        cond = cond & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    inner = Window.partitionBy(BLOCK, *group)
    res = blocked.withColumn(out, F.sum(value).over(inner.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    if total:
        res = res.withColumn(total, F.sum(value).over(inner))
    res = res.join(F.broadcast(cut), cond, "left").withColumn(out, F.col(out) + F.coalesce("_before", F.lit(0)))
    if total:
        res = res.withColumn(total, F.coalesce("_total", total))
    return res.drop(*[f"_g{i}" for i in range(len(group))], "_gb", "_before", "_total", BLOCK)


def previous(blocked: DataFrame, group: list[str], order: list, value: str, out: str) -> DataFrame:
    """Adds `value` of the row before within each group as `out`; null for a group's first row.

    `blocked` comes from range_blocks with the same group and order, whose rows must be told apart by them. Of groups that lie in several
    blocks the last row of each block is broadcast, at most two rows for each block.
    """
    inner = Window.partitionBy(BLOCK, *group)
    res = blocked.withColumn(out, F.lag(value).over(inner.orderBy(*order))).withColumn("_first", F.row_number().over(inner.orderBy(*order)) == 1)
    last = blocked.groupBy(*group, BLOCK).agg(F.max_by(value, F.struct(*order)).alias("_last"))
    w = Window.partitionBy(*group)
    cut = last.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_before", F.lag("_last").over(w.orderBy(BLOCK))).where("_n > 1")
    cut = cut.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col(BLOCK).alias("_gb"), "_before")
    cond = F.col(BLOCK) == F.col("_gb")
    for i, c in enumerate(group):
        cond = cond & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    res = res.join(F.broadcast(cut), cond, "left").withColumn(out, F.when(F.col("_first"), F.col("_before")).otherwise(F.col(out)))
    return res.drop(*[f"_g{i}" for i in range(len(group))], "_gb", "_before", "_first", BLOCK)
