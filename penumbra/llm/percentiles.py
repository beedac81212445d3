"""Percentiles of very large numeric columns by cumulative frequencies, in SQL operators only.

Values are reduced to counts of each group and value, the counts are range-sorted, running sums are taken within each range
block with the blocks before it as offset, and each percentile is the first value whose running sum reaches its rank.
Summaries are tables of counts: those of separate partitions or days are put together by adding counts.
"""

from __future__ import annotations

import math
from decimal import Decimal
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penumbra.plans.ordered import range_blocks, running_sum

VALUE, COUNT = "value", "n"


def summarise(df: DataFrame, group: list[str], value: str, relative_error: float | None = None) -> DataFrame:
    """Counts of each group and value: columns group, value (double), n.

    Null and NaN values do not count; infinite ones do, at the ends. Without relative_error the summary is exact. With it,
    values are put into geometric cells whose middle is off by that share at most, so that a summary's size follows the logarithm
    of the values' range and not the number of rows; zero has its own cell, negative values mirror positive ones.
    """
    v = F.col(value).cast("double")
    src = df.select(*group, v.alias(VALUE)).where(F.col(VALUE).isNotNull() & ~F.isnan(VALUE))
    if relative_error:
        g = (1 + relative_error) / (1 - relative_error)
        a = F.abs(VALUE)
        cell = F.ceil(F.log(a) / math.log(g)).cast("double")
        mid = F.signum(VALUE) * F.pow(F.lit(g), cell) * (2 / (1 + g))
        src = src.withColumn(VALUE, F.when((a == 0) | (a == float("inf")), F.col(VALUE)).otherwise(mid))
    return src.withColumn(VALUE, F.col(VALUE) + F.lit(0.0)).groupBy(*group, VALUE).agg(F.count(F.lit(1)).alias(COUNT))


def combine(summaries: list[DataFrame] | DataFrame, group: list[str]) -> DataFrame:
    """The summary of all rows behind several summaries (or of one that has finer groups)."""
    every = summaries if isinstance(summaries, DataFrame) else reduce(DataFrame.unionByName, summaries)
    return every.groupBy(*group, VALUE).agg(F.sum(COUNT).alias(COUNT))


def percentiles(summary: DataFrame, group: list[str], qs: dict[str, float]) -> DataFrame:
    """One row per group: total (rows counted) and a column for each of qs (name -> share in [0, 1]).

    A percentile is the least value that has at least ceil(q * total) rows at or below it, and the least value for q = 0. Exact ranks;
    the value's error is that of the summary. Groups without counted rows are not there. A group of any size is spread over the blocks.
    """
    order = [F.col(VALUE)]
    ran = running_sum(range_blocks(summary, group, order), group, order, COUNT, "_cum", "_all")
    # shares as they are written, in decimals: 0.07 of 100 rows are 7, which in doubles come out as more
    rank = lambda q: F.expr(f"greatest(cast(ceil({Decimal(repr(float(q))):f}BD * cast(_all as decimal(18, 0))) as bigint), 1)")
    first = [F.min(F.when(F.col("_cum") >= rank(q), F.col(VALUE))).alias(name) for name, q in qs.items()]
    return ran.groupBy(*group).agg(F.max("_all").alias("total"), *first)
