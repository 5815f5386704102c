"""Ordered-row operators in two levels.

A plain window sorts one whole key in one task. Here every key is cut into blocks along its own
order (pages, line ranges), the window runs per ``(key, block)``, and only one summary row per
block takes part in the window over the key. A key that holds a large share of all rows is
thereby spread over as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LINES_PER_BLOCK = 4096


def block_of(position: Column, size: int = LINES_PER_BLOCK) -> Column:
    """Block number of an integer position."""
    return F.floor(position / size).cast("bigint")


def _before(keys: Sequence[str], block: str):
    return Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)


def rank_in_order(df: DataFrame, keys: Sequence[str], block: str, order: Sequence[Column], out: str) -> DataFrame:
    """1-based position of every row in its key, ordered by block and ``order``."""
    inner = Window.partitionBy(*keys, block).orderBy(*order)
    sizes = df.groupBy(*keys, block).agg(F.count("*").alias("_n"))
    offsets = sizes.select(*keys, block, F.coalesce(F.sum("_n").over(_before(keys, block)), F.lit(0)).alias("_off"))
    return (df.withColumn("_in", F.row_number().over(inner)).join(offsets, [*keys, block])
            .withColumn(out, F.col("_in") + F.col("_off")).drop("_in", "_off"))


def running_total(df: DataFrame, keys: Sequence[str], block: str, order: Sequence[Column], value: Column,
                  out: str) -> DataFrame:
    """Sum of ``value`` from the start of the key up to and including the row."""
    inner = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_v", value.cast("bigint"))
    sums = df.groupBy(*keys, block).agg(F.sum("_v").alias("_s"))
    offsets = sums.select(*keys, block, F.coalesce(F.sum("_s").over(_before(keys, block)), F.lit(0)).alias("_off"))
    return (df.withColumn("_in", F.coalesce(F.sum("_v").over(inner), F.lit(0))).join(offsets, [*keys, block])
            .withColumn(out, F.col("_in") + F.col("_off")).drop("_in", "_off", "_v"))


def carry_forward(df: DataFrame, keys: Sequence[str], block: str, order: Sequence[str], value: str,
                  out: str) -> DataFrame:
    """Last non-null ``value`` of the key at or before the row."""
    inner = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = F.max(F.when(F.col(value).isNotNull(), F.struct(*order, F.col(value).alias("_v"))))
    blocks = df.groupBy(*keys, block).agg(last["_v"].alias("_v"))
    carried = blocks.select(*keys, block, F.last("_v", ignorenulls=True).over(_before(keys, block)).alias("_c"))
    return (df.withColumn("_in", F.last(value, ignorenulls=True).over(inner)).join(carried, [*keys, block])
            .withColumn(out, F.coalesce("_in", "_c")).drop("_in", "_c"))
