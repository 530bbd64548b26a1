"""Positions in a global order without a single task: range partitions, local positions, totals of partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import durable, shuffle_partitions

LOCAL_BITS = 33


def placed(df: DataFrame, *order: Column) -> DataFrame:
    """df dealt out by ranges of `order` and kept, with `_part` (ascending with the order) and `_pos` (from 0, gapless in its part)."""
    n = shuffle_partitions(df.sparkSession)
    numbered = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    return (
        durable(numbered)
        .withColumn("_part", F.shiftright("_id", LOCAL_BITS))
        .withColumn("_pos", F.col("_id").bitwiseAND((1 << LOCAL_BITS) - 1))
        .drop("_id")
    )
