"""Sweeps: all settings of a search's options as a table, and the best of them."""

from __future__ import annotations

from math import prod
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.plans.registry import configured


def grid(spark: SparkSession, options: dict[str, list[Any]]) -> DataFrame:
    """(trial, one column for each option): every combination, the last option changing fastest. Trials are numbered, so nothing is crossed."""
    left = prod(len(v) for v in options.values())
    out = spark.range(left).withColumnRenamed("id", "trial")
    for name, values in options.items():
        left //= len(values)
        at = (F.floor(F.col("trial") / left) % len(values)).cast("int")
        out = out.withColumn(name, F.get(F.array(*[F.lit(v) for v in values]), at))
    return out


def checked(method: str, settings: DataFrame, bound: int = 10_000) -> list[Any]:
    """The settings as the method's configurations; all faults of one are raised together. A sweep of more than `bound` trials is refused."""
    rows = settings.orderBy("trial").limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"more than {bound} trials")
    return [configured(method, {k: v for k, v in r.asDict().items() if k != "trial"}) for r in rows]
