"""Registration of a query with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.views import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Views:
    """v.runs is the view `runs`."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)


def rounded(x: Column) -> Column:
    """To 6 digits in binary arithmetic, halves away from zero, as DuckDB rounds; F.round would go by the decimal text, which makes other halves."""
    scaled = F.abs(x) * 1e6
    return F.when(scaled < 2.0**52, F.signum(x) * F.floor(scaled + 0.5) / 1e6 + 0.0).otherwise(x)


def query(sql: str | None = None):
    """Register a function of Views under its name. Doubles are rounded to 6 digits on both sides."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(Views(spark, sf_dir))
            return df.select(*[rounded(F.col(f"`{c}`")).alias(c) if t == "double" else (F.col(f"`{c}`").cast("bigint").alias(c) if t in ("int", "smallint", "tinyint") else F.col(f"`{c}`")) for c, t in df.dtypes])

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLES[f.__name__] = with_views(sql)
        return f

    return register
