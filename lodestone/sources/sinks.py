"""Writers: the run store as appended Parquet tables, sidecars and manifests as JSON with sorted keys, report rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.rates import shown
from lodestone.operators.dense import kept_rows


class Store:
    """Tables under one folder. Rows are appended; ids go on from the largest; deletions rewrite to a new version."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{table}")

    def append(self, table: str, rows: DataFrame, key: str | None = None, order: str | None = None) -> None:
        """With `key`, rows get ids by `order`, following the largest so far."""
        if key:
            try:
                last = self.read(table).agg(F.max(key)).first()[0] or 0
            except Exception as e:
                if "PATH_NOT_FOUND" not in str(e):
                    raise
                last = 0
            numbered = kept_rows(rows.orderBy(order or rows.columns[0]).withColumn("_i", F.monotonically_increasing_id()))  # counted and written from the same rows
            starts = {r[0]: r[1] for r in numbered.groupBy(F.shiftright("_i", 33).alias("p")).count().collect()}
            at, before = last + 1, F.lit(0)
            for p in sorted(starts):
                before = F.when(F.shiftright("_i", 33) == p, at).otherwise(before)
                at += starts[p]
            rows = numbered.withColumn(key, (before + F.col("_i").bitwiseAND((1 << 33) - 1)).cast("bigint")).drop("_i")
        rows.write.mode("append").parquet(f"{self.root}/{table}")

    def insert(self, tables: dict[str, DataFrame]) -> str:
        """Rows of several tables that become visible together: parts first, then the one record that names their batch. Without it no reader sees them."""
        batch = uuid.uuid4().hex
        for table, rows in tables.items():
            rows.write.parquet(f"{self.root}/{table}/batch={batch}")
        self.spark.createDataFrame([(batch, sorted(tables))], "batch string, tables array<string>").coalesce(1).write.mode("append").parquet(f"{self.root}/commits")
        return batch

    def inserted(self, table: str) -> DataFrame:
        """The table's rows of all batches that are recorded."""
        done = self.read("commits").select("batch").distinct()
        rows = self.spark.read.option("basePath", f"{self.root}/{table}").parquet(f"{self.root}/{table}/batch=*")
        return rows.withColumn("batch", F.col("batch").cast("string")).join(done, "batch", "left_semi").drop("batch")

    def version(self) -> int:
        try:
            return self.read("schema_version").agg(F.max("version")).first()[0] or 0
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return 0

    def migrate(self, steps: dict[int, Callable[[Store], None]], views: dict[str, Callable[[Store], DataFrame]] | None = None) -> int:
        """Apply the steps above the store's version in order, each recorded once it is done, then set up the views anew. A store from a later build is refused."""
        now, last = self.version(), max(steps, default=0)
        if now > last:
            raise RuntimeError(f"the store is at version {now}, this build knows {last}")
        for step in sorted(k for k in steps if k > now):
            steps[step](self)  # raises before its version is recorded, so that it runs again
            self.spark.createDataFrame([(step,)], "version int").coalesce(1).write.mode("append").parquet(f"{self.root}/schema_version")
        for name, of in (views or {}).items():
            of(self).createOrReplaceTempView(name)
        return self.version()


def write_json(rows: DataFrame, path: str) -> None:
    """A line for each row, its keys in alphabetic order, nulls kept."""
    rows.select(*sorted(rows.columns)).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def report_rows(table: DataFrame, digits: int = 3) -> DataFrame:
    """Markdown lines of a table; null as n/a."""
    cells = [shown(F.col(c), digits) if t in ("double", "float") else F.coalesce(F.col(c).cast("string"), F.lit("n/a")) for c, t in table.dtypes]
    return table.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def replace_block(old: DataFrame, new: DataFrame, key: str = "dataset") -> DataFrame:
    """A manifest with the blocks of new's keys replaced."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)
