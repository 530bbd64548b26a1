"""What the corpus operators share: durable intermediate results, id remainders, Arrow batches by size."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = "[^\\x20\\x09-\\x0D]+"


def ship(module_name: str) -> None:
    """Send a module's functions to the executors by value, so that they need not have the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only on a local master where none is named."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="lodestone-"))
    return jsc.getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """Compute once and keep in the checkpoint folder: later reads survive lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As durable, as a compressed table: for what is large and read by columns."""
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def id_remainder(modulus: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo: null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def unit_hash(*columns: str, seed: int) -> Column:
    """A number from 0 up to 1 that depends only on the columns and the seed."""
    return (F.xxhash64(F.lit(seed), *[F.col(c) for c in columns]).bitwiseAND((1 << 53) - 1)) / float(1 << 53)


ship(__name__)
