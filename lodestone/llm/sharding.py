"""Contiguous shards of nearly equal bytes; DataFrame operations only.

Documents are put into one global order, by default of their text's MD5 and their id, so that equal texts are
neighbours. Each range partition gives its total of bytes; prefix sums over these totals, and over the rows of a
partition, give every document the place of its first byte; the whole is cut at equal targets. A group of equal texts over
which a cut would fall goes whole to the shard that holds its middle if it is smaller than `LOOSE` of a target; a larger
one is cut between its documents. A shard's size so differs from its target by less than that and the documents at its cuts.

Defined results: null text has no bytes; size is the text's bytes plus 8; rows may repeat and each gets a slot of
its own; with fewer documents than shards some shards stay empty; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.common import text_or_empty
from lodestone.llm.ordering import placed

SHARDS = 24
OVERHEAD = 8
LOOSE = 0.05


def byte_shards(sized: DataFrame, shards: int = SHARDS, order: tuple[str, ...] = ("order_key", "doc_id")) -> DataFrame:
    """Adds `shard` (0 to shards - 1) and `slot` (from 0, gapless in its shard) to rows that have `size` > 0. The first column of the order names the group."""
    rows = placed(sized, *[F.col(c) for c in order])
    totals = rows.groupBy("_part").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
    earlier, whole = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    starts = totals.select(  # a row for each range partition
        F.col("_part").alias("_p"),
        F.coalesce(F.sum("_bytes").over(earlier), F.lit(0)).alias("_bytes_before"),
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows_before"),
        F.sum("_bytes").over(whole).alias("_total"),
    )
    inside = F.sum("size").over(W.partitionBy("_part").orderBy("_pos").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    cut = (
        rows.withColumn("_inside", inside)
        .join(starts, F.col("_part") == F.col("_p"))
        .withColumn("_first_byte", F.col("_bytes_before") + F.col("_inside"))
        .withColumn("_rank", F.col("_rows_before") + F.col("_pos"))
    )

    def shard_at(byte: Column) -> Column:
        return F.least(F.floor(byte / F.col("_total") * shards), F.lit(shards - 1)).cast("int")

    extent = cut.groupBy(F.col(order[0]).alias("_group")).agg(F.min("_first_byte").alias("_from"), F.max(F.col("_first_byte") + F.col("size")).alias("_to"), F.first("_total").alias("_total"))
    over = extent.where((shard_at(F.col("_from")) < shard_at(F.col("_to") - 1)) & ((F.col("_to") - F.col("_from")) * shards <= F.col("_total") * LOOSE))
    whole_groups = over.select("_group", shard_at((F.col("_from") + F.col("_to")) / 2).alias("_home"))  # fewer than there are cuts
    cut = cut.join(F.broadcast(whole_groups), F.col(order[0]) == F.col("_group"), "left").withColumn("shard", F.coalesce("_home", shard_at(F.col("_first_byte") + F.shiftright("size", 1))))
    firsts = cut.groupBy("shard").agg(F.min("_rank").alias("_first")).withColumnRenamed("shard", "_shard")
    return (
        cut.join(F.broadcast(firsts), F.col("shard") == F.col("_shard"))  # as many rows as shards
        .withColumn("slot", F.col("_rank") - F.col("_first"))
        .select(*sized.columns, "shard", "slot")
    )


def crc32_sql(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, by a table of 256 remainders that is made by the polynomial's rule."""
    step = "CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END"
    table = f"(SELECT list(list_reduce([CAST(b AS BIGINT)] || list_transform(range(8), lambda k: CAST(0 AS BIGINT)), lambda r, k: {step}) ORDER BY b) FROM (SELECT unnest(range(256)) AS b))"
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    return f"xor(list_reduce([CAST(4294967295 AS BIGINT)] || {octets}, lambda s, x: xor(s >> 8, crc_table[(xor(s, x) & 255) + 1])), 4294967295) FROM (SELECT {table} AS crc_table)"


SHARD_SQL = f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
z AS (SELECT doc_id, strlen(text) + {OVERHEAD} AS size, (SELECT {crc32_sql("t.text")}) AS text_crc32, md5(text) AS k FROM t),
p AS (SELECT *, sum(size) OVER (ORDER BY k, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) - size AS first_byte, row_number() OVER (ORDER BY k, doc_id NULLS FIRST) - 1 AS place, CAST(sum(size) OVER () AS DOUBLE) AS total FROM z),
g AS (SELECT k, min(first_byte) AS low, max(first_byte + size) AS high, min(total) AS total FROM p GROUP BY k),
h AS (SELECT k, least(floor((low + high) / 2 / total * {SHARDS}), {SHARDS - 1}) AS home FROM g
  WHERE least(floor(low / total * {SHARDS}), {SHARDS - 1}) < least(floor((high - 1) / total * {SHARDS}), {SHARDS - 1}) AND (high - low) * {SHARDS} <= total * {LOOSE}),
c AS (SELECT p.*, CAST(coalesce(home, least(floor((first_byte + size // 2) / total * {SHARDS}), {SHARDS - 1})) AS INT) AS shard FROM p LEFT JOIN h ON h.k = p.k)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard, place - min(place) OVER (PARTITION BY shard) AS slot, CAST(NULL AS INT) AS grown_shard FROM c"""


def shard_report(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    text = text_or_empty()
    sized = docs.select(
        "doc_id",
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(text.cast("binary")).alias("order_key"),
    )
    return byte_shards(sized, shards).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
