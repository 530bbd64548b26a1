"""Mixing sources to target weights by systematic sampling; DataFrame operations only.

Every document of a source expects the same number of copies, the source's target over its size. These are
prefix-summed within the source over its documents by rising size, one random offset from 0 to 1 is added, and a
document is emitted once for each whole number its interval crosses. As neighbours in that order have nearly
equal sizes, the words taken stay within about one document of the target. Positions come from range partitions
and totals of partitions, so that no task holds a whole source.

Defined results: null text has size 0; a null source is a source of its own, ordered last; a source without words
has target 0 and gives nothing; rows with equal id, source and size are interchangeable; an empty table gives
an empty mix. Extra columns pass through `mix_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.ordering import placed

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
SEED = "mix-1"
SPACES = "[\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words `[^\\x20\\x09-\\x0D]+`; null counts as no text."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACES)
    return (F.size(parts) - (F.element_at(parts, 1) == "").cast("int") - ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """A row for each source: source, source_size, target, copies, offset.

    The weights repeat over the sources in order of code point, null last. Targets share the total of all sizes by
    weight; whatever is above `most` times a source's size is shared again among the others. That ends at
    target = min(most * size, level * weight) with one level for all, found from running sums over the sources
    by the level at which each meets its limit. One row a source goes through the unpartitioned windows.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = W.orderBy(F.col("source").asc_nulls_last())
    weighed = by_source.withColumn("_weight", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(named) - 1) % len(weights) + 1).cast("int")).cast("long"))
    limit = F.col("source_size") * most
    rising = W.orderBy(limit / F.col("_weight"), F.col("source").asc_nulls_last())
    before, whole = rising.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    levels = (
        weighed.withColumn("_limit", limit)
        .withColumn("_left", F.sum("source_size").over(whole) - F.coalesce(F.sum("_limit").over(before), F.lit(0)))
        .withColumn("_weights", F.sum("_weight").over(whole) - F.coalesce(F.sum("_weight").over(before), F.lit(0)))
        .withColumn("_open", F.col("_left") * F.col("_weight") <= F.col("_limit") * F.col("_weights"))
    )
    # the first source, by rising limit, that stays below it fixes the level for itself and all after it
    first = F.min(F.when(F.col("_open"), F.struct(limit / F.col("_weight"), F.col("source").isNull(), "source", "_left", "_weights"))).over(whole)
    target = F.least(F.col("_limit").cast("double"), first["_left"].cast("double") * F.col("_weight") / first["_weights"])
    return (
        levels.withColumn("target", F.coalesce(target, F.col("_limit").cast("double")))
        .withColumn("copies", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        .withColumn("offset", F.conv(F.substring(F.md5(F.concat(F.lit(SEED), F.coalesce("source", F.lit("")))), 1, 8), 16, 10).cast("double") / float(1 << 32))
        .select("source", "source_size", "target", "copies", "offset")
    )


def take_counts(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(doc_id, source, size) -> with source_size, target and n_copies, a row for each row."""
    rows = placed(sized.select("doc_id", "source", "size"), F.col("source").asc_nulls_last(), F.col("size"), F.col("doc_id"))
    totals = rows.groupBy("_part", "source").agg(F.count("*").alias("_n"), F.min("_pos").alias("_first"))
    starts = totals.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy("source").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) - F.col("_first"))
    targets = source_targets(rows, weights, most).withColumnRenamed("source", "_of")
    starts = starts.join(targets, F.col("source").eqNullSafe(F.col("_of"))).select(F.col("_part").alias("_p"), F.col("source").alias("_s"), "_before", "source_size", "target", "copies", "offset")
    rank = (F.col("_pos") + F.col("_before")).cast("double")
    crossed = F.floor(F.col("offset") + F.col("copies") * (rank + 1)) - F.floor(F.col("offset") + F.col("copies") * rank)
    return (
        rows.join(starts, (F.col("_part") == F.col("_p")) & F.col("source").eqNullSafe(F.col("_s")))
        .withColumn("n_copies", F.least(crossed, F.ceil("copies")).cast("long"))
        .select("doc_id", "source", "size", "source_size", "target", "n_copies")
    )


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """The mix itself: docs with each row repeated as often as it is taken, in docs' columns.

    Rows that share an id are told apart by their source and size; of rows equal in these, each is taken as
    often as its own interval says, in any order.
    """
    names = docs.columns
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"))
    key = ("doc_id", "source", "size")
    twin = F.row_number().over(W.partitionBy(*key).orderBy(F.lit(0)))
    counts = take_counts(sized, weights, most).select(*[F.col(c).alias(f"_{c}") for c in key], "n_copies")
    counts = counts.withColumn("_twin", F.row_number().over(W.partitionBy("_doc_id", "_source", "_size").orderBy(F.lit(0)))).where("n_copies > 0")
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")) & (F.col("twin") == F.col("_twin"))
    return (
        sized.withColumn("twin", twin)
        .join(counts, same)
        .select("_row", F.explode(F.sequence(F.lit(1), F.col("n_copies").cast("int"))))
        .select("_row.*")
    )


def mix_report(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, size, source_size, target, taken."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return take_counts(sized).select("doc_id", "size", "source_size", "target", (F.col("n_copies") * F.col("size")).alias("taken"), "source", "n_copies")


MIX_SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents
), by_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT source, source_size, source_size * 3 AS lim, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight FROM by_source
), levels AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(lim) OVER before, 0) AS BIGINT) AS rest, CAST(sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS BIGINT) AS weights,
    row_number() OVER (ORDER BY lim / weight, source NULLS LAST) AS k
  FROM weighed WINDOW before AS (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT min_by(rest, k) AS rest, min_by(weights, k) AS weights FROM levels WHERE rest * weight <= lim * weights
), targets AS (
  SELECT source, source_size, coalesce(least(CAST(lim AS DOUBLE), CAST(level.rest AS DOUBLE) * weight / level.weights), CAST(lim AS DOUBLE)) AS target FROM levels LEFT JOIN level ON true
), rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS copies,
    CAST(CAST('0x' || substr(md5('mix-1' || coalesce(source, '')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS u
  FROM targets
), ranked AS (
  SELECT s.doc_id, s.source, s.size, r.source_size, r.target, r.copies, r.u, CAST(row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.doc_id NULLS FIRST) AS DOUBLE) AS k
  FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source
), taken AS (
  SELECT *, CAST(least(floor(u + copies * k) - floor(u + copies * (k - 1)), ceil(copies)) AS BIGINT) AS n_copies FROM ranked
)
"""
MIX_REPORT_SQL = MIX_SQL + "SELECT doc_id, size, source_size, target, n_copies * size AS taken, source, n_copies FROM taken"
