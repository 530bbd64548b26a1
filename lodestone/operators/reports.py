"""What reports and searches cut, count and compare: bounds per group, filters of proposals, dataset statistics, comparisons of arms."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_of_each(df: DataFrame, group: list[str], most: int, *order: Column) -> DataFrame:
    """The first `most` rows of each group in a total order; the planner limits each partition's groups before the shuffle as well."""
    return df.withColumn("_k", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("_k") <= most).drop("_k")


def above_objectness(score: Column, threshold: float) -> Column:
    """Proposals whose confidence is above, not at, the threshold."""
    return score > threshold


def below_frame_share(w: Column, h: Column, tile_w: Column, tile_h: Column, share: float) -> Column:
    """Boxes that cover at most a share of the tile that they were found in."""
    return w * h <= tile_w * tile_h * share


def in_area_band(area: Column, least: float, most: float) -> Column:
    """Areas between both bounds, each of which is off at 0 or less."""
    low = F.lit(True) if least <= 0 else area >= least
    high = F.lit(True) if most <= 0 else area <= most
    return low & high


def dataset_statistics(boxes: DataFrame, group: list[str], size_bucket: Column) -> DataFrame:
    """Images, instances, least, median and most instances of an image, and instances of each size."""
    each = boxes.withColumn("_bucket", size_bucket).groupBy(*group, "image_id").agg(F.count("*").alias("n"), *[F.count_if(F.col("_bucket") == b).alias(b) for b in ("small", "medium", "large")])
    return each.groupBy(*group).agg(
        F.count("*").alias("images"), F.sum("n").alias("instances"), F.min("n").alias("fewest"), F.percentile("n", F.lit(0.5)).alias("median"), F.max("n").alias("most"),
        *[F.sum(b).alias(b) for b in ("small", "medium", "large")],
    )


def size_gap(recalls: DataFrame) -> DataFrame:
    """From (method, bucket, found, n): recall of large less recall of small instances, and which method has the widest and which the narrowest gap. A method without either kind has a null gap and no place."""
    of = lambda b: F.sum(F.when(F.col("bucket") == b, F.col("found"))) / F.nullif(F.sum(F.when(F.col("bucket") == b, F.col("n"))), F.lit(0))
    gaps = recalls.groupBy("method").agg((of("large") - of("small")).alias("gap"))
    ends = gaps.where("gap IS NOT NULL").agg(F.max_by("method", F.struct("gap", "method")).alias("_widest"), F.min_by("method", F.struct("gap", "method")).alias("_narrowest"))
    return gaps.join(F.broadcast(ends)).select("method", "gap", F.coalesce(F.col("method") == F.col("_widest"), F.lit(False)).alias("widest"), F.coalesce(F.col("method") == F.col("_narrowest"), F.lit(False)).alias("narrowest"))  # one row


def fusion_latency(runs: DataFrame, group: list[str]) -> DataFrame:
    """A fused search takes as long as its runs that ended without an error together."""
    return runs.groupBy(*group).agg(F.sum(F.when(F.col("outcome") != "error", F.col("latency_ms"))).alias("latency_ms"), F.count_if(F.col("outcome") != "error").alias("runs"))


def arm_comparison(results: DataFrame, datasets: DataFrame, arms: list[str]) -> DataFrame:
    """Every dataset with F1 of every arm, by default and tuned settings: (dataset, arm, setting, f1) in columns. Raises if one is missing or null.

    arms is a fixed list of names, so that the product with the datasets stays as small as their number.
    """
    wanted = datasets.select("dataset").distinct().withColumn("arm", F.explode(F.array(*[F.lit(a) for a in arms])))
    held = results.groupBy("dataset", "arm").pivot("setting", ["default", "tuned"]).agg(F.first("f1"))
    joined = wanted.join(held, ["dataset", "arm"], "left")
    for setting in ("default", "tuned"):
        told = F.concat(F.lit(f"no {setting} F1 of "), "dataset", F.lit(" / "), "arm")
        joined = joined.withColumn(setting, F.when(F.col(setting).isNull(), F.raise_error(told).cast("double")).otherwise(F.col(setting)))
    return joined.select("dataset", "arm", "default", "tuned", (F.col("tuned") - F.col("default")).alias("gain"))


def keypoint_counts(keypoints: DataFrame) -> DataFrame:
    """From (image_id, side): how many keypoints the exemplar and the scene of each image have."""
    return keypoints.groupBy("image_id").agg(*[F.count_if(F.col("side") == s).alias(s) for s in ("exemplar", "scene")])


def epoch_means(batches: DataFrame, terms: list[str]) -> DataFrame:
    """Mean of each loss term over an epoch's batches; batches without a term are not counted for it, and without any it is null."""
    return batches.groupBy("epoch").agg(F.count("*").alias("batches"), *[F.avg(t).alias(t) for t in terms])


def latency_by_canvas(results: DataFrame) -> DataFrame:
    """Mean latency of each method and canvas with the canvas' place by area, smaller first, as charts put it on their axis. Sizes that are not two numbers have no place."""
    side = lambda k: F.try_element_at(F.split("canvas_size", "x"), F.lit(k)).try_cast("bigint")
    each = results.withColumn("area", side(1) * side(2)).where("area IS NOT NULL").groupBy("method", "canvas_size", "area").agg(F.avg("latency_ms").alias("latency_ms"))
    return each.withColumn("place", F.dense_rank().over(W.partitionBy("method").orderBy("area"))).drop("area")


def first_images(images: DataFrame, most: int) -> DataFrame:
    """The first images by id, as short runs take them."""
    return images.select("image_id").distinct().orderBy("image_id").limit(most)


def scored_ids(splits: DataFrame) -> DataFrame:
    """The images that are scored: those of validation and test, each once."""
    return splits.where(F.col("split").isin("val", "test")).select("image_id").distinct()


def with_provenance(ids: DataFrame, sources: DataFrame) -> DataFrame:
    """Image ids with the sources that they were taken from; ids without a source are left out."""
    return ids.join(sources, "image_id")


def ids_of_paths(paths: DataFrame, column: str, pattern: str) -> DataFrame:
    """The distinct ids that a pattern's first group has in paths."""
    found = F.regexp_extract(F.col(column), pattern, 1)
    return paths.select(found.alias("image_id")).where("image_id <> ''").distinct()


def confined(path: str, base: str) -> str:
    """The path under base, as text; raises ValueError if it leaves it. No file is looked at: stores are read by Spark alone."""
    out: list[str] = []
    if PurePosixPath(path).is_absolute() or "\\" in path or "\x00" in path:
        raise ValueError(f"not a path under the base: {path!r}")
    for part in PurePosixPath(path).parts:
        if part == "..":
            if not out:
                raise ValueError(f"not a path under the base: {path!r}")
            out.pop()
        else:
            out.append(part)
    return str(PurePosixPath(base, *out))
