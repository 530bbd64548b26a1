"""Seeded splits, samples and de-duplication of image sets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def seeded(key: str, seed: int) -> Column:
    """A fixed random-looking order: md5 of seed and key."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(key).cast("string")))


def unique_content(rows: DataFrame) -> DataFrame:
    """(image_id, content): of equal contents the smallest id."""
    return rows.groupBy(F.sha2("content", 256).alias("hash")).agg(F.min("image_id").alias("image_id"), F.count("*").alias("copies"))


def leaks(rows: DataFrame) -> DataFrame:
    """Ids that are in more than one split."""
    return rows.groupBy("image_id").agg(F.countDistinct("split").alias("splits")).where("splits > 1").select("image_id")


def clean(rows: DataFrame) -> DataFrame:
    """Without leaked ids, and of equal contents only the smallest id."""
    kept = rows.join(leaks(rows), "image_id", "left_anti")
    first = kept.withColumn("_k", F.min("image_id").over(W.partitionBy(F.sha2("content", 256))))
    return first.where("image_id = _k").drop("_k")


def carve_val(rows: DataFrame, share: float, seed: int) -> DataFrame:
    """Adds `split`: the first round(n * share) ids in seeded order are val, the others train. Needs the ids only once, ranked in two steps."""
    keyed = rows.withColumns({"_o": seeded("image_id", seed)}).withColumn("_p", F.substring("_o", 1, 2))
    totals = keyed.groupBy("_p").count()  # 256 rows at most
    before = totals.select(F.col("_p").alias("_q"), (F.sum("count").over(W.orderBy("_p")) - F.col("count")).alias("_before"), F.sum("count").over(W.partitionBy()).alias("_n"))
    ranked = keyed.join(F.broadcast(before), F.col("_p") == F.col("_q")).withColumn("_k", F.col("_before") + F.row_number().over(W.partitionBy("_p").orderBy("_o", "image_id")))
    return ranked.withColumn("split", F.when(F.col("_k") <= F.bround(F.col("_n") * share), "val").otherwise("train")).select(*rows.columns, "split")


def carve_val_numpy(rows: DataFrame, share: float, seed: int) -> DataFrame:
    """The same by numpy's generator over the sorted ids, for splits that must equal earlier ones. The ids of one set are one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(pdf.image_id.to_numpy())
        order = np.random.default_rng(seed).permutation(len(ids))
        n = round(len(ids) * share)
        return pd.DataFrame({"image_id": ids[order], "split": ["val"] * n + ["train"] * (len(ids) - n)})

    return rows.select("image_id", F.lit(0).alias("_all")).groupBy("_all").applyInPandas(run, "image_id bigint, split string")


def exemplars(boxes: DataFrame, count: int, seed: int) -> DataFrame:
    """`count` boxes of each image (all, if it has fewer): native ones first, then in seeded order; fewer are a prefix of more."""
    if count < 1:
        raise ValueError("count must be 1 or more")
    key = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("image_id").cast("string"), F.col("gid").cast("string")))
    order = W.partitionBy("image_id").orderBy(F.col("native").desc(), key, "gid")
    return boxes.withColumn("position", F.row_number().over(order) - 1).where(F.col("position") < count)


def size_representative(boxes: DataFrame, count: int) -> DataFrame:
    """The boxes nearest the image's median area, ties by id."""
    area = F.col("w").cast("bigint") * F.col("h")
    off = F.abs(area - F.median(area).over(W.partitionBy("image_id")))
    return boxes.withColumn("_off", off).withColumn("position", F.row_number().over(W.partitionBy("image_id").orderBy("_off", "gid")) - 1).where(F.col("position") < count).drop("_off")


def ordered_union(parts: list[DataFrame], key: str) -> DataFrame:
    """The union with each key once, at its first place."""
    everything = None
    for i, part in enumerate(parts):
        own = part.select(key).withColumn("part", F.lit(i))
        everything = own if everything is None else everything.unionByName(own)
    return everything.groupBy(key).agg(F.min("part").alias("part"))


STRATEGIES = ("native", "seeded-carve", "test-only")


def by_strategy(rows: DataFrame, strategies: dict[str, str], share: float, seed: int) -> DataFrame:
    """(dataset, image_id, split) by each dataset's strategy: its own splits; val carved from its training ids in seeded order; or test alone.

    A dataset without a strategy is carved. Test ids don't depend on the seed. The carve ranks within (dataset, prefix of the hash).
    """
    unknown = set(strategies.values()) - set(STRATEGIES)
    if unknown:
        raise ValueError(f"unknown strategies: {', '.join(sorted(unknown))}")
    strategy = F.lit("seeded-carve")
    for name, s in strategies.items():
        strategy = F.when(F.col("dataset") == name, s).otherwise(strategy)
    kept = rows.select("dataset", "image_id", "split", strategy.alias("_s")).distinct()
    own = kept.where((F.col("split") == "test") | (F.col("_s") == "native")).select("dataset", "image_id", "split")
    keyed = kept.where("_s = 'seeded-carve' AND split = 'train'").withColumn("_o", seeded("image_id", seed)).withColumn("_p", F.substring("_o", 1, 2))
    totals = keyed.groupBy("dataset", "_p").count()
    whole = W.partitionBy("dataset")
    before = totals.select("dataset", "_p", (F.sum("count").over(whole.orderBy("_p")) - F.col("count")).alias("_before"), F.sum("count").over(whole).alias("_n"))
    place = F.col("_before") + F.row_number().over(W.partitionBy("dataset", "_p").orderBy("_o", "image_id"))
    carved = keyed.join(before, ["dataset", "_p"]).select("dataset", "image_id", F.when(place <= F.bround(F.col("_n") * share), "val").otherwise("train").alias("split"))
    return own.unionByName(carved)


def split_manifest(rows: DataFrame) -> DataFrame:
    """One row for each split: its ids, sorted."""
    return rows.groupBy("split").agg(F.sort_array(F.collect_set("image_id")).alias("ids"))
