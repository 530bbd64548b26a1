"""Ordered folds inside a row: greedy suppression and greedy matching without leaving the JVM.

They are quadratic in the boxes of one group, which is fit for the detections of an image. Every order is total.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.geometry import iou


def ordered(key: str = "pid") -> Column:
    """The group's boxes by falling score, then y, x and key; the sides come last, as they must not order boxes of one corner."""
    return F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "y", "x", F.col(key).alias("id"), "w", "h")))


def keep_greedily(boxes: Column, clash: Callable[[Column, Column], Column]) -> Column:
    """Each box in turn stays unless it clashes with one that stays."""
    return F.aggregate(boxes, F.slice(boxes, 1, 0), lambda kept, b: F.when(F.exists(kept, lambda k: clash(k, b)), kept).otherwise(F.concat(kept, F.array(b))))


def nms(df: DataFrame, group: list[str], threshold: float, key: str = "pid") -> DataFrame:
    """Rows of df that survive suppression at an IoU strictly above the threshold, by (-score, y, x, key)."""
    kept = df.groupBy(*group).agg(keep_greedily(ordered(key), lambda k, b: iou(k, b) > threshold).alias("kept"))
    return exploded(kept, group, key)


def thin_by_radius(df: DataFrame, group: list[str], radius: float, key: str = "pid") -> DataFrame:
    """Points that are at least the radius from every stronger one that stays."""
    near = lambda k, b: (k["x"] - b["x"]) * (k["x"] - b["x"]) + (k["y"] - b["y"]) * (k["y"] - b["y"]) < radius * radius
    return exploded(df.groupBy(*group).agg(keep_greedily(ordered(key), near).alias("kept")), group, key)


def exploded(kept: DataFrame, group: list[str], key: str) -> DataFrame:
    return kept.select(*group, F.explode("kept").alias("b")).select(*group, F.col("b.id").alias(key), F.col("b.x").alias("x"), F.col("b.y").alias("y"), F.col("b.w").alias("w"), F.col("b.h").alias("h"), (-F.col("b.s")).alias("score"))


def match_flags(preds: Column, truths: Column, threshold: float | Column) -> Column:
    """Per prediction in order: the truth it takes (-1 for none): the free one of largest IoU at or above the threshold, the first of equals."""

    def step(acc: Column, p: Column) -> Column:
        free = F.filter(truths, lambda g: ~F.array_contains(acc["taken"], g["id"]) & (iou(p, g) >= threshold))
        best = F.aggregate(
            free,
            F.struct(F.lit(-1.0).alias("o"), F.lit(-1).cast("bigint").alias("id")),
            lambda a, g: F.when(iou(p, g) > a["o"], F.struct(iou(p, g).alias("o"), g["id"].cast("bigint").alias("id"))).otherwise(a),
        )
        return F.struct(F.concat(acc["taken"], F.array(best["id"])).alias("taken"))

    return F.aggregate(preds, F.struct(F.array().cast("array<bigint>").alias("taken")), step, lambda acc: acc["taken"])


def per_image(preds: DataFrame, truths: DataFrame, image: str = "image_id") -> DataFrame:
    """A row for each image of either side: its predictions in order and its truths by id."""
    p = preds.groupBy(image).agg(ordered("pid").alias("preds"))
    g = truths.groupBy(image).agg(F.sort_array(F.collect_list(F.struct(F.col("gid").alias("id"), "x", "y", "w", "h"))).alias("truths"))
    none_p = F.array().cast("array<struct<s:double,y:int,x:int,id:bigint,w:int,h:int>>")
    none_g = F.array().cast("array<struct<id:bigint,x:int,y:int,w:int,h:int>>")
    return p.join(g, image, "full").select(image, F.coalesce(F.col("preds").cast("array<struct<s:double,y:int,x:int,id:bigint,w:int,h:int>>"), none_p).alias("preds"), F.coalesce(F.col("truths").cast("array<struct<id:bigint,x:int,y:int,w:int,h:int>>"), none_g).alias("truths"))


def matched(preds: DataFrame, truths: DataFrame, threshold: float, image: str = "image_id") -> DataFrame:
    """Per image the predictions and the truths they took."""
    return per_image(preds, truths, image).withColumn("taken", match_flags(F.col("preds"), F.col("truths"), threshold))
