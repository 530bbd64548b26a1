"""Proposals from a detector's anchors, and what is picked from them: the subject, its other parts, places without contact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import folds
from lodestone.functions.geometry import box, from_letterbox, intersection


def decoded(anchors: DataFrame, fit: Column, width: Column, height: Column, least: float = 0.4, threshold: float = 0.9, most: int | None = None) -> DataFrame:
    """Anchors (image_id, pid, cx, cy, w, h, score) as whole-pixel proposals of the image, strongest first.

    Scores above `least`, suppression on the letterboxed corners, the first `most`, then back through the letterbox `fit`, clipped;
    what has less than a pixel left is dropped.
    """
    corners = anchors.where(F.col("score") > least).select("image_id", "pid", (F.col("cx") - F.col("w") / 2).alias("x"), (F.col("cy") - F.col("h") / 2).alias("y"), "w", "h", "score")
    kept = folds.nms(corners, ["image_id"], threshold)
    if most is not None:
        order = W.partitionBy("image_id").orderBy(F.col("score").desc(), "y", "x", "pid")
        kept = kept.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= most).drop("_k")
    a, b = from_letterbox(F.col("x"), F.col("y"), fit), from_letterbox(F.col("x") + F.col("w"), F.col("y") + F.col("h"), fit)
    within = lambda e, side: F.least(F.greatest(F.bround(e), F.lit(0.0)), side.cast("double")).cast("int")
    ends = kept.select("image_id", "pid", "score", within(a["x"], width).alias("x"), within(a["y"], height).alias("y"), within(b["x"], width).alias("_x2"), within(b["y"], height).alias("_y2"))
    return ends.select("image_id", "pid", "x", "y", (F.col("_x2") - F.col("x")).alias("w"), (F.col("_y2") - F.col("y")).alias("h"), "score").where("w >= 1 AND h >= 1")


def spans_frame(b: Column, width: float, height: float, margin: float = 0.02) -> Column:
    """Whether a box reaches two opposite edges of the image."""
    mx, my = width * margin, height * margin
    return ((b["x"] <= mx) & (b["x"] + b["w"] >= width - mx)) | ((b["y"] <= my) & (b["y"] + b["h"] >= height - my))


def subjects(proposals: DataFrame, width: float, height: float) -> DataFrame:
    """Each image's likeliest subject: the largest area x centrality x score cubed among proposals that don't span the frame (among all, if all do); ties by pid."""
    b = box()
    off = F.hypot(F.col("x") + F.col("w") / 2 - width / 2, F.col("y") + F.col("h") / 2 - height / 2)
    weight = F.col("w").cast("double") * F.col("h") * (1 - off / float(width**2 + height**2) ** 0.5) * F.pow("score", F.lit(3.0))
    best = F.struct(~spans_frame(b, width, height), F.round(weight, 9), -F.col("pid"))
    return proposals.groupBy("image_id").agg(F.max_by(F.struct("pid", "x", "y", "w", "h", "score"), best).alias("s")).select("image_id", "s.*")


def merge_partners(chosen: DataFrame, proposals: DataFrame, width: float, height: float, least: float = 0.5, larger: float = 2.0, overlap: float = 0.15, gap: float = 0.03) -> DataFrame:
    """(image_id, pid) of the proposals that are further parts of the image's subject: confident, not much larger, next to it and hardly over it."""
    s = chosen.select("image_id", F.col("pid").alias("_subject"), box().alias("_s"))
    b, t = box(), F.col("_s")
    area = lambda r: r["w"].cast("double") * r["h"]
    apart = lambda c, side: F.greatest(b[c] - (t[c] + t[side]), t[c] - (b[c] + b[side]), F.lit(0))
    fits = (
        (F.col("pid") != F.col("_subject"))
        & (F.col("score") >= least)
        & ~spans_frame(b, width, height)
        & (area(b) <= area(t) * larger)
        & (intersection(b, t) <= overlap * F.least(area(b), area(t)))
        & (F.hypot(apart("x", "w"), apart("y", "h")) <= gap * float(width**2 + height**2) ** 0.5)
    )
    return proposals.join(s, "image_id").where(fits).select("image_id", "pid")


def placed(boxes: DataFrame, gap: int, key: str = "pid") -> DataFrame:
    """The boxes of each image, taken in order of their key, that stay `gap` pixels clear of all taken before."""
    near = lambda k, b: (b["x"] < k["x"] + k["w"] + gap) & (k["x"] < b["x"] + b["w"] + gap) & (b["y"] < k["y"] + k["h"] + gap) & (k["y"] < b["y"] + b["h"] + gap)
    in_turn = F.sort_array(F.collect_list(F.struct(F.col(key).alias("id"), "x", "y", "w", "h")))
    kept = boxes.groupBy("image_id").agg(folds.keep_greedily(in_turn, near).alias("kept"))
    return kept.select("image_id", F.explode("kept").alias("b")).select("image_id", F.col("b.id").alias(key), "b.x", "b.y", "b.w", "b.h")
