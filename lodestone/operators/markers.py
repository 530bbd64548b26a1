"""Markers that point at targets: their geometry, and which proposal each one means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.geometry import affine


def proposal_score(distance: Column, cosine: Column, objectness: Column, ratio: Column, length: float, weights: tuple = (1.0, 0.5, 0.5, 0.3)) -> Column:
    """Nearness, direction, objectness and size in the marker's own weights."""
    near, way, obj, size = weights
    return near * F.exp(-distance / length) + way * F.greatest(F.lit(0.0), cosine) + obj * objectness + size * F.least(ratio, 1 / ratio)


def best_proposals(markers: DataFrame, proposals: DataFrame, length: float) -> DataFrame:
    """For each marker (image_id, marker_id, tx, ty, ux, uy, size) its best proposal (image_id, pid, x, y, w, h, objectness)."""
    j = markers.join(proposals, "image_id")
    dx, dy = F.col("x") + F.col("w") / 2.0 - F.col("tx"), F.col("y") + F.col("h") / 2.0 - F.col("ty")
    d = F.sqrt(dx * dx + dy * dy)
    cos = F.when(d > 0, (dx * F.col("ux") + dy * F.col("uy")) / d).otherwise(0.0)
    ratio = F.sqrt(F.col("w").cast("double") * F.col("h")) / F.col("size")
    s = j.withColumn("score", F.round(proposal_score(d, cos, F.col("objectness"), ratio, length), 9))
    return s.withColumn("_k", F.row_number().over(W.partitionBy("image_id", "marker_id").orderBy(F.col("score").desc(), "pid"))).where("_k = 1").select("image_id", "marker_id", "pid", "score")


def principal_axis(points: DataFrame, group: list[str], least: float = 0.12) -> DataFrame:
    """Centroid, axis, asymmetry and tip of a group's points (x, y).

    The axis is the larger eigenvector of the 2 x 2 covariance, in closed form; it points to the heavier tail, and the
    marker is ambiguous below `least` of asymmetry. The tip is the farthest point along it.
    """
    m = points.groupBy(*group).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("vxy"))
    angle = F.atan2(2 * F.col("vxy"), F.col("vx") - F.col("vy")) / 2
    m = m.withColumns({"ux": F.cos(angle), "uy": F.sin(angle)})
    p = points.join(m, group).withColumn("t", F.round((F.col("x") - F.col("cx")) * F.col("ux") + (F.col("y") - F.col("cy")) * F.col("uy"), 9))
    s = p.groupBy(*group, "cx", "cy", "ux", "uy").agg(F.max("t").alias("far"), F.min("t").alias("near"), F.max_by(F.struct("x", "y"), F.struct("t", "x", "y")).alias("high"), F.min_by(F.struct("x", "y"), F.struct("t", "x", "y")).alias("low"))
    asymmetry = F.abs(F.col("far") + F.col("near")) / F.greatest(F.col("far") - F.col("near"), F.lit(1e-9))
    tip = F.when(F.col("far") >= -F.col("near"), F.col("high")).otherwise(F.col("low"))
    return s.select(*group, "cx", "cy", asymmetry.alias("asymmetry"), (asymmetry >= least).alias("directed"), tip["x"].alias("tip_x"), tip["y"].alias("tip_y"))


def from_transform(m: Column, tip_x: Column | None = None, tip_y: Column | None = None) -> Column:
    """The mapped tip, or without one the direction that the transform gives to the x axis."""
    if tip_x is not None and tip_y is not None:
        return affine(m, tip_x, tip_y)
    angle = F.atan2(m[3], m[0])
    return F.struct(F.cos(angle).alias("x"), F.sin(angle).alias("y"))


def otsu(cells: DataFrame, group: list[str], value: str = "v", bins: int = 256) -> DataFrame:
    """The bin after which the variance between both sides is largest; the first of equals. value: integers from 0 to bins - 1."""
    hist = cells.groupBy(*group, F.col(value).cast("bigint").alias("b")).agg(F.count("*").alias("n"))
    upto, whole = W.partitionBy(*group).orderBy("b").rowsBetween(W.unboundedPreceding, 0), W.partitionBy(*group)
    h = hist.withColumns({"w0": F.sum("n").over(upto), "s0": F.sum(F.col("n") * F.col("b")).over(upto), "w": F.sum("n").over(whole), "s": F.sum(F.col("n") * F.col("b")).over(whole)})
    gap = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / (F.col("w") - F.col("w0"))
    between = F.round(F.col("w0") * (F.col("w") - F.col("w0")) * gap * gap / F.col("w") / F.col("w"), 9)
    return h.where("w0 < w").groupBy(*group).agg(F.max_by("b", F.struct(between, -F.col("b"))).alias("threshold"))
