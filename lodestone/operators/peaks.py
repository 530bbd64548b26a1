"""Peaks of response maps (image_id, y, x, v) of many images under three strategies; maps are dense.

Windows run within an image's rows and columns, regions within an image, and suppression folds over an image's cells above the floor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import folds
from lodestone.operators import dense

IMAGE = "image_id"
STRATEGIES = ("nms", "local-max", "watershed")
FAR = 1 << 40  # a squared distance where there is no background


def footprint(side: int, share: float) -> int:
    """An odd window side of at least 3 for a template's side."""
    return max(3, round(side * share) | 1)


def windowed_max(cells: DataFrame, value: str, ry: int, rx: int) -> DataFrame:
    """Adds `top`, the largest value within ry rows and rx columns."""
    rows = cells.withColumn("_m", F.max(value).over(W.partitionBy(IMAGE, "y").orderBy("x").rangeBetween(-rx, rx)))
    return rows.withColumn("top", F.max("_m").over(W.partitionBy(IMAGE, "x").orderBy("y").rangeBetween(-ry, ry))).drop("_m")


def in_order(cells: DataFrame) -> DataFrame:
    """Adds `pid`, a cell's place in its image by falling value, row and column."""
    return cells.withColumn("pid", F.row_number().over(W.partitionBy(IMAGE).orderBy(F.col("v").desc(), "y", "x")))


def survivors(cells: DataFrame, kept: DataFrame) -> DataFrame:
    return cells.join(kept.select(IMAGE, "pid"), [IMAGE, "pid"], "left_semi").select(IMAGE, "y", "x", "v")


def by_suppression(cells: DataFrame, floor: float, w: int, h: int, threshold: float) -> DataFrame:
    """Template boxes about the cells above the floor, moved into the map, then suppression: touching instances merge."""
    ranked = in_order(cells.where(F.col("v") > floor))
    box = lambda c, side: F.greatest(F.col(c) - side // 2, F.lit(0)).alias(c)
    boxes = ranked.select(IMAGE, "pid", box("x", w), box("y", h), F.lit(w).alias("w"), F.lit(h).alias("h"), (-F.col("pid")).cast("double").alias("score"))
    return survivors(ranked, folds.nms(boxes, [IMAGE], threshold))


def by_local_maximum(cells: DataFrame, floor: float, fw: int, fh: int) -> DataFrame:
    """Cells that are the largest of their window, thinned by half the window's longer side, strongest first."""
    ranked = in_order(windowed_max(cells, "v", fh // 2, fw // 2).where((F.col("v") == F.col("top")) & (F.col("v") > floor)).drop("top"))
    points = ranked.select(IMAGE, "pid", "x", "y", F.lit(1).alias("w"), F.lit(1).alias("h"), (-F.col("pid")).cast("double").alias("score"))
    return survivors(ranked, folds.thin_by_radius(points, [IMAGE], max(fw, fh) // 2))


def background_distance(cells: DataFrame, floor: float) -> DataFrame:
    """Adds `d2`, the squared distance of each cell to the nearest one not above the floor of its image; FAR where there is none.

    First the nearest in each column by windows, then the least over each row's columns.
    """
    down = W.partitionBy(IMAGE, "x").orderBy("y")
    back = F.when(~(F.col("v") > floor), F.col("y"))
    above, below = F.last(back, True).over(down.rowsBetween(W.unboundedPreceding, 0)), F.first(back, True).over(down.rowsBetween(0, W.unboundedFollowing))
    columns = cells.withColumn("g", F.least(F.col("y") - above, below - F.col("y")).cast("bigint"))  # null if the column has none
    other = columns.where("g IS NOT NULL").select(IMAGE, "y", F.col("x").alias("_x"), "g")
    inside = columns.where(F.col("v") > floor).select(IMAGE, "y", "x")
    step = (F.col("x") - F.col("_x")).cast("bigint")
    near = inside.join(other, [IMAGE, "y"]).groupBy(IMAGE, "y", "x").agg(F.min(step * step + F.col("g") * F.col("g")).alias("_d"))
    return cells.join(near, [IMAGE, "y", "x"], "left").select(*cells.columns, F.when(F.col("v") > floor, F.coalesce("_d", F.lit(FAR))).otherwise(0).alias("d2"))


def by_watershed(cells: DataFrame, floor: float, fw: int, fh: int) -> DataFrame:
    """The best cell of each region of distance maxima: touching blobs part at their waist. Regions join by sides, not by corners."""
    tops = windowed_max(background_distance(cells, floor), "d2", fh // 2, fw // 2).where((F.col("v") > floor) & (F.col("d2") == F.col("top")))
    best = F.max_by(F.struct("y", "x", "v"), F.struct(F.col("v"), -F.col("y"), -F.col("x"))).alias("b")
    return dense.regions(tops.select(IMAGE, "y", "x", "v"), [IMAGE], corners=False).groupBy(IMAGE, "label").agg(best).select(IMAGE, "b.*")


def extract(cells: DataFrame, strategy: str, w: int, h: int, floor: float, most: int = 50, share: float = 0.5, threshold: float = 0.3) -> DataFrame:
    """The first `most` peaks of each image by falling value, row and column. w and h are the template's sides on the map."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {', '.join(STRATEGIES)}, not {strategy!r}")
    fw, fh = footprint(w, share), footprint(h, share)
    if strategy == "nms":
        found = by_suppression(cells, floor, w, h, threshold)
    else:
        found = (by_local_maximum if strategy == "local-max" else by_watershed)(cells, floor, fw, fh)
    return in_order(found).where(F.col("pid") <= most).drop("pid")


def content_tokens(images: DataFrame, side: int, patch: int = 14) -> DataFrame:
    """(image_id, gy, gx, content) for the patches of images (image_id, width, height) fitted into the top left of a square: whether a patch's centre is in the image."""
    if side % patch:
        raise ValueError(f"side must be a multiple of {patch}")
    scale = side / F.greatest("width", "height")
    extent = lambda c: F.least(F.lit(side), F.greatest(F.lit(1), F.bround(F.col(c) * scale).cast("int")))
    grid = F.explode(F.sequence(F.lit(0), F.lit((side // patch) ** 2 - 1))).alias("_k")
    cells = images.select(IMAGE, extent("width").alias("_w"), extent("height").alias("_h"), grid).select(IMAGE, "_w", "_h", F.floor(F.col("_k") / (side // patch)).alias("gy"), (F.col("_k") % (side // patch)).alias("gx"))
    centre: Column = lambda c: F.col(c) * patch + patch // 2
    return cells.select(IMAGE, "gy", "gx", ((centre("gx") < F.col("_w")) & (centre("gy") < F.col("_h"))).alias("content"))
