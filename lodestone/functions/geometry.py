"""Box, point and bucket expressions. Boxes are half-open [x, x + w) x [y, y + h); touching boxes do not overlap."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = ("x", "y", "w", "h")


def box(prefix: str = "", **parts: Column) -> Column:
    """A struct of x, y, w, h from columns of these names, or from given expressions."""
    return F.struct(*[(parts.get(f) if f in parts else F.col(prefix + f)).alias(f) for f in FIELDS])


def derived(b: Column) -> dict[str, Column]:
    return {"x2": b["x"] + b["w"], "y2": b["y"] + b["h"], "cx": b["x"] + b["w"] / 2.0, "cy": b["y"] + b["h"] / 2.0, "area": b["w"].cast("bigint") * b["h"]}


def intersection(a: Column, b: Column) -> Column:
    iw = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    ih = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return F.when((iw > 0) & (ih > 0), iw.cast("double") * ih).otherwise(0.0)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 without overlap."""
    both = intersection(a, b)
    union = a["w"].cast("double") * a["h"] + b["w"].cast("double") * b["h"] - both
    return F.when(both > 0, both / union).otherwise(0.0)


def giou(a: Column, b: Column) -> Column:
    """IoU less the share of the common hull that neither covers."""
    both = intersection(a, b)
    union = a["w"].cast("double") * a["h"] + b["w"].cast("double") * b["h"] - both
    hull = (F.greatest(a["x"] + a["w"], b["x"] + b["w"]) - F.least(a["x"], b["x"])).cast("double") * (F.greatest(a["y"] + a["h"], b["y"] + b["h"]) - F.least(a["y"], b["y"]))
    return both / union - (hull - union) / hull


def clip(b: Column, width: Column, height: Column) -> Column:
    """The part inside the image; null where nothing is."""
    x, y = F.greatest(b["x"], F.lit(0)), F.greatest(b["y"], F.lit(0))
    w, h = F.least(b["x"] + b["w"], width) - x, F.least(b["y"] + b["h"], height) - y
    return F.when((w >= 1) & (h >= 1), F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h")))


def expand(b: Column, share: float, width: Column, height: Column) -> Column:
    """Grown by a share of its sides, rounded half to even, and kept in the image."""
    mx, my = F.bround(b["w"] * share).cast("int"), F.bround(b["h"] * share).cast("int")
    x, y = F.greatest(b["x"] - mx, F.lit(0)), F.greatest(b["y"] - my, F.lit(0))
    return F.struct(x.alias("x"), y.alias("y"), (F.least(b["x"] + b["w"] + mx, width) - x).alias("w"), (F.least(b["y"] + b["h"] + my, height) - y).alias("h"))


def tile_starts(side: Column, tile: int, overlap: float) -> Column:
    """Starts of tiles along a side; the last one is flush with its end."""
    step = max(1, int(tile * (1 - overlap)))
    last = F.greatest(side - tile, F.lit(0))
    return F.array_sort(F.array_union(F.sequence(F.lit(0), last, F.lit(step)), F.array(last)))


def tiles(width: Column, height: Column, tile: int, overlap: float) -> Column:
    """All tiles as boxes."""
    xs, ys = tile_starts(width, tile, overlap), tile_starts(height, tile, overlap)
    return F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: F.struct(x.alias("x"), y.alias("y"), F.least(F.lit(tile), width).alias("w"), F.least(F.lit(tile), height).alias("h")))))


def centre_to_corners(cx: Column, cy: Column, w: Column, h: Column) -> Column:
    return F.struct((cx - w / 2).alias("x1"), (cy - h / 2).alias("y1"), (cx + w / 2).alias("x2"), (cy + h / 2).alias("y2"))


def pixels(cx: Column, cy: Column, w: Column, h: Column, side: Column, width: Column, height: Column) -> Column:
    """A box given as shares of `side` in whole pixels of the image; null where less than a pixel is left."""
    x1 = F.least(F.greatest(F.bround((cx - w / 2) * side), F.lit(0.0)), width.cast("double")).cast("int")
    y1 = F.least(F.greatest(F.bround((cy - h / 2) * side), F.lit(0.0)), height.cast("double")).cast("int")
    x2 = F.least(F.greatest(F.bround((cx + w / 2) * side), F.lit(0.0)), width.cast("double")).cast("int")
    y2 = F.least(F.greatest(F.bround((cy + h / 2) * side), F.lit(0.0)), height.cast("double")).cast("int")
    return F.when((x2 - x1 >= 1) & (y2 - y1 >= 1), F.struct(x1.alias("x"), y1.alias("y"), (x2 - x1).alias("w"), (y2 - y1).alias("h")))


def hull(points: Column) -> Column:
    """The box of an array of points [x, y]."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    x, y = F.array_min(xs), F.array_min(ys)
    return F.struct(x.alias("x"), y.alias("y"), (F.array_max(xs) - x).alias("w"), (F.array_max(ys) - y).alias("h"))


def letterbox(width: Column, height: Column, side: int) -> Column:
    """Scale and paddings that fit an image into a square."""
    scale = F.least(F.lit(float(side)) / width, F.lit(float(side)) / height)
    return F.struct(scale.alias("scale"), ((side - width * scale) / 2).alias("pad_x"), ((side - height * scale) / 2).alias("pad_y"))


def from_letterbox(x: Column, y: Column, fit: Column) -> Column:
    return F.struct(((x - fit["pad_x"]) / fit["scale"]).alias("x"), ((y - fit["pad_y"]) / fit["scale"]).alias("y"))


def affine(m: Column, x: Column, y: Column) -> Column:
    """A 2 x 3 matrix, given by rows as an array of six, applied to a point."""
    return F.struct((m[0] * x + m[1] * y + m[2]).alias("x"), (m[3] * x + m[4] * y + m[5]).alias("y"))


def angle_of(m: Column) -> Column:
    return F.atan2(m[3], m[0])


def affine_hull(m: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """The whole-pixel box, inside the image, of a w x h template under an affine map; null where empty."""
    corners = F.array(*[affine(m, cx, cy) for cx, cy in ((F.lit(0.0), F.lit(0.0)), (w, F.lit(0.0)), (F.lit(0.0), h), (w, h))])
    xs, ys = F.transform(corners, lambda p: p["x"]), F.transform(corners, lambda p: p["y"])
    x, y = F.greatest(F.floor(F.array_min(xs)), F.lit(0)).cast("int"), F.greatest(F.floor(F.array_min(ys)), F.lit(0)).cast("int")
    x2, y2 = F.least(F.ceil(F.array_max(xs)), width).cast("int"), F.least(F.ceil(F.array_max(ys)), height).cast("int")
    return F.when((x2 > x) & (y2 > y), F.struct(x.alias("x"), y.alias("y"), (x2 - x).alias("w"), (y2 - y).alias("h")))


def scale_bucket(low: Column, high: Column, ratio: float = 1.5) -> Column:
    return F.when((low > 0) & (high > 0) & (high / low > ratio), "varied").otherwise("fixed")


def size_bucket(area: Column, canvas: Column) -> Column:
    share = area / canvas
    return F.when(share < 0.004, "small").when(share < 0.016, "medium").otherwise("large")


def crowding_bucket(n: Column) -> Column:
    return F.when(n.isNull(), None).when(n <= 1, "1").when(n <= 5, "2-5").when(n <= 15, "6-15").otherwise("16+")


def canvas_sides(size: Column) -> tuple[Column, Column]:
    """Width and height of "WxH"; null where malformed."""
    parts = F.split(size, "x")
    two = F.size(parts) == 2
    return F.when(two, F.try_element_at(parts, F.lit(1)).try_cast("int")), F.when(two, F.try_element_at(parts, F.lit(2)).try_cast("int"))


def resolution_bucket(size: Column) -> Column:
    w, h = canvas_sides(size)
    side = F.when(w.isNotNull() & h.isNotNull(), F.greatest(w, h))
    return F.when(side.isNull(), None).when(side <= 800, "small").when(side <= 1600, "medium").otherwise("large")


def regime(image_id: Column) -> Column:
    """The test regime that an image id's beginning names."""
    return F.when(image_id.startswith("chipset"), "EASY").when(image_id.startswith("textured"), "TEXTURED").when(image_id.startswith("varied"), "VARIED").when(image_id.startswith("cluttered"), "CLUTTERED")
