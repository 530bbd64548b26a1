"""What training needs from tables: contrastive diagnostics and loss, schedules, batches, targets, assignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import batches as many
from lodestone.functions.geometry import giou
from lodestone.functions.vectors import cosine, dot, unit


def pair_cosines(rows: DataFrame, batch: str) -> DataFrame:
    """Cosines of the pairs i < j of each batch. A batch is what fits a training step."""
    a = rows.select(batch, F.col("id").alias("i"), F.col("label").alias("li"), F.col("v").alias("vi"))
    b = rows.select(batch, F.col("id").alias("j"), F.col("label").alias("lj"), F.col("v").alias("vj"))
    return a.join(b, batch).where("i < j").select(batch, "i", "j", (F.col("li") == F.col("lj")).alias("same"), cosine(F.col("vi"), F.col("vj")).alias("c"))


def cosine_gap(rows: DataFrame, batch: str) -> DataFrame:
    """Mean cosine within and between labels; null where there is no such pair."""
    within, between = F.avg(F.when(F.col("same"), F.col("c"))), F.avg(F.when(~F.col("same"), F.col("c")))
    return pair_cosines(rows, batch).groupBy(batch).agg(within.alias("same"), between.alias("different"), (within - between).alias("gap"))


def background_mean(anchors: DataFrame, background: DataFrame, batch: str) -> DataFrame:
    """Mean cosine of each batch's anchors with its background rows, null where either is empty.

    The mean of all products is the product of the means, so that no pairs are made.
    """
    mean = lambda df, name: df.select(batch, F.posexplode(unit(F.col("v"))).alias("i", "x")).groupBy(batch, "i").agg(F.avg("x").alias(name))
    both = mean(anchors, "_a").join(mean(background, "_b"), [batch, "i"]).groupBy(batch).agg(F.sum(F.col("_a") * F.col("_b")).alias("background"))
    return anchors.select(batch).union(background.select(batch)).distinct().join(both, batch, "left")


def agreement(crops: DataFrame, scenes: DataFrame) -> DataFrame:
    """Mean, least and largest cosine of aligned rows (id, v)."""
    j = crops.join(scenes.select("id", F.col("v").alias("w")), "id").select(cosine(F.col("v"), F.col("w")).alias("c"))
    return j.agg(F.avg("c").alias("mean"), F.min("c").alias("least"), F.max("c").alias("largest"), F.count("*").alias("n"))


def supcon_loss(rows: DataFrame, batch: str, temperature: float = 0.1) -> DataFrame:
    """Supervised contrastive loss of each batch: the mean over anchors that have a positive; 0 where none has."""
    u = rows.select(batch, "id", "label", unit(F.col("v")).alias("v"))
    a = u.select(batch, F.col("id").alias("i"), F.col("label").alias("li"), F.col("v").alias("vi"))
    b = u.select(batch, F.col("id").alias("j"), F.col("label").alias("lj"), F.col("v").alias("vj"))
    pairs = a.join(b, batch).where("i <> j").select(batch, "i", (F.col("li") == F.col("lj")).alias("same"), (dot(F.col("vi"), F.col("vj")) / temperature).alias("s"))
    top = pairs.withColumn("top", F.max("s").over(W.partitionBy(batch, "i")))
    each = top.groupBy(batch, "i").agg((F.first("top") + F.log(F.sum(F.exp(F.col("s") - F.col("top"))))).alias("lse"), F.avg(F.when(F.col("same"), F.col("s"))).alias("p"))
    return each.groupBy(batch).agg(F.coalesce(F.avg(F.col("lse") - F.col("p")), F.lit(0.0)).alias("loss"))


def learning_rates(spark: SparkSession, steps: int, warmup: int, peak: float, least: float = 0.0) -> DataFrame:
    """Linear rise, then a half cosine down."""
    t = F.col("id")
    falling = least + (peak - least) * 0.5 * (1 + F.cos(F.pi() * (t - warmup) / max(1, steps - warmup)))
    return spark.range(steps).select(t.alias("step"), F.when(t < warmup, peak * (t + 1) / max(1, warmup)).otherwise(falling).alias("rate"))


def batches(rows: DataFrame, size: int, order: Column, group: list[str]) -> DataFrame:
    """Rows of each group in a fixed order, in batches of `size`; the last may be short."""
    return rows.withColumn("batch", F.floor((F.row_number().over(W.partitionBy(*group).orderBy(order)) - 1) / size))


def background_cells(spark: SparkSession, boxes: DataFrame, grid: int, side: float) -> DataFrame:
    """(image_id, cell) of the grid cells whose centre is in no box, edges counting as inside."""
    step = side / grid
    cells = spark.range(grid * grid).select(F.col("id").alias("cell"), ((F.col("id") % grid + 0.5) * step).alias("px"), ((F.floor(F.col("id") / grid) + 0.5) * step).alias("py"))
    images = boxes.select("image_id").distinct().join(F.broadcast(cells))
    b = boxes.select(F.col("image_id").alias("bi"), "x", "y", "w", "h")
    inside = (F.col("image_id") == F.col("bi")) & F.col("px").between(F.col("x"), F.col("x") + F.col("w")) & F.col("py").between(F.col("y"), F.col("y") + F.col("h"))
    return images.join(b, inside, "left_anti").select("image_id", "cell")


def sampled_cells(cells: DataFrame, count: int, seed: int) -> DataFrame:
    """Up to `count` of each image's background cells in a seeded order; fewer are a prefix of more."""
    key = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("image_id").cast("string"), F.col("cell").cast("string")))
    return cells.withColumn("_k", F.row_number().over(W.partitionBy("image_id").orderBy(key, "cell"))).where(F.col("_k") <= count).drop("_k")


def focal_loss(logit: Column, target: Column, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    p = 1 / (1 + F.exp(-logit))
    right = F.when(target == 1, p).otherwise(1 - p)
    return -F.when(target == 1, alpha).otherwise(1 - alpha) * F.pow(1 - right, F.lit(gamma)) * F.log(F.greatest(right, F.lit(1e-12)))


def coco_targets(annotations: DataFrame, images: DataFrame, categories: DataFrame) -> DataFrame:
    """Annotations as shares of the image's longer side, with the reason why some are dropped."""
    j = annotations.join(categories, "category_id", "left").join(images, "image_id", "left")
    side = F.greatest("width", "height")
    reason = (
        F.when(F.col("name").isNull(), "unknown_category")
        .when(F.col("width").isNull(), "unknown_image")
        .when((F.col("w") <= 0) | (F.col("h") <= 0), "degenerate")
        .when((F.col("x") + F.col("w") > F.col("width")) | (F.col("y") + F.col("h") > F.col("height")) | (F.col("x") < 0) | (F.col("y") < 0), "out_of_range")
    )
    return j.select("ann_id", "image_id", "name", ((F.col("x") + F.col("w") / 2) / side).alias("cx"), ((F.col("y") + F.col("h") / 2) / side).alias("cy"), (F.col("w") / side).alias("w"), (F.col("h") / side).alias("h"), reason.alias("reason"))


def assignments(cost: np.ndarray) -> np.ndarray:
    """The columns of each row in cheapest one-to-one assignments of many tables of one shape (rows no more than columns), by shortest augmenting paths."""
    tables, n, m = cost.shape
    u, v, row_of = np.zeros((tables, n + 1)), np.zeros((tables, m + 1)), np.zeros((tables, m + 1), int)
    for i in range(1, n + 1):
        row_of[:, 0], j0, left = i, np.zeros(tables, int), np.arange(tables)
        least, way, used = np.full((tables, m + 1), np.inf), np.zeros((tables, m + 1), int), np.zeros((tables, m + 1), bool)
        while len(left):
            at = j0[left]
            used[left, at] = True
            row = row_of[left, at]
            taken = used[left]
            gap = cost[left, row - 1] - u[left, row][:, None] - v[left, 1:]
            best, through = least[left], way[left]
            better = ~taken[:, 1:] & (gap < best[:, 1:])
            best[:, 1:][better] = gap[better]
            through[:, 1:] = np.where(better, at[:, None], through[:, 1:])
            j1 = np.where(taken[:, 1:], np.inf, best[:, 1:]).argmin(1) + 1
            delta = best[np.arange(len(left)), j1][:, None]
            u[left[:, None], np.where(taken, row_of[left], 0)] += delta  # a used column's row is its own; place 0 is not read
            v[left] -= np.where(taken, delta, 0)
            least[left], way[left], j0[left] = np.where(taken, best, best - delta), through, j1
            left = left[row_of[left, j1] > 0]
        while len(left := np.flatnonzero(j0)):
            before = way[left, j0[left]]
            row_of[left, j0[left]] = row_of[left, before]
            j0[left] = before
    out = np.zeros((tables, n), int)
    table, column = np.nonzero(row_of[:, 1:])
    out[table, row_of[table, column + 1] - 1] = column
    return out


def assignment(cost: np.ndarray) -> np.ndarray:
    """The same for one table."""
    return assignments(cost[None])[0]


def cheapest(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of cheapest one-to-one assignments of the shorter side, for each of many tables of one shape. A pair without a cost is taken only where no other is left."""
    known = np.isfinite(cost)
    if not known.all():
        cost = np.where(known, cost, 1 + 4 * min(cost.shape[1:]) * np.abs(cost[known]).max(initial=1.0))
    if cost.shape[1] <= cost.shape[2]:
        return np.broadcast_to(np.arange(cost.shape[1]), cost.shape[:2]), assignments(cost)
    return assignments(cost.transpose(0, 2, 1)), np.broadcast_to(np.arange(cost.shape[2]), (len(cost), cost.shape[2]))


def detection_costs(preds: DataFrame, truths: DataFrame, by_class: float = 1.0, by_corner: float = 5.0, by_giou: float = 2.0) -> DataFrame:
    """(image_id, gid, pid, cost) of all pairs of an image: boxes (cx, cy, w, h) by summed distance, the truth's class by -sigmoid of its logit, overlap by -GIoU.

    preds hold `logits`, an array with one for each class; truths hold `label`, its index.
    """
    sides = ("cx", "cy", "w", "h")
    p = preds.select("image_id", "pid", "logits", F.struct(*sides).alias("p"))
    g = truths.select("image_id", "gid", "label", F.struct(*sides).alias("g"))
    edges = lambda b: F.struct((b["cx"] - b["w"] / 2).alias("x"), (b["cy"] - b["h"] / 2).alias("y"), b["w"].alias("w"), b["h"].alias("h"))
    a, b = F.col("p"), F.col("g")
    far = sum((F.abs(a[s] - b[s]) for s in sides[1:]), F.abs(a["cx"] - b["cx"]))
    likely = 1 / (1 + F.exp(-F.get("logits", F.col("label")).cast("double")))
    return p.join(g, "image_id").select("image_id", "gid", "pid", (by_corner * far - by_class * likely - by_giou * giou(edges(a), edges(b))).alias("cost"))


PAIRS = "image_id bigint, gid bigint, pid bigint, cost double"


def pair_table(image: np.ndarray, gid: np.ndarray, pid: np.ndarray, cost: np.ndarray) -> pa.Table:
    return pa.table({"image_id": pa.array(image, pa.int64()), "gid": pa.array(gid, pa.int64()), "pid": pa.array(pid, pa.int64()), "cost": pa.array(cost, from_pandas=True)})


def cheapest_pairs(costs: DataFrame) -> DataFrame:
    """The pairs of each image's cheapest assignment from all its costs (image_id, gid, pid, cost)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in many.tables(parts):
            starts, sizes, flat = many.lists(table, "cells")
            gid, pid, cost = (flat.field(k) for k in ("gid", "pid", "cost"))
            gid, pid, cost = gid.to_numpy(zero_copy_only=False), pid.to_numpy(zero_copy_only=False), many.numbers(cost)
            first = np.r_[True, (gid[1:] != gid[:-1])]
            first[starts] = True
            rows = np.add.reduceat(first, starts, dtype=int)
            cols = sizes // rows
            if (rows * cols != sizes).any():
                raise ValueError("an image lacks the cost of a pair, or has it twice")
            image = table["image_id"].to_numpy()
            for (n, m), at in many.alike(rows, cols):
                own = starts[at, None] + np.arange(n * m)
                r, c = cheapest(cost[own].reshape(-1, n, m))
                cell = np.take_along_axis(own, r * m + c, 1).ravel()
                yield from pair_table(np.repeat(image[at], r.shape[1]), gid[cell], pid[cell], cost[cell]).to_batches()

    cells = costs.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("gid", "pid", F.col("cost").cast("double").alias("cost")))).alias("cells"))
    return cells.mapInArrow(run, PAIRS)


def optimal_match(preds: DataFrame, truths: DataFrame) -> DataFrame:
    """Each truth's prediction in the cheapest assignment of its image, by summed corner distance."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in many.tables(parts):
            image, sides = table["image_id"].to_numpy(), []
            for name in ("truths", "preds"):
                starts, sizes, flat = many.lists(table, name)
                sides.append((starts, sizes, flat.field("id").to_numpy(zero_copy_only=False), np.stack([many.numbers(flat.field(k)) for k in ("x", "y", "w", "h")], 1)))
            (g_start, g_size, gid, g_box), (p_start, p_size, pid, p_box) = sides
            for (n, m), at in many.alike(g_size, p_size, of=lambda n, m: 4 * n * m):
                g, p = g_start[at, None] + np.arange(n), p_start[at, None] + np.arange(m)
                cost = np.abs(g_box[g][:, :, None] - p_box[p][:, None]).sum(3)
                r, c = cheapest(cost)
                k = np.arange(len(at))[:, None]
                yield from pair_table(np.repeat(image[at], r.shape[1]), gid[g[k, r]].ravel(), pid[p[k, c]].ravel(), cost[k, r, c].ravel()).to_batches()

    in_turn = lambda df, key, name: df.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct(F.col(key).alias("id"), "x", "y", "w", "h"))).alias(name))
    return in_turn(preds, "pid", "preds").join(in_turn(truths, "gid", "truths"), "image_id").mapInArrow(run, PAIRS)
