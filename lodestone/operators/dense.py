"""Response maps in long form (y, x, v): windows, peaks, components; and the array kernels that make such maps."""

from __future__ import annotations

import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import folds


def sanitised(cells: DataFrame) -> DataFrame:
    """NaN and -inf become -inf, +inf the largest finite value."""
    inf = float("inf")
    finite = F.when(~F.isnan("v") & (F.abs("v") != inf), F.col("v"))
    top = cells.agg(F.max(finite).alias("_top"))
    return cells.join(F.broadcast(top)).withColumn("v", F.when(F.isnan("v") | (F.col("v") == -inf), -inf).when(F.col("v") == inf, F.col("_top")).otherwise(F.col("v"))).drop("_top")


def windowed_max(cells: DataFrame, ry: int, rx: int) -> DataFrame:
    """Adds `top`, the maximum over a window of radius rx, ry; first along rows, then along columns. Cells must be dense."""
    rows = cells.withColumn("_m", F.max("v").over(W.partitionBy("y").orderBy("x").rangeBetween(-rx, rx)))
    return rows.withColumn("top", F.max("_m").over(W.partitionBy("x").orderBy("y").rangeBetween(-ry, ry))).drop("_m")


def windowed_sums(cells: DataFrame, h: int, w: int) -> DataFrame:
    """Adds `sum` and `energy` over the h x w window that begins at the cell."""
    across, down = W.partitionBy("y").orderBy("x").rangeBetween(0, w - 1), W.partitionBy("x").orderBy("y").rangeBetween(0, h - 1)
    rows = cells.withColumns({"_s": F.sum("v").over(across), "_e": F.sum(F.col("v") * F.col("v")).over(across)})
    return rows.withColumns({"sum": F.sum("_s").over(down), "energy": F.sum("_e").over(down)}).drop("_s", "_e")


def robust_z(cells: DataFrame, group: list[str]) -> DataFrame:
    """(v - median) / (1.4826 * MAD + 1e-9) within a group."""
    m = cells.groupBy(*group).agg(F.median("v").alias("_m"))
    off = cells.join(m, group)
    d = off.groupBy(*group).agg(F.median(F.abs(F.col("v") - F.col("_m"))).alias("_d"))
    return off.join(d, group).withColumn("z", (F.col("v") - F.col("_m")) / (1.4826 * F.col("_d") + 1e-9)).drop("_m", "_d")


def local_peaks(cells: DataFrame, floor: float, ry: int, rx: int, apart: float) -> DataFrame:
    """Cells that are the maximum of their window and above the floor, then thinned by distance, strongest first."""
    top = windowed_max(cells, ry, rx).where((F.col("v") == F.col("top")) & (F.col("v") > floor))
    points = top.select(F.lit(0).alias("image_id"), (F.col("y") * 100_000 + F.col("x")).alias("pid"), "x", "y", F.lit(1).alias("w"), F.lit(1).alias("h"), F.col("v").alias("score"))
    return folds.thin_by_radius(points, ["image_id"], apart).select("y", "x", F.col("score").alias("v"))


def box_peaks(cells: DataFrame, floor: float, w: int, h: int, threshold: float) -> DataFrame:
    """Every cell above the floor as a template's box, then suppression."""
    boxes = cells.where(F.col("v") > floor).select(F.lit(0).alias("image_id"), (F.col("y") * 100_000 + F.col("x")).alias("pid"), "x", "y", F.lit(w).alias("w"), F.lit(h).alias("h"), F.col("v").alias("score"))
    return folds.nms(boxes, ["image_id"], threshold).select("y", "x", F.col("score").alias("v"))


def peak_to_sidelobe(cells: DataFrame, exclude: int = 5) -> DataFrame:
    """(peak - mean) / deviation of the cells outside a square about the peak."""
    peak = cells.orderBy(F.col("v").desc(), "y", "x").limit(1).select(F.col("y").alias("py"), F.col("x").alias("px"), F.col("v").alias("pv"))
    side = cells.join(F.broadcast(peak)).where((F.abs(F.col("y") - F.col("py")) > exclude) | (F.abs(F.col("x") - F.col("px")) > exclude))
    return side.groupBy("py", "px", "pv").agg(((F.first("pv") - F.avg("v")) / F.stddev_pop("v")).alias("psr"))


def kept_rows(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the folder the cluster names; in a temporary one only where none is named."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="lodestone-"))
    return df.checkpoint()


def regions(cells: DataFrame, group: list[str], corners: bool = True) -> DataFrame:
    """Adds `label` to cells (group, y, x, v): the least cell, as y * 2^32 + x, of its connected region within its group.

    Labels spread to neighbours by equi-joins on the shifted cells and jump to their label's own label, until none changes.
    """
    spark = cells.sparkSession
    own = (F.shiftleft(F.col("y").cast("bigint"), 32) + F.col("x")).cast("bigint")
    labels = kept_rows(cells.select(*group, "y", "x", "v", own.alias("label")))
    near = spark.createDataFrame([(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if corners or not dy or not dx], "dy int, dx int")
    while True:  # labels only fall
        spread = labels.join(F.broadcast(near)).select(*group, (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"), "label").groupBy(*group, "y", "x").agg(F.min("label").alias("near"))
        step = labels.join(spread, [*group, "y", "x"]).select(*group, "y", "x", "v", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(*group, own.alias("label"), F.col("label").alias("further"))
        for _ in range(2):
            step = step.join(jump, [*group, "label"]).select(*group, "y", "x", "v", "was", F.least("label", "further").alias("label"))
        new = kept_rows(step)
        labels = new.drop("was")
        if new.where("label < was").isEmpty():
            return labels


def components(cells: DataFrame, cut: float) -> DataFrame:
    """8-connected components of cells at or above the cut: label (its least cell, y * 100,000 + x), box, area, largest value."""
    found = regions(cells.where(F.col("v") >= cut), []).groupBy("label").agg(F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"), F.count("*").alias("area"), F.max("v").alias("top"))
    return found.withColumn("label", F.shiftright("label", 32) * 100_000 + F.col("label").bitwiseAND((1 << 32) - 1))


def ncc(scene: np.ndarray, template: np.ndarray) -> np.ndarray:
    """Normalised cross-correlation at every place the template fits; 0 where the scene is flat."""
    t = template - template.mean()
    patches = np.lib.stride_tricks.sliding_window_view(scene, template.shape)
    top = np.einsum("yxij,ij->yx", patches, t)
    spread = np.sqrt(np.maximum((patches**2).sum((2, 3)) - patches.sum((2, 3)) ** 2 / t.size, 0) * (t**2).sum())
    return np.where(spread > 1e-9, top / np.where(spread > 1e-9, spread, 1), 0.0)


def mosse_filter(crops: np.ndarray, sigma: float = 1.0, ridge: float = 0.3) -> np.ndarray:
    """The closed-form correlation filter, in the frequency domain, of crops (n, h, w) towards a centred peak."""
    h, w = crops.shape[1:]
    window = np.outer(np.hanning(h), np.hanning(w))
    x = np.log1p(crops)
    x = (x - x.mean((1, 2), keepdims=True)) / (x.std((1, 2), keepdims=True) + 1e-5) * window
    y, x0 = np.mgrid[:h, :w]
    goal = np.fft.fft2(np.exp(-((y - h // 2) ** 2 + (x0 - w // 2) ** 2) / (2 * sigma**2)))
    f = np.fft.fft2(x)
    energy = (f * f.conj()).sum(0)
    return (goal * f.conj()).sum(0) / (energy + ridge * np.abs(energy).mean())


def watershed_peaks(v: np.ndarray, floor: float) -> list[tuple[int, int, float]]:
    """The best cell of each basin: cells above the floor, highest first, join the label of a higher 4-neighbour or begin one."""
    label, best = np.full(v.shape, -1), []
    for flat in np.argsort(-v, axis=None, kind="stable"):
        y, x = divmod(int(flat), v.shape[1])
        if not v[y, x] > floor:
            break
        near = [label[a, b] for a, b in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)) if 0 <= a < v.shape[0] and 0 <= b < v.shape[1] and label[a, b] >= 0]
        if near:
            label[y, x] = min(near)
        else:
            label[y, x] = len(best)
            best.append((y, x, float(v[y, x])))
    return best


def resized(image: np.ndarray, scale: float) -> np.ndarray:
    """Bilinear resize."""
    h, w = max(1, round(image.shape[0] * scale)), max(1, round(image.shape[1] * scale))
    ys, xs = (np.arange(h) + 0.5) / scale - 0.5, (np.arange(w) + 0.5) / scale - 0.5
    y0, x0 = np.clip(np.floor(ys).astype(int), 0, image.shape[0] - 1), np.clip(np.floor(xs).astype(int), 0, image.shape[1] - 1)
    y1, x1 = np.minimum(y0 + 1, image.shape[0] - 1), np.minimum(x0 + 1, image.shape[1] - 1)
    fy, fx = np.clip(ys - y0, 0, 1)[:, None], np.clip(xs - x0, 0, 1)[None, :]
    return (image[y0][:, x0] * (1 - fx) + image[y0][:, x1] * fx) * (1 - fy) + (image[y1][:, x0] * (1 - fx) + image[y1][:, x1] * fx) * fy


def rotated(image: np.ndarray, degrees: float) -> np.ndarray:
    """About the centre, nearest cell, edges repeated."""
    h, w = image.shape
    a = np.deg2rad(degrees)
    y, x = np.mgrid[:h, :w] - np.array([(h - 1) / 2, (w - 1) / 2])[:, None, None]
    sy, sx = np.cos(a) * y - np.sin(a) * x + (h - 1) / 2, np.sin(a) * y + np.cos(a) * x + (w - 1) / 2
    return image[np.clip(np.rint(sy).astype(int), 0, h - 1), np.clip(np.rint(sx).astype(int), 0, w - 1)]


def search_arrays(images: DataFrame, kernel: str = "ncc", scales: tuple = (0.75, 0.875, 1.0, 1.15, 1.3), angles: tuple = (-35, -23.3, -11.7, 0, 11.7, 23.3, 35), floor: float = 0.5) -> DataFrame:
    """Correlation search: rows (image_id, height, width, pixels array<double>, ex, ey, ew, eh) -> boxes with scores before suppression.

    The scene is resized by each scale and the template cut from the resized scene and turned; an image is one task's work.
    """

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                scene = np.asarray(r.pixels, float).reshape(r.height, r.width)
                if scene[r.ey : r.ey + r.eh, r.ex : r.ex + r.ew].std() < 1e-6:
                    continue  # nothing to search by
                for s in scales:
                    small = resized(scene, s)
                    x, y, w, h = round(r.ex * s), round(r.ey * s), round(r.ew * s), round(r.eh * s)
                    template = small[y : y + h, x : x + w]
                    if min(template.shape) < 8:
                        continue
                    if kernel == "ncc":
                        response = np.maximum.reduce([ncc(small, rotated(template, a)) for a in angles])
                    else:
                        f = mosse_filter(np.stack([rotated(template, a) for a in angles]))
                        pad = np.zeros(small.shape)
                        pad[: template.shape[0], : template.shape[1]] = np.fft.fftshift(np.fft.ifft2(f).real)[::-1, ::-1]
                        full = np.fft.irfft2(np.fft.rfft2(small - small.mean()) * np.fft.rfft2(pad).conj(), small.shape)[: small.shape[0] - h + 1, : small.shape[1] - w + 1]
                        response = np.clip(full / (np.abs(full).max() + 1e-9), -1, 1)
                    for py, px, v in watershed_peaks(response, floor):
                        out.append((r.image_id, len(out), int(px / s), int(py / s), r.ew, r.eh, v))
            yield pd.DataFrame(out, columns=["image_id", "pid", "x", "y", "w", "h", "score"])

    return images.mapInPandas(run, "image_id bigint, pid bigint, x int, y int, w int, h int, score double")


def rescored(images: DataFrame, proposals: DataFrame, angles: tuple = (-35, -23.3, -11.7, 0, 11.7, 23.3, 35), margin: float = 0.15, least: int = 8) -> DataFrame:
    """proposals (image_id, pid, x, y, w, h) with `score`, the best local correlation of the exemplar, brought to the proposal's size and turned, within the proposal and a margin; -1 where either is too small.

    images are those of `search_arrays`; an image is one task's work.
    """

    def run(key: tuple, scenes: pd.DataFrame, boxes: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in scenes.itertuples():
            scene = np.asarray(r.pixels, float).reshape(r.height, r.width)
            exemplar, banks = scene[r.ey : r.ey + r.eh, r.ex : r.ex + r.ew], {}
            for b in boxes.itertuples():
                mx, my = round(b.w * margin), round(b.h * margin)
                place = scene[max(0, b.y - my) : b.y + b.h + my, max(0, b.x - mx) : b.x + b.w + mx]
                score = -1.0
                if min(b.w, b.h) >= least and place.shape[0] >= b.h and place.shape[1] >= b.w:
                    if (b.w, b.h) not in banks:
                        sized = stretched(exemplar, b.h, b.w)
                        banks[b.w, b.h] = [rotated(sized, a) for a in angles]
                    score = max(float(ncc(place, t).max()) for t in banks[b.w, b.h])
                out.append((b.image_id, b.pid, b.x, b.y, b.w, b.h, score))
        return pd.DataFrame(out, columns=["image_id", "pid", "x", "y", "w", "h", "score"])

    return images.groupBy("image_id").cogroup(proposals.select("image_id", "pid", "x", "y", "w", "h").groupBy("image_id")).applyInPandas(run, "image_id bigint, pid bigint, x int, y int, w int, h int, score double")


def stretched(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear resize to given sides."""
    rows = [np.interp((np.arange(n) + 0.5) * side / n - 0.5, np.arange(side), np.arange(side)) for n, side in ((height, image.shape[0]), (width, image.shape[1]))]
    (y0, x0), (y1, x1) = (np.floor(r).astype(int) for r in rows), (np.ceil(r).astype(int) for r in rows)
    fy, fx = (rows[0] - y0)[:, None], (rows[1] - x0)[None, :]
    return (image[y0][:, x0] * (1 - fx) + image[y0][:, x1] * fx) * (1 - fy) + (image[y1][:, x0] * (1 - fx) + image[y1][:, x1] * fx) * fy
