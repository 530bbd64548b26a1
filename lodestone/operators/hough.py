"""Pose votes from keypoint correspondences, their soft histogram, peaks, and verification by sampling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import batches
from lodestone.functions.folds import keep_greedily

TURN = 360.0
THETA_BINS = 12


def single_votes(c: DataFrame, cx: float, cy: float) -> DataFrame:
    """Centre, log2 scale and angle from one correspondence with scales and angles."""
    scale = F.col("scene_scale") / F.col("crop_scale")
    theta = F.radians(F.pmod(F.col("scene_angle") - F.col("crop_angle"), F.lit(TURN)))
    ox, oy = (cx - F.col("crop_x")) * scale, (cy - F.col("crop_y")) * scale
    return c.select(
        "image_id", "vid",
        (F.col("scene_x") + F.cos(theta) * ox - F.sin(theta) * oy).alias("dx"), (F.col("scene_y") + F.sin(theta) * ox + F.cos(theta) * oy).alias("dy"),
        F.log2(scale).alias("log_scale"), F.degrees(theta).alias("theta_deg"),
    )


def translation_votes(c: DataFrame, cx: float, cy: float) -> DataFrame:
    return c.select("image_id", "vid", (cx + F.col("scene_x") - F.col("crop_x")).alias("dx"), (cy + F.col("scene_y") - F.col("crop_y")).alias("dy"), F.lit(0.0).alias("log_scale"), F.lit(0.0).alias("theta_deg"))


def sampled_pairs(c: DataFrame, cap: int, seed: int) -> DataFrame:
    """(image_id, vid_a, vid_b): `cap` different pairs of each image's correspondences, by a seeded draw."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        vid, image = np.sort(pdf.vid.to_numpy()), pdf.image_id.iloc[0]
        rng, n, held = np.random.default_rng([seed, int(image)]), len(vid), np.zeros(0, np.int64)
        while len(held) < cap:
            i, j = rng.integers(0, n, (2, cap))
            drawn = (np.minimum(i, j) * n + np.maximum(i, j))[i != j]
            every = np.concatenate([held, drawn])
            held = every[np.sort(np.unique(every, return_index=True)[1])][:cap]
        return pd.DataFrame({"image_id": image, "vid_a": vid[held // n], "vid_b": vid[held % n]})

    return c.select("image_id", "vid").groupBy("image_id").applyInPandas(run, "image_id bigint, vid_a bigint, vid_b bigint")


def pairwise_votes(c: DataFrame, cx: float, cy: float, cap: int = 20_000, seed: int = 7) -> DataFrame:
    """A similarity from each pair i < j of an image's correspondences; of an image with more than `cap` pairs (the reference method's own bound), from a seeded sample of them."""
    n = F.count("*")
    many = c.groupBy("image_id").agg((n * (n - 1) / 2 > cap).alias("many")).where("many").select("image_id")
    own = c.join(many, "image_id", "left_anti")
    large = c.join(many, "image_id", "left_semi")
    a = c.select("image_id", *[F.col(x).alias(f"{x}_a") for x in ("vid", "crop_x", "crop_y", "scene_x", "scene_y")])
    b = c.select("image_id", *[F.col(x).alias(f"{x}_b") for x in ("vid", "crop_x", "crop_y", "scene_x", "scene_y")])
    all_of = own.select("image_id", F.col("vid").alias("vid_a")).join(own.select("image_id", F.col("vid").alias("vid_b")), "image_id").where("vid_a < vid_b")
    chosen = all_of.union(sampled_pairs(large, cap, seed).select("image_id", "vid_a", "vid_b"))
    pairs = chosen.join(a, ["image_id", "vid_a"]).join(b, ["image_id", "vid_b"])
    ux, uy = F.col("crop_x_b") - F.col("crop_x_a"), F.col("crop_y_b") - F.col("crop_y_a")
    vx, vy = F.col("scene_x_b") - F.col("scene_x_a"), F.col("scene_y_b") - F.col("scene_y_a")
    size = ux * ux + uy * uy
    p, q = (vx * ux + vy * uy) / size, (vy * ux - vx * uy) / size  # scale and turn as one complex number
    ox, oy = cx - F.col("crop_x_a"), cy - F.col("crop_y_a")
    moved = pairs.where((size > 0) & ((vx != 0) | (vy != 0)))
    return moved.select(
        "image_id", "vid_a", "vid_b", (F.col("scene_x_a") + p * ox - q * oy).alias("dx"), (F.col("scene_y_a") + q * ox + p * oy).alias("dy"),
        (F.log2(p * p + q * q) / 2).alias("log_scale"), F.pmod(F.degrees(F.atan2(q, p)), F.lit(TURN)).alias("theta_deg"),
    )


def histogram(votes: DataFrame, side: float, key: str = "vid") -> DataFrame:
    """Each vote over its 16 nearest bins of place, scale and angle, weighted by nearness; places are coarser at larger scales, angles are a circle."""
    s = F.col("log_scale")
    width = F.lit(0.25 * side) * F.pow(F.lit(2.0), F.floor(s))
    at = {"bx": F.col("dx") / width - 0.5, "by": F.col("dy") / width - 0.5, "bs": s - 0.5, "bt": F.col("theta_deg") / (TURN / THETA_BINS) - 0.5}
    rows = votes.withColumns({k: F.round(e, 9) for k, e in at.items()})
    corners = [F.struct(*[F.lit(i >> k & 1).alias(name) for k, name in enumerate("abcd")]) for i in range(16)]
    steps = F.explode(F.array(*corners))
    rows = rows.withColumn("n", steps)

    def part(name: str, step: str) -> tuple[Column, Column]:
        low = F.floor(name)
        share = F.col(name) - low
        return low + F.col(f"n.{step}"), F.when(F.col(f"n.{step}") == 1, share).otherwise(1 - share)

    (x, wx), (y, wy), (sc, ws), (t, wt) = part("bx", "a"), part("by", "b"), part("bs", "c"), part("bt", "d")
    binned = rows.select("image_id", key, x.alias("bx"), y.alias("by"), sc.alias("bs"), F.pmod(t, F.lit(THETA_BINS)).alias("bt"), F.round(wx * wy * ws * wt, 12).alias("weight")).where("weight > 0")
    return binned.groupBy("image_id", "bx", "by", "bs", "bt").agg(F.round(F.sum("weight"), 9).alias("weight"), F.sort_array(F.collect_set(key)).alias("members"))


def peaks(hist: DataFrame, least: float = 2.0) -> DataFrame:
    """Bins of `least` votes and more that no heavier kept bin touches (next to it in all four dimensions, angles around the circle)."""
    order = F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("w"), "bx", "by", "bs", "bt")))
    circle = lambda k, b: F.least(F.pmod(k["bt"] - b["bt"], F.lit(THETA_BINS)), F.pmod(b["bt"] - k["bt"], F.lit(THETA_BINS)))
    touch = lambda k, b: (F.abs(k["bx"] - b["bx"]) <= 1) & (F.abs(k["by"] - b["by"]) <= 1) & (F.abs(k["bs"] - b["bs"]) <= 1) & (circle(k, b) <= 1)
    kept = hist.where(F.col("weight") >= least).groupBy("image_id").agg(keep_greedily(order, touch).alias("kept"))
    return kept.select("image_id", F.explode("kept").alias("p")).select("image_id", "p.bx", "p.by", "p.bs", "p.bt", (-F.col("p.w")).alias("weight"))


def model_fault(m: Column, low: float = 0.2, high: float = 5.0) -> Column:
    """Why a 2 x 3 affine map is no upright similarity, else null."""
    det = m[0] * m[4] - m[1] * m[3]
    scale = F.sqrt(F.abs(det))
    return F.when(det < 0, "mirrored").when((scale < low) | (scale > high), "scale")


def similarity_matrix() -> Column:
    """The 2 x 3 matrix of a row of `ransac`."""
    turn = F.when(F.col("mirrored"), -1.0).otherwise(1.0)
    return F.array("a", -turn * F.col("b"), "tx", "b", turn * F.col("a"), "ty")


def verdict(m: Column, inliers: Column, boxed: Column, least: int) -> Column:
    """What a peak's fit is: an instance with enough inliers, a sound model and a box in the image; a candidate with a box alone; else null."""
    sound = model_fault(m).isNull() & (inliers >= least)
    return F.when(boxed.isNotNull(), F.when(sound, "instance").otherwise("candidate"))


def of_peaks(c: DataFrame, hist: DataFrame, found: DataFrame) -> DataFrame:
    """The correspondences that voted for each peak, with its number in the image, the heaviest first."""
    bins = ["bx", "by", "bs", "bt"]
    number = F.row_number().over(W.partitionBy("image_id").orderBy(F.col("weight").desc(), *bins)) - 1
    members = found.withColumn("peak", number).drop("weight").join(hist.drop("weight"), ["image_id", *bins])
    return c.join(members.select("image_id", "peak", F.explode("members").alias("vid")), ["image_id", "vid"])


def ransac(c: DataFrame, pixels: float = 3.0, tries: int = 200, least: int = 5, seed: int = 7) -> DataFrame:
    """Similarities by seeded two-point samples, one after the other: fit, take its inliers out, repeat. A row for each instance of an image.

    Each sample gives a proper and a mirrored similarity; the mirrored one is the map of conjugates and wins only with more inliers.

    If c has a column `peak`, one fit to the correspondences of each peak instead, whose number is the instance's.
    Many images are computed at once, those of one number of correspondences together; each image draws from its own generator.
    """
    by_peak = ["peak"] if "peak" in c.columns else []

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches.tables(parts):
            starts, sizes, flat = batches.lists(table, "_c")
            part = {k: batches.numbers(flat.field(k)) for k in ("crop_x", "crop_y", "scene_x", "scene_y")}
            z, w = part["crop_x"] + 1j * part["crop_y"], part["scene_x"] + 1j * part["scene_y"]
            keys = np.stack([table[k].to_numpy() for k in ("image_id", *by_peak)], 1)
            for (n,), at in batches.alike(sizes, cells=1 << 16):
                if n < max(least, 2):
                    continue
                own, rng = starts[at, None] + np.arange(n), [np.random.default_rng([seed, *k]) for k in keys[at].tolist()]
                work, k = [(np.arange(len(at)), z[own], w[own])], 0
                while work:  # each round takes correspondences out
                    later = []
                    for who, zs, ws in work:
                        size = zs.shape[1]
                        for i in range(0, len(who), step := max(1, (1 << 20) // (size * min(tries, size * size)))):
                            some = slice(i, i + step)
                            draws = np.stack([rng[g].integers(0, size, (2, tries)) for g in who[some]])
                            ok, near, model, mirrored = best_fits(zs[some], ws[some], draws, pixels)
                            count = near.sum(1)
                            ok &= count >= least
                            at_ok = at[who[some]][ok]
                            number = keys[at_ok, 1] if by_peak else np.full(len(at_ok), k)
                            p, shift = model[ok].T
                            out = [keys[at_ok, 0], number.astype(np.int32), count[ok].astype(np.int32), p.real, p.imag, shift.real, shift.imag, mirrored[ok]]
                            yield from pa.table([pa.array(np.ascontiguousarray(x)) for x in out], names=["image_id", "instance", "inliers", "a", "b", "tx", "ty", "mirrored"]).to_batches()
                            for m in np.unique(size - count[ok]):
                                if m >= max(least, 2) and not by_peak:
                                    more = ok & (size - count == m)
                                    later.append((who[some][more], zs[some][more][~near[more]].reshape(-1, m), ws[some][more][~near[more]].reshape(-1, m)))
                    work, k = later, k + 1

    each = c.groupBy("image_id", *by_peak).agg(F.sort_array(F.collect_list(F.struct("vid", "crop_x", "crop_y", "scene_x", "scene_y"))).alias("_c"))
    return each.mapInArrow(run, "image_id bigint, instance int, inliers int, a double, b double, tx double, ty double, mirrored boolean")


def best_fits(z: np.ndarray, w: np.ndarray, draws: np.ndarray, pixels: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For images of one size (a row each): whether a draw (image, 2, try) has two places; the inliers, the model (p, shift) of the first best draw, and whether it is mirrored.

    Where all ordered pairs are fewer than the draws, each pair is fitted once and the draws look it up.
    """
    images, n = z.shape
    first, second = draws[:, 0], draws[:, 1]
    each = np.arange(images)[:, None]
    if n * n <= draws.shape[2]:
        i, j = (np.broadcast_to(x.ravel(), (images, n * n)) for x in np.indices((n, n)))
        place = first * n + second
    else:
        i, j, place = first, second, np.broadcast_to(np.arange(draws.shape[2]), first.shape)
    apart, found = z[each, i] != z[each, j], None
    one = np.arange(images)
    for mirrored, source in ((False, z), (True, z.conj())):
        step = np.where(apart, source[each, j] - source[each, i], 1)
        p = (w[each, j] - w[each, i]) / step
        shift = w[each, i] - p * source[each, i]
        near = np.abs(p[..., None] * source[:, None] + shift[..., None] - w[:, None]) < pixels
        counts = np.where(apart, near.sum(2), -1)
        best = place[one, counts[each, place].argmax(1)]
        now = near[one, best], np.stack([p[one, best], shift[one, best]], 1), counts[one, best]
        if found is None:
            found, turned = now, np.zeros(images, bool)
        else:
            turned = now[2] > found[2]
            found = np.where(turned[:, None], now[0], found[0]), np.where(turned[:, None], now[1], found[1]), np.maximum(now[2], found[2])
    return found[2] >= 0, found[0], found[1], turned
