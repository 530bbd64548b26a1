"""Score thresholds for a group of candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import batches, folds


def self_similarity(self_score: Column, retain: float = 0.85) -> Column:
    """A share of the exemplar's own score, which must be known."""
    return F.when(self_score.isNull(), F.raise_error(F.lit("self_score is needed"))).otherwise(self_score * retain)


def largest_gap(scores: DataFrame, group: list[str], top: int = 50) -> DataFrame:
    """The middle of the largest gap among the `top` scores; the first of equal gaps; a single score s gives s - 1e-9."""
    order = W.partitionBy(*group).orderBy(F.col("score").desc(), "key")
    ranked = scores.withColumns({"k": F.row_number().over(order), "next": F.lead("score").over(order)}).where(F.col("k") <= top)
    gap = F.when(F.col("k") < top, F.round(F.col("score") - F.col("next"), 9))
    best = ranked.groupBy(*group).agg(F.max_by(F.struct("score", "next"), F.struct(gap, -F.col("k"))).alias("b"), F.count("*").alias("n"), F.max("score").alias("top"))
    return best.select(*group, F.when(F.col("n") == 1, F.col("top") - 1e-9).otherwise((F.col("b.score") + F.col("b.next")) / 2).alias("threshold"))


def contrast(scores: DataFrame, group: list[str], order: list[str] | None = None) -> DataFrame:
    """0.5 * (mean + deviation) + 0.5 * 0.85 * the 99.5th percentile.

    With `order`, a group's scores are added one after the other by these columns (for groups that fit a row), so that the last digits are the same in every run.
    """
    top = F.percentile("score", F.lit(0.995))
    if order is None:
        return scores.groupBy(*group).agg((0.5 * (F.avg("score") + F.stddev_pop("score")) + 0.5 * 0.85 * top).alias("threshold"))

    def step(a: Column, r: Column) -> Column:
        n, off = a["n"] + 1, r["score"] - a["mean"]
        mean = a["mean"] + off / n
        return F.struct(n.alias("n"), mean.alias("mean"), (a["squares"] + (r["score"] - mean) * off).alias("squares"), (a["total"] + r["score"]).alias("total"))

    none = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("squares"), F.lit(0.0).alias("total"))
    known = scores.select(*group, *order, F.col("score").cast("double").alias("score"))
    rows = F.collect_list(F.when(F.col("score").isNotNull(), F.struct(*order, "score")))
    sums = F.aggregate(F.sort_array(rows), none, step, lambda a: F.when(a["n"] > 0, a["total"] / a["n"] + F.sqrt(a["squares"] / a["n"])))
    return known.groupBy(*group).agg(sums.alias("spread"), top.alias("top")).select(*group, (0.5 * F.col("spread") + 0.5 * 0.85 * F.col("top")).alias("threshold"))


def repeat_aware(boxes: DataFrame, self_scores: DataFrame, group: list[str], alike: float = 0.9, many: float = 0.85, retain: float = 0.35, nms_iou: float = 0.3) -> DataFrame:
    """`many` of the own score where two or more separate boxes reach `alike` of it, else `retain` of it."""
    near = boxes.join(self_scores, group).where(F.col("score") >= alike * F.col("self_score"))
    n = folds.nms(near, group, nms_iou).groupBy(*group).agg(F.count("*").alias("n"))
    return self_scores.join(n, group, "left").select(*group, (F.col("self_score") * F.when(F.col("n") >= 2, many).otherwise(retain)).alias("threshold"))


def clamped(threshold: Column, degenerate: Column, floor: float = 0.7) -> Column:
    return F.when(degenerate, F.lit(floor)).otherwise(F.greatest(threshold, F.lit(floor)))


def separated(s: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Thresholds of groups of one size (a row of sorted scores each), and which are degenerate: see `gmm`."""
    groups, n = s.shape
    threshold, degenerate = np.full(groups, np.nan), np.ones(groups, bool)
    if not n:
        return threshold, degenerate
    if n < 2:
        return s[:, 0] - 1e-9, degenerate
    at, all_groups = np.diff(s).argmax(1), np.arange(groups)
    threshold = (s[all_groups, at] + s[all_groups, at + 1]) / 2
    if n < 4:
        return threshold, degenerate
    fit = np.flatnonzero(s[:, 0] != s[:, -1])
    own = s[fit]
    x = np.ascontiguousarray(own.T)[:, None]  # score, side, group
    mean = np.stack([own[:, : n // 2].mean(1), own[:, n // 2 :].mean(1)])
    var, share = np.repeat(own.var(1)[None] / 4 + 1e-9, 2, 0), np.full((2, len(fit)), 0.5)
    left, ends = np.arange(len(fit)), (mean.copy(), var.copy(), share.copy())
    for _ in range(rounds):
        if not len(left):
            break
        like = share * np.exp(-((x - mean) ** 2) / (2 * var)) / np.sqrt(2 * np.pi * var)
        like /= np.maximum(like.sum(1, keepdims=True), 1e-300)
        weight = np.maximum(like.sum(0), 1e-12)
        new = (like * x).sum(0) / weight
        var, share = (like * (x - new) ** 2).sum(0) / weight + 1e-9, weight / n
        done = np.abs(new - mean).max(0) < 1e-9
        mean = np.where(done, mean, new)
        for end, now in zip(ends, (mean, var, share)):
            end[:, left] = now
        if done.any():
            left, x, mean, var, share = left[~done], x[:, :, ~done], mean[:, ~done], var[:, ~done], share[:, ~done]
    mean, var, share = ends
    by_mean = np.argsort(mean, axis=0, kind="stable")
    mean, var, share = (np.take_along_axis(e, by_mean, 0) for e in (mean, var, share))
    apart = ~((mean[1] - mean[0] < 2 * np.sqrt((share * var).sum(0))) | (share.min(0) < 0.05))
    for some in np.array_split(np.flatnonzero(apart), max(1, int(apart.sum()) // 1024)):
        grid = np.linspace(mean[0, some], mean[1, some], 512)
        low, high = (share[i, some] * np.exp(-((grid - mean[i, some]) ** 2) / (2 * var[i, some])) / np.sqrt(2 * np.pi * var[i, some]) for i in (0, 1))
        threshold[fit[some]] = grid[(high >= low).argmax(0), np.arange(len(some))]
    degenerate[fit[apart]] = False
    return threshold, degenerate


def gmm(scores: DataFrame, group: list[str], schema: str, rounds: int = 200) -> DataFrame:
    """Where two fitted normals are equally likely. Degenerate (too close, or one too rare): the middle of the largest gap.

    Expectation-maximisation in numpy over groups' scores, many groups of one size at once; `schema` gives the groups' columns. Null scores don't count.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches.tables(parts):
            starts, sizes, flat = batches.lists(table, "_s")
            values, threshold, degenerate = batches.numbers(flat), np.zeros(len(starts)), np.zeros(len(starts), bool)
            for (n,), at in batches.alike(sizes, cells=1 << 15):
                threshold[at], degenerate[at] = separated(values[starts[at, None] + np.arange(n)], rounds)
            out = [table[c] for c in group] + [pa.array(threshold, from_pandas=True), pa.array(degenerate)]
            yield from pa.table(out, names=[*group, "threshold", "degenerate"]).to_batches()

    sorted_scores = scores.groupBy(*group).agg(F.sort_array(F.collect_list(F.col("score").cast("double"))).alias("_s"))
    return sorted_scores.mapInArrow(run, f"{schema}, threshold double, degenerate boolean")
