"""Detections against ground truth: matching, precision and recall, average precision, counting errors, slices, fusion, tuning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import folds
from lodestone.functions.geometry import crowding_bucket, iou, resolution_bucket, size_bucket
from lodestone.functions.rates import f1_dice, f1_strict, precision, recall


def match_counts(preds: DataFrame, truths: DataFrame, threshold: float = 0.5) -> DataFrame:
    """tp, fp, fn of each image. A truth is taken once; further predictions of it are false."""
    m = folds.matched(preds, truths, threshold)
    tp = F.size(F.filter("taken", lambda i: i >= 0)).cast("bigint")
    return m.select("image_id", tp.alias("tp"), (F.size("preds") - tp).alias("fp"), (F.size("truths") - tp).alias("fn"))


def match_flags(preds: DataFrame, truths: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Each prediction with the truth it took, or null."""
    m = folds.matched(preds, truths, threshold).select("image_id", F.explode(F.arrays_zip("preds", "taken")).alias("z"))
    return m.select("image_id", F.col("z.preds.id").alias("pid"), F.when(F.col("z.taken") >= 0, F.col("z.taken")).alias("gid"))


def labelled_overlay(preds: DataFrame, truths: DataFrame, threshold: float = 0.5) -> DataFrame:
    """TP, FP and FN boxes by id, for drawing."""
    flags = match_flags(preds, truths, threshold)
    hit = flags.select("image_id", F.when(F.col("gid").isNotNull(), "TP").otherwise("FP").alias("kind"), F.col("pid").alias("id"))
    taken = flags.where("gid IS NOT NULL").select("image_id", "gid")
    missed = truths.join(taken, ["image_id", "gid"], "left_anti").select("image_id", F.lit("FN").alias("kind"), F.col("gid").alias("id"))
    return hit.unionByName(missed)


def prf(counts: DataFrame) -> DataFrame:
    p, r = precision(F.col("tp"), F.col("fp")), recall(F.col("tp"), F.col("fn"))
    return counts.withColumns({"precision": p, "recall": r}).withColumns({"f1_strict": f1_strict(F.col("precision"), F.col("recall")), "f1_dice": f1_dice(F.col("tp"), F.col("fp"), F.col("fn"))})


def pr_curve(preds: DataFrame, truths: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per image and rank: running precision and recall and their right envelope. Images without truths have no curve."""
    n = truths.groupBy("image_id").agg(F.count("*").alias("n_gt"))
    ranked = W.partitionBy("image_id").orderBy(F.col("score").desc(), "y", "x", "pid")
    hits = match_flags(preds, truths, threshold).select("image_id", "pid", F.col("gid").isNotNull().cast("bigint").alias("hit"))
    rows = preds.join(hits, ["image_id", "pid"]).join(n, "image_id").withColumn("rank", F.row_number().over(ranked))
    by_rank = W.partitionBy("image_id").orderBy("rank")
    rows = rows.withColumn("tp", F.sum("hit").over(by_rank.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumns({"precision": F.col("tp") / F.col("rank"), "recall": F.col("tp") / F.col("n_gt")})
    rows = rows.withColumn("envelope", F.max("precision").over(by_rank.rowsBetween(0, W.unboundedFollowing)))
    return rows.withColumn("step", F.col("recall") - F.lag("recall", 1, 0.0).over(by_rank)).select("image_id", "rank", "tp", "precision", "recall", "envelope", "step")


def average_precision(preds: DataFrame, truths: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Step integral of the envelope for every image with truths; 0 without predictions."""
    area = pr_curve(preds, truths, threshold).groupBy("image_id").agg(F.sum(F.col("step") * F.col("envelope")).alias("ap"))
    return truths.select("image_id").distinct().join(area, "image_id", "left").select("image_id", F.coalesce("ap", F.lit(0.0)).alias("ap"))


def taken_at(preds: Column, threshold: Column) -> Column:
    """Per prediction in order, whether it takes a truth: the first one free of its candidates, which stand by falling overlap."""

    def step(taken: Column, p: Column) -> Column:
        free = F.filter(p["near"], lambda g: (g["o"] <= -threshold) & ~F.array_contains(taken, g["id"]))
        return F.concat(taken, F.array(F.coalesce(F.get(free, 0)["id"], F.lit(-1).cast("bigint"))))

    return F.transform(F.aggregate(preds, F.array().cast("array<bigint>"), step), lambda g: (g >= 0).cast("bigint"))


def mean_of(xs: Column, n: int) -> Column:
    """Mean of n values of 0 to 1 in binary, where an engine may add them in any order: the middle of the sums from first to last, from last to first and exact.

    So if all orders of adding come out on one side of the half of a digit, the mean does too.
    """
    plain = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    unit = 2.0 ** (62 - (n - 1).bit_length())  # n values fit a bigint
    whole = F.aggregate(xs, F.lit(0).cast("bigint"), lambda s, x: s + (x * unit).cast("bigint")) / unit
    return F.get(F.sort_array(F.array(plain(xs), plain(F.reverse(xs)), whole)), 1) / n


def coco_ap(preds: DataFrame, truths: DataFrame) -> DataFrame:
    """Mean AP over IoU 0.50 to 0.95 in steps of 0.05, with AP50 and AP75. Overlaps are computed once for a pair; all thresholds go through one plan.

    A threshold's terms are added in binary by rank, as the SQL does in nearly all sums; see mean_of for the thresholds.
    """
    grid = F.transform(F.sequence(F.lit(50), F.lit(95), F.lit(5)), lambda t: t / 100.0)
    g = truths.select("image_id", F.col("gid").cast("bigint").alias("gid"), F.struct("x", "y", "w", "h").alias("g"))
    p = preds.select("image_id", "pid", "score", "y", "x", F.struct("x", "y", "w", "h").alias("p"))
    overlap = iou(F.col("p"), F.col("g"))
    candidate = F.when(overlap >= 0.5, F.struct((-overlap).alias("o"), F.col("gid").alias("id")))  # collect_list leaves nulls out
    near = p.join(g, "image_id").groupBy("image_id", "pid", "score", "y", "x").agg(F.sort_array(F.collect_list(candidate)).alias("near"))
    n = truths.groupBy("image_id").agg(F.count("*").alias("n"))
    images = n.join(near.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "y", "x", "pid", "near"))).alias("preds")), "image_id", "left")
    taken = F.coalesce(taken_at(F.col("preds"), F.col("t")), F.array().cast("array<bigint>"))
    ranks = F.filter(F.transform(taken, lambda hit, k: F.when(hit == 1, k + 1)), lambda k: k.isNotNull())
    precisions = F.reverse(F.transform(F.col("ranks"), lambda rank, i: (i + 1) / rank))  # the envelope falls on hits alone
    none = F.struct(F.lit(0.0).alias("top"), F.array().cast("array<double>").alias("envelope"))
    envelope = F.aggregate(precisions, none, lambda a, p: F.struct(F.greatest(a["top"], p).alias("top"), F.concat(F.array(F.greatest(a["top"], p)), a["envelope"]).alias("envelope")), lambda a: a["envelope"])
    area = F.aggregate(envelope, F.lit(0.0), lambda s, p: s + p / F.col("n"))
    ap = images.withColumn("t", F.explode(grid)).withColumn("ranks", ranks).select("image_id", "t", area.alias("ap"))
    aps = ap.groupBy("image_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "ap"))), lambda z: z["ap"]).alias("aps"))
    return aps.select("image_id", mean_of(F.col("aps"), 10).alias("ap"), F.get("aps", 0).alias("ap50"), F.get("aps", 5).alias("ap75"))


def counting_errors(df: DataFrame, group: list[str], predicted: str = "predicted_count", true: str = "true_count") -> DataFrame:
    """MAE, RMSE and NAE (over images with a true count above 0; 0 if there is none)."""
    gap = F.col(predicted).cast("double") - F.col(true)
    return df.where(F.col(predicted).isNotNull() & F.col(true).isNotNull()).groupBy(*group).agg(
        F.avg(F.abs(gap)).alias("mae"),
        F.sqrt(F.avg(gap * gap)).alias("rmse"),
        F.coalesce(F.avg(F.when(F.col(true) > 0, F.abs(gap) / F.col(true))), F.lit(0.0)).alias("nae"),
    )


def aggregates() -> list[Column]:
    """Micro precision, recall and F1 over scored rows, mean AP and latency, outcome counts."""
    scored = F.col("tp").isNotNull()
    tp, fp, fn = (F.sum(F.when(scored, F.col(c))) for c in ("tp", "fp", "fn"))
    p, r = precision(tp, fp), recall(tp, fn)
    return [
        F.count("*").alias("n"), F.count_if(scored).alias("n_scored"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), p.alias("precision"), r.alias("recall"), f1_strict(p, r).alias("f1"),
        F.avg("ap").alias("mean_ap"), F.avg("latency_ms").alias("mean_latency_ms"), F.count_if(F.col("outcome") == "error").alias("errors"), F.count_if(F.col("outcome") == "empty").alias("abstained"),
    ]


def micro_aggregate(results: DataFrame, group: list[str]) -> DataFrame:
    return results.groupBy(*group).agg(*aggregates())


def sliced(results: DataFrame) -> DataFrame:
    """All slices of each method in one pass of grouping sets. Rows without a slice's key are in none of its groups; keys are text, as they sort in reports."""
    with_keys = results.withColumns({"instances": F.col("instance_count").cast("string"), "crowding": crowding_bucket(F.col("instance_count")), "resolution": resolution_bucket(F.col("canvas_size"))})
    keys = ["canvas_size", "instances", "scale_bucket", "crowding", "resolution"]
    cells = with_keys.groupingSets([[F.col("method"), F.col(k)] for k in keys], F.col("method"), *[F.col(k) for k in keys]).agg(F.grouping_id().alias("g"), *aggregates())
    # the bits of the grouping id, from the first key down, are 1 for keys that are not grouped by
    slices = F.coalesce(*[F.when(F.col("g") == 31 - (1 << (len(keys) - 1 - i)), k) for i, k in enumerate(keys)])
    return cells.withColumns({"slice": slices, "key": F.coalesce(*[F.col(k) for k in keys])}).where("key IS NOT NULL").drop("g", *keys)


def recall_by_size(truths: DataFrame, taken: DataFrame, canvas: int) -> DataFrame:
    """The three size buckets, always, with recall null where there is no truth."""
    buckets = truths.sparkSession.createDataFrame([("small",), ("medium",), ("large",)], "bucket string")
    hits = truths.join(taken.where("gid IS NOT NULL").select("image_id", "gid", F.lit(1).alias("hit")), ["image_id", "gid"], "left")
    counted = hits.withColumn("bucket", size_bucket(F.col("w").cast("bigint") * F.col("h"), F.lit(canvas))).groupBy("bucket").agg(F.count("*").alias("n"), F.count("hit").alias("found"))
    return buckets.join(counted, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("found", F.lit(0)).alias("found"), (F.col("found") / F.col("n")).alias("recall"))


def coverage(ids: DataFrame, truths: DataFrame) -> DataFrame:
    """Labelled and unlabelled images; unlabelled ones are reported, not dropped."""
    own = truths.select("image_id").distinct().withColumn("labelled", F.lit(True))
    return ids.join(own, "image_id", "left").select("image_id", F.coalesce("labelled", F.lit(False)).alias("labelled"))


def fuse(parts: list[DataFrame], threshold: float = 0.5) -> DataFrame:
    """Late fusion of several exemplars' boxes: all of them, then suppression. One part passes unchanged."""
    if len(parts) == 1:
        return parts[0].select("image_id", "pid", "x", "y", "w", "h", "score")
    n = len(parts)
    everything = None
    for i, part in enumerate(parts):
        own = part.select("image_id", (F.col("pid") * n + i).alias("pid"), "x", "y", "w", "h", "score")
        everything = own if everything is None else everything.unionByName(own)
    return folds.nms(everything, ["image_id"], threshold)


def apart_from(candidates: DataFrame, kept: DataFrame, threshold: float) -> DataFrame:
    """Candidates that reach the threshold with no kept box of their image."""
    k = kept.select(F.col("image_id").alias("k_image"), F.struct("x", "y", "w", "h").alias("k_box"))
    return candidates.join(k, (F.col("image_id") == F.col("k_image")) & (iou(F.struct("x", "y", "w", "h"), F.col("k_box")) >= threshold), "left_anti")


def exemplar_match(matches: DataFrame, exemplars: DataFrame, least: float = 0.5) -> DataFrame:
    """The match that is the exemplar itself: the largest IoU from `least` on; of equal ones the last in order."""
    e = exemplars.select("run_id", F.struct("x", "y", "w", "h").alias("e"))
    o = matches.join(e, "run_id").withColumn("o", iou(F.struct("x", "y", "w", "h"), F.col("e"))).where(F.col("o") >= least)
    return o.groupBy("run_id").agg(F.max_by("idx", F.struct("o", "idx")).alias("idx"), F.max("o").alias("iou"))


def tuning_choice(trials: DataFrame, group: list[str], f1: str = "f1", trial: str = "trial") -> DataFrame:
    """The best trial of each group: null counts as worst, the first of equals wins."""
    return trials.withColumn("_k", F.row_number().over(W.partitionBy(*group).orderBy(F.coalesce(f1, F.lit(-1.0)).desc(), trial))).where("_k = 1").drop("_k")


def tuned_delta(tuned: DataFrame, default: DataFrame, key: list[str], metric: str = "f1") -> DataFrame:
    """tuned - default; null where either is."""
    d = default.select(*key, F.col(metric).alias("default_value"))
    return tuned.select(*key, F.col(metric).alias("tuned_value")).join(d, key, "full").withColumn("delta", F.col("tuned_value") - F.col("default_value"))


def regime_winner(cells: DataFrame) -> DataFrame:
    """The method of the largest F1 in each regime; by name among equals."""
    return cells.where("f1 IS NOT NULL").groupBy("regime").agg(F.min_by("method", F.struct(-F.col("f1"), "method")).alias("method"), F.max("f1").alias("f1"))


def reconcile(published: DataFrame, measured: DataFrame, key: list[str], digits: int = 3) -> DataFrame:
    """Published against measured values: their difference, and whether they agree when rounded."""
    p, m = F.col("published"), F.col("measured")
    return published.join(measured, key, "full").withColumns({"delta": m - p, "agrees": F.bround(m, digits).eqNullSafe(F.bround(p, digits))})


def extremes(results: DataFrame, least: int = 3) -> DataFrame:
    """Per method the images of highest and lowest F1 among those of `least` instances and more."""
    own = results.where((F.col("instance_count") >= least) & F.col("f1").isNotNull())
    return own.groupBy("method").agg(F.min_by("run_id", F.struct(-F.col("f1"), "run_id")).alias("easy"), F.min_by("run_id", F.struct(F.col("f1"), "run_id")).alias("hard"))


def winners(scores: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """All method pairs on an image: which has the larger score; errors count -1 and unknown ones 0; near equality is a tie."""
    s = F.when(F.col("outcome") == "error", -1.0).otherwise(F.coalesce("f1", F.lit(0.0)))
    a = scores.select("image_id", F.col("method").alias("method_a"), s.alias("score_a"))
    b = scores.select("image_id", F.col("method").alias("method_b"), s.alias("score_b"))
    pairs = a.join(b, "image_id").where("method_a < method_b")
    gap = F.col("score_a") - F.col("score_b")
    return pairs.withColumn("winner", F.when(F.abs(gap) <= tolerance, "tie").when(gap > 0, "a").otherwise("b"))


def win_edges(paired: DataFrame) -> DataFrame:
    """(winner, loser, weight): a tie is half a win for both."""
    won = paired.select(F.explode(F.array(F.struct(F.col("method_a").alias("winner"), F.col("method_b").alias("loser"), F.when(F.col("winner") == "a", 1.0).when(F.col("winner") == "tie", 0.5).otherwise(0.0).alias("weight")), F.struct(F.col("method_b").alias("winner"), F.col("method_a").alias("loser"), F.when(F.col("winner") == "b", 1.0).when(F.col("winner") == "tie", 0.5).otherwise(0.0).alias("weight")))).alias("e"))
    return won.groupBy("e.winner", "e.loser").agg(F.sum("e.weight").alias("weight"))
