"""The searches: correlation on pixel arrays, votes of keypoints, tokens, patches, proposals; and the exploration by markers.

Pixels, tokens and embeddings come as tables, as no image decoder or network weights are assumed. Each plan returns
(image_id, idx, x, y, w, h, score); a search that finds nothing returns no rows, which is an abstention.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import folds
from lodestone.functions.geometry import affine_hull
from lodestone.functions.vectors import cosine
from lodestone.operators import calibration, dense, hough, markers, similarity
from lodestone.plans.registry import InvalidConfig, register


def numbered(kept: DataFrame) -> DataFrame:
    order = W.partitionBy("image_id").orderBy(F.col("score").desc(), "y", "x", "pid")
    return kept.select("image_id", (F.row_number().over(order) - 1).alias("idx"), "x", "y", "w", "h", "score")


@dataclass(frozen=True)
class Correlation:
    threshold: float = 0.7
    nms_iou: float = 0.3
    scales: tuple = (0.75, 0.875, 1.0, 1.15, 1.3)
    angles: tuple = (-35, -23.3, -11.7, 0, 11.7, 23.3, 35)

    def __post_init__(self):
        if not 0 <= self.nms_iou <= 1:
            raise InvalidConfig([("nms_iou", "must lie between 0 and 1")])


@register("ncc", "normalised cross-correlation over scales and turns", "1", Correlation)
def ncc(images: DataFrame, config: Correlation) -> DataFrame:
    found = dense.search_arrays(images, "ncc", config.scales, config.angles).where(F.col("score") > config.threshold)
    return numbered(folds.nms(found, ["image_id"], config.nms_iou))


@register("mosse", "closed-form correlation filter", "1", Correlation)
def mosse(images: DataFrame, config: Correlation) -> DataFrame:
    found = dense.search_arrays(images, "mosse", config.scales, config.angles).where(F.col("score") > config.threshold)
    return numbered(folds.nms(found, ["image_id"], config.nms_iou))


@dataclass(frozen=True)
class SparseGeometry:
    pixels: float = 3.0
    inliers: int = 5
    nms_iou: float = 0.4
    crop_w: float = 40.0
    crop_h: float = 40.0
    width: int = 100_000
    height: int = 100_000
    decomposition: str = "hough"
    keypoints: str = "sift"
    voting: str | None = None  # single-4dof, but translation-2dof for keypoints without scale and angle
    min_votes: float = 2.0
    pairwise_cap: int = 20_000

    def __post_init__(self):
        if self.decomposition not in ("hough", "sequential-ransac"):
            raise InvalidConfig([("decomposition", "must be hough or sequential-ransac")])
        if self.keypoints not in ("sift", "superpoint"):
            raise InvalidConfig([("keypoints", "must be sift or superpoint")])
        bare = self.keypoints == "superpoint"
        if self.voting is None:
            object.__setattr__(self, "voting", "translation-2dof" if bare else "single-4dof")
        if bare and self.voting == "single-4dof":
            raise InvalidConfig([("voting", "superpoint has no scale and angle for single-4dof")])
        if self.voting not in ("single-4dof", "translation-2dof", "pairwise-4dof"):
            raise InvalidConfig([("voting", "must be single-4dof, translation-2dof or pairwise-4dof")])


@register("sparse-geo", "keypoint correspondences verified by sampled similarities", "1", SparseGeometry)
def sparse_geo(correspondences: DataFrame, config: SparseGeometry) -> DataFrame:
    """Votes, soft bins, peaks and a fit to each peak's correspondences; or fits one after the other over the whole image."""
    c = correspondences
    if config.decomposition == "hough":
        cx, cy = config.crop_w / 2, config.crop_h / 2
        if config.voting == "pairwise-4dof":
            votes = hough.pairwise_votes(c, cx, cy, config.pairwise_cap).withColumn("pair", F.array("vid_a", "vid_b"))
            hist = hough.histogram(votes, max(config.crop_w, config.crop_h), "pair").withColumn("members", F.array_distinct(F.flatten("members")))
        else:
            votes = hough.single_votes(c, cx, cy) if config.voting == "single-4dof" else hough.translation_votes(c, cx, cy)
            hist = hough.histogram(votes, max(config.crop_w, config.crop_h))
        c = hough.of_peaks(c, hist, hough.peaks(hist, config.min_votes))
    models = hough.ransac(c, config.pixels, least=config.inliers)
    m = hough.similarity_matrix()
    fitted = models.withColumn("box", affine_hull(m, F.lit(config.crop_w), F.lit(config.crop_h), F.lit(config.width), F.lit(config.height)))
    boxes = fitted.where(hough.verdict(m, F.col("inliers"), F.col("box"), config.inliers) == "instance")
    return numbered(folds.nms(boxes.select("image_id", F.col("instance").cast("bigint").alias("pid"), "box.*", F.col("inliers").cast("double").alias("score")), ["image_id"], config.nms_iou))


@dataclass(frozen=True)
class Retrieval:
    floor: float = 0.7
    nms_iou: float = 0.3


@register("propose-retrieve", "proposals by likeness to the exemplar", "1", Retrieval)
def propose_retrieve(regions: DataFrame, exemplar: DataFrame, config: Retrieval) -> DataFrame:
    return similarity.retrieve(regions, exemplar, config.floor, config.nms_iou).select("image_id", "idx", "x", "y", "w", "h", "score")


@register("owlv2-oneshot", "patches by calibrated likeness to the query patch", "1", Retrieval)
def one_shot(patches: DataFrame, exemplar: DataFrame, config: Retrieval) -> DataFrame:
    """patches also hold shift and scale; the cut is 0.85 of the image's best score."""
    q = F.broadcast(exemplar.select("qv").limit(1))
    scored = patches.join(q).withColumn("score", F.round((cosine(F.col("v"), F.col("qv")) + F.col("shift")) * F.col("scale"), 9))
    cut = scored.groupBy("image_id").agg(calibration.self_similarity(F.max("score")).alias("cut"))
    return numbered(folds.nms(scored.join(cut, "image_id").where(F.col("score") > F.col("cut")), ["image_id"], config.nms_iou))


@dataclass(frozen=True)
class Tokens:
    cut: float = 0.5
    neighbours: int = 3
    side: int | None = None  # of the square that scenes are fitted into

    def __post_init__(self):
        if self.side is not None and (self.side <= 0 or self.side % 14):
            raise InvalidConfig([("side", "must be a multiple of 14")])


@register("dino-dense", "connected components of the token likeness map", "1", Tokens)
def dense_tokens(tokens: DataFrame, crop: DataFrame, config: Tokens) -> DataFrame:
    """One scene's tokens (id, y, x, v) and the crop's (v)."""
    cells = similarity.max_token_map(tokens, crop, config.neighbours).join(tokens.select("id", "y", "x"), "id").select("y", "x", F.col("score").alias("v"))
    found = dense.components(cells, config.cut).select(F.lit(0).cast("bigint").alias("image_id"), F.col("label").alias("pid"), "x", "y", "w", "h", F.col("top").alias("score"))
    return numbered(found)


@dataclass(frozen=True)
class MarkerSearch:
    length: float = 80.0


@register("marker-conditioned", "the object that each marker points at", "1", MarkerSearch, kind="exploration")
def marker_conditioned(found: DataFrame, proposals: DataFrame, config: MarkerSearch) -> DataFrame:
    best = markers.best_proposals(found, proposals, config.length)
    return best.join(proposals.select("image_id", "pid", "x", "y", "w", "h"), ["image_id", "pid"]).select("image_id", F.col("marker_id").alias("idx"), "x", "y", "w", "h", "score")


@dataclass(frozen=True)
class SameImage:
    method: str = "propose-retrieve"


@register("same-image", "a method on the exemplar's own image", "1", SameImage, kind="exploration")
def same_image(*inputs: DataFrame, config: SameImage, **options) -> DataFrame:
    from lodestone.plans.registry import configured, get

    return get(config.method).run(*inputs, config=configured(config.method, options))
