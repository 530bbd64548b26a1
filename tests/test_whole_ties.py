"""Boxes of one corner and one score go by their key, whatever their sides."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import folds
from lodestone.operators import evaluation
from lodestone.operators import proposals as prop

BOX = "image_id int, pid bigint, x int, y int, w int, h int, score double"


@pytest.fixture
def tied(spark):
    return spark.createDataFrame([(1, 1, 5, 5, 10, 10, 0.5), (1, 0, 5, 5, 15, 10, 0.5)], BOX)


@pytest.fixture
def truth(spark):
    return spark.createDataFrame([(1, 0, 5, 5, 10, 10)], "image_id int, gid bigint, x int, y int, w int, h int")


def test_suppression_keeps_the_first_key(tied):
    assert [(r.pid, r.w) for r in folds.nms(tied, ["image_id"], 0.3).collect()] == [(0, 15)]


def test_fusion_keeps_the_first_key(tied):
    kept = evaluation.fuse([tied, tied.withColumns({"x": F.lit(90), "pid": F.col("pid") + 5})]).collect()
    assert {r.pid for r in kept} == {0, 11}


def test_decoded_proposals_keep_the_first_key(tied):
    anchors = tied.select("image_id", "pid", (F.col("x") + F.col("w") / 2).alias("cx"), (F.col("y") + F.col("h") / 2).alias("cy"), F.col("w").cast("double").alias("w"), F.col("h").cast("double").alias("h"), "score")
    fit = F.struct(F.lit(1.0).alias("scale"), F.lit(0.0).alias("pad_x"), F.lit(0.0).alias("pad_y"))
    assert [(r.pid, r.w) for r in prop.decoded(anchors, fit, F.lit(50), F.lit(50), 0.1, 0.4).collect()] == [(0, 15)]


def test_the_first_key_takes_the_truth(tied, truth):
    assert {r.pid: r.gid for r in evaluation.match_flags(tied, truth).collect()} == {0: 0, 1: None}


def test_overlay_marks_the_first_key(tied, truth):
    assert {(r.kind, r.id) for r in evaluation.labelled_overlay(tied, truth).collect()} == {("TP", 0), ("FP", 1)}


def test_curve_ranks_and_flags_in_one_order(tied, truth):
    assert [(r["rank"], r.tp, r.precision) for r in evaluation.pr_curve(tied, truth).orderBy("rank").collect()] == [(1, 1, 1.0), (2, 1, 0.5)]
