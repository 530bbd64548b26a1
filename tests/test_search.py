"""Peak strategies, proposals, assignment, splits by strategy, sweeps and the command line."""

import itertools

import numpy as np
import pytest

from lodestone import __main__ as command
from lodestone import catalog
from lodestone.operators import hough, peaks, splits, training
from lodestone.operators import proposals as prop
from lodestone.plans import search, sweeps
from lodestone.plans.registry import InvalidConfig

SF = "/root/testdata/sf0.001"


def maps(spark, images):
    rows = [(i, y, x, float(v)) for i, m in images.items() for (y, x), v in np.ndenumerate(np.asarray(m, float))]
    return spark.createDataFrame(rows, "image_id bigint, y int, x int, v double")


def blobs(*centres, shape=(20, 30), radius=4):
    y, x = np.mgrid[: shape[0], : shape[1]]
    return np.maximum.reduce([np.clip(radius + 1 - np.hypot(y - cy, x - cx), 0, None) for cy, cx in centres])


def test_strategies_of_several_images(spark):
    cells = maps(spark, {1: blobs((8, 8), (8, 14)), 2: blobs((10, 20)), 3: np.zeros((20, 30))})
    for strategy, first in (("local-max", [(8, 8), (8, 14)]), ("watershed", [(8, 8), (8, 14)]), ("nms", [(8, 8)])):
        found = {}
        for r in peaks.extract(cells, strategy, 10, 10, 0.5, threshold=0.1).collect():
            found.setdefault(r.image_id, []).append((r.y, r.x))
        assert set(first) <= set(found[1]) and (10, 20) in found[2] and 3 not in found
    assert peaks.extract(cells, "local-max", 10, 10, 0.5, most=1).count() == 2
    with pytest.raises(ValueError):
        peaks.extract(cells, "other", 10, 10, 0.5)


def test_map_without_background_is_one_region(spark):
    cells = maps(spark, {1: [[5, 6, 7], [5, 9, 5]]})
    assert [(r.y, r.x, r.v) for r in peaks.extract(cells, "watershed", 3, 3, 1.0).collect()] == [(1, 1, 9.0)]


def test_distance_equals_plain_search(spark):
    rng = np.random.default_rng(3)
    m = rng.integers(0, 4, (12, 15))
    back = np.argwhere(m <= 0)
    for r in peaks.background_distance(maps(spark, {1: m}), 0.0).collect():
        assert r.d2 == min((r.y - y) ** 2 + (r.x - x) ** 2 for y, x in back)


def test_decoded_proposals_stay_in_the_image(spark):
    rows = [(1, 0, 50.0, 50.0, 20.0, 20.0, 0.9), (1, 1, 51.0, 50.0, 20.0, 20.0, 0.8), (1, 2, 2.0, 2.0, 3.0, 3.0, 0.7), (1, 3, 80.0, 80.0, 60.0, 60.0, 0.6), (1, 4, 20.0, 80.0, 9.0, 9.0, 0.4), (1, 5, 20.0, 80.0, 9.0, 9.0, None)]
    anchors = spark.createDataFrame(rows, "image_id bigint, pid bigint, cx double, cy double, w double, h double, score double")
    from pyspark.sql import functions as F

    fit = F.struct(F.lit(0.5).alias("scale"), F.lit(10.0).alias("pad_x"), F.lit(5.0).alias("pad_y"))
    got = {r.pid: (r.x, r.y, r.w, r.h) for r in prop.decoded(anchors, fit, F.lit(180), F.lit(180), 0.4, 0.5).collect()}
    assert got == {0: (60, 70, 40, 40), 3: (80, 90, 100, 90)}  # 1 is suppressed, 2 lies in the padding, 4 is not above 0.4


def test_subject_and_its_parts(spark):
    rows = [(1, 0, 0, 10, 100, 50, 0.9), (1, 1, 30, 30, 30, 30, 0.9), (1, 2, 61, 30, 20, 20, 0.8), (1, 3, 32, 32, 26, 26, 0.8), (1, 4, 61, 52, 20, 5, 0.4), (2, 0, 0, 0, 100, 100, 0.5)]
    df = spark.createDataFrame(rows, "image_id bigint, pid bigint, x int, y int, w int, h int, score double")
    chosen = prop.subjects(df, 100, 100)
    assert {(r.image_id, r.pid) for r in chosen.collect()} == {(1, 1), (2, 0)}
    assert [(r.image_id, r.pid) for r in prop.merge_partners(chosen, df, 100, 100).collect()] == [(1, 2)]


def test_detection_assignment_is_cheapest(spark):
    rng = np.random.default_rng(5)
    preds = [(i, p, [float(a) for a in rng.normal(size=3)], *map(float, rng.uniform(0.2, 0.8, 2)), *map(float, rng.uniform(0.1, 0.3, 2))) for i in range(6) for p in range(2 + i % 4)]
    truths = [(i, g, int(rng.integers(3)), *map(float, rng.uniform(0.2, 0.8, 2)), *map(float, rng.uniform(0.1, 0.3, 2))) for i in range(6) for g in range(1 + i % 5)]
    costs = training.detection_costs(
        spark.createDataFrame(preds, "image_id bigint, pid bigint, logits array<double>, cx double, cy double, w double, h double"),
        spark.createDataFrame(truths, "image_id bigint, gid bigint, label int, cx double, cy double, w double, h double"),
    )
    table = {}
    for r in costs.collect():
        table.setdefault(r.image_id, {})[r.gid, r.pid] = r.cost
    got = {}
    for r in training.cheapest_pairs(costs).collect():
        got.setdefault(r.image_id, []).append((r.gid, r.pid))
    for i, cost in table.items():
        g, p = sorted({k[0] for k in cost}), sorted({k[1] for k in cost})
        pairs = [list(zip(g, q)) for q in itertools.permutations(p, len(g))] if len(g) <= len(p) else [list(zip(q, p)) for q in itertools.permutations(g, len(p))]
        assert sum(cost[k] for k in got[i]) == pytest.approx(min(sum(cost[k] for k in pair) for pair in pairs))


def test_mirrored_correspondences_give_no_instance(spark):
    rng = np.random.default_rng(1)
    z = rng.uniform(0, 40, 12) + 1j * rng.uniform(0, 40, 12)
    for mirrored in (False, True):
        w = (1.2 + 0.3j) * (z.conj() if mirrored else z) + 80 + 90j
        rows = [(1, k, float(a.real), float(a.imag), float(b.real), float(b.imag), 1.0, 1.0, 0.0, 0.0) for k, (a, b) in enumerate(zip(z, w))]
        c = spark.createDataFrame(rows, "image_id bigint, vid bigint, crop_x double, crop_y double, scene_x double, scene_y double, crop_scale double, scene_scale double, crop_angle double, scene_angle double")
        (model,) = hough.ransac(c).collect()
        assert model.mirrored is mirrored and model.inliers == 12
        found = search.sparse_geo(c, search.SparseGeometry(decomposition="sequential-ransac")).count()
        assert found == (0 if mirrored else 1)


def test_configurations_that_contradict_themselves():
    assert search.SparseGeometry().voting == "single-4dof" and search.SparseGeometry(keypoints="superpoint").voting == "translation-2dof"
    with pytest.raises(InvalidConfig):
        search.SparseGeometry(keypoints="superpoint", voting="single-4dof")
    with pytest.raises(InvalidConfig):
        search.Tokens(side=100)
    assert search.Tokens(side=98).side == 98


def test_splits_by_strategy(spark):
    rows = [(d, i, s) for d in ("a", "b", "c") for i, s in enumerate(["train"] * 20 + ["val"] * 5 + ["test"] * 5)]
    df = spark.createDataFrame(rows, "dataset string, image_id bigint, split string")
    count = lambda seed: {(r.dataset, r.split): r["count"] for r in splits.by_strategy(df, {"a": "native", "b": "test-only"}, 0.25, seed).groupBy("dataset", "split").count().collect()}
    assert count(1) == count(2) == {("a", "train"): 20, ("a", "val"): 5, ("a", "test"): 5, ("b", "test"): 5, ("c", "train"): 15, ("c", "val"): 5, ("c", "test"): 5}
    with pytest.raises(ValueError):
        splits.by_strategy(df, {"a": "none"}, 0.25, 1)


def test_sweep_settings(spark):
    found = sweeps.grid(spark, {"threshold": [0.5, 0.7], "nms_iou": [0.1, 0.2, 0.3]})
    assert [tuple(r) for r in found.orderBy("trial").collect()][:4] == [(0, 0.5, 0.1), (1, 0.5, 0.2), (2, 0.5, 0.3), (3, 0.7, 0.1)]
    assert [(c.threshold, c.nms_iou) for c in sweeps.checked("ncc", found)][-1] == (0.7, 0.3)
    with pytest.raises(InvalidConfig):
        sweeps.checked("ncc", sweeps.grid(spark, {"nms_iou": [2.0]}))
    with pytest.raises(ValueError):
        sweeps.checked("ncc", found, bound=5)


def test_command_line(spark, tmp_path, capsys):
    assert command.main(["list"]) == 0 and set(catalog.QUERIES) <= set(capsys.readouterr().out.split())
    assert command.main(["run", "sweep_grid", SF, str(tmp_path / "out")]) == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == 12
