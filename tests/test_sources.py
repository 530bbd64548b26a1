"""Label trees, the store's batches and versions, synthetic scenes and the correlation of proposals."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import dense
from lodestone.sources import labels, synthetic
from lodestone.sources.sinks import Store


def test_text_tree_leaves_out_images_with_bad_lines(spark, tmp_path):
    for part, files in {"train": {"a": "1 2 5 6\n3 3 9 9\n", "b": "1 2 5 6\n9 9 3 3\n"}, "val": {"c": "0 0 4 4\n\n", "d": "x 1 2 3\n"}}.items():
        folder = tmp_path / part / "labels"
        folder.mkdir(parents=True)
        for name, text in files.items():
            (folder / f"{name}.txt").write_text(text)
    got = labels.text_tree(spark, str(tmp_path), {"train": "train", "val": "test"}).collect()
    assert {(r.split, r.image_id, r.gid, r.x, r.y, r.w, r.h) for r in got} == {("train", "a", 0, 1, 2, 4, 4), ("train", "a", 1, 3, 3, 6, 6), ("test", "c", 0, 0, 0, 4, 4)}


def test_coco_tree(spark, tmp_path):
    doc = {"images": [{"id": 1, "file_name": "s.png", "width": 50, "height": 40}], "categories": [{"id": 1, "name": "door"}, {"id": 2, "name": "bed"}], "annotations": [{"id": 1, "image_id": 1, "category_id": 1, "bbox": [1, 2, 3, 4]}, {"id": 2, "image_id": 1, "category_id": 2, "bbox": [5, 5, 6, 6]}, {"id": 3, "image_id": 1, "category_id": 1, "bbox": [5, 5, 0, 6]}]}
    for name in ("v", "t"):
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    files = {"val": str(tmp_path / "v.json"), "test": str(tmp_path / "t.json")}
    assert labels.coco_tree(spark, files).count() == 4
    assert {(r.split, r.x, r.w) for r in labels.coco_tree(spark, files, "door").collect()} == {("val", 1, 3), ("test", 1, 3)}


def test_batches_show_together(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = spark.createDataFrame([(1, "a")], "run_id bigint, method string")
    store.insert({"runs": rows, "matches": rows.select("run_id")})
    rows.withColumn("run_id", F.lit(2).cast("bigint")).write.parquet(str(tmp_path / "runs" / "batch=0ff"))  # a writer that ended early
    assert [r.run_id for r in store.inserted("runs").collect()] == [1]
    store.insert({"runs": rows, "matches": rows.select("run_id")})
    assert store.inserted("runs").count() == store.inserted("matches").count() == 2


def test_migrations(spark, tmp_path):
    store, done = Store(spark, str(tmp_path)), []

    def broken(_):
        raise OSError("no room")

    assert store.version() == 0
    assert store.migrate({1: lambda s: done.append(1)}) == 1
    with pytest.raises(OSError):
        store.migrate({1: lambda s: done.append(1), 2: lambda s: done.append(2), 3: broken})
    assert store.version() == 2
    assert store.migrate({1: broken, 2: broken, 3: lambda s: done.append(3)}, {"seven": lambda s: s.spark.range(7)}) == 3
    assert done == [1, 2, 3] and spark.table("seven").count() == 7
    with pytest.raises(RuntimeError):
        store.migrate({1: broken})


def test_scenes_have_exact_boxes(spark):
    rows = [(1, 5, 90, 60, "lattice", 6, 12, 0.2, 0, 50.0), (2, 6, 90, 60, "scatter", 5, 11, 0.0, 2, 0.0), (3, 7, 20, 20, "scatter", 9, 12, 0.0, 0, 0.0), (4, 8, 30, 30, "lattice", 0, 9, 0.0, 0, 0.0)]
    found = {r.image_id: r for r in synthetic.scenes(spark.createDataFrame(rows, synthetic.SPEC)).collect()}
    assert [found[i].achieved_n for i in (1, 2, 4)] == [6, 5, 0] and 1 <= found[3].achieved_n < 9
    for r in found.values():
        pixels, inside = np.asarray(r.pixels).reshape(r.height, r.width), np.zeros((r.height, r.width), bool)
        for b in r.boxes:
            part = pixels[b.y : b.y + b.h, b.x : b.x + b.w] == 255
            assert part.any(0).all() and part.any(1).all()
            inside[b.y : b.y + b.h, b.x : b.x + b.w] = True
        assert not (pixels[~inside] == 255).any()
    again = {r.image_id: r for r in synthetic.scenes(spark.createDataFrame(rows, synthetic.SPEC)).collect()}
    assert again == found


def test_proposals_over_copies_score_higher(spark):
    rng = np.random.default_rng(4)
    scene, patch = rng.uniform(0, 40, (60, 80)), rng.uniform(0, 255, (12, 12))
    scene[5:17, 6:18] = scene[30:42, 50:62] = patch
    images = spark.createDataFrame([(1, 60, 80, scene.ravel().tolist(), 6, 5, 12, 12)], "image_id bigint, height int, width int, pixels array<double>, ex int, ey int, ew int, eh int")
    boxes = spark.createDataFrame([(1, 0, 50, 30, 12, 12), (1, 1, 20, 40, 12, 12), (1, 2, 50, 30, 5, 5), (1, 3, 75, 55, 12, 12)], "image_id bigint, pid bigint, x int, y int, w int, h int")
    got = {r.pid: r.score for r in dense.rescored(images, boxes).collect()}
    assert got[0] > 0.99 and got[1] < 0.7 and got[2] == got[3] == -1.0
