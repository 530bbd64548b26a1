"""Hand-computed cases, determinism and a few queries against their SQL."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone import catalog
from lodestone.functions import folds, geometry, rates
from lodestone.functions.vectors import cosine, fnv1a, hamming
from lodestone.operators import calibration, dense, evaluation, hough, ranking, similarity, splits, store, training
from lodestone.plans import registry, search
from lodestone.sources import labels, sinks
from lodestone.streaming import monitor

SF = "/root/testdata/sf0.001"
BOX = "image_id int, pid bigint, x int, y int, w int, h int, score double"
TRUTH = "image_id int, gid bigint, x int, y int, w int, h int"


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


def lit_box(x, y, w, h):
    return F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(w).alias("w"), F.lit(h).alias("h"))


def test_touching_boxes_do_not_overlap(spark):
    assert one(spark, geometry.iou(lit_box(0, 0, 10, 10), lit_box(10, 0, 10, 10))) == 0.0
    assert one(spark, geometry.iou(lit_box(0, 0, 10, 10), lit_box(0, 0, 10, 5))) == 0.5
    assert one(spark, geometry.giou(lit_box(0, 0, 10, 10), lit_box(10, 0, 10, 10))) == 0.0


def test_clip_and_tiles(spark):
    assert one(spark, geometry.clip(lit_box(-5, -5, 3, 3), F.lit(10), F.lit(10))) is None
    assert tuple(one(spark, geometry.clip(lit_box(-5, 2, 20, 3), F.lit(10), F.lit(10)))) == (0, 2, 10, 3)
    assert [tuple(t)[:2] for t in one(spark, geometry.tiles(F.lit(100), F.lit(50), 50, 0.2))] == [(0, 0), (40, 0), (50, 0)]


def test_buckets(spark):
    assert one(spark, geometry.resolution_bucket(F.lit("640x"))) is None
    assert one(spark, geometry.resolution_bucket(F.lit("6000x4000"))) == "large"
    assert one(spark, geometry.crowding_bucket(F.lit(None).cast("int"))) is None


def test_suppression_keeps_equal_overlap_and_any_order(spark):
    rows = [(1, 0, 0, 0, 10, 10, 0.9), (1, 1, 0, 0, 10, 5, 0.8), (1, 2, 1, 0, 10, 10, 0.7), (1, 3, 50, 50, 5, 5, 0.9)]
    for some in (rows, rows[::-1]):
        kept = folds.nms(spark.createDataFrame(some, BOX), ["image_id"], 0.5)
        assert sorted(r.pid for r in kept.collect()) == [0, 1, 3]


def test_a_truth_is_taken_once_and_by_the_larger_overlap(spark):
    preds = spark.createDataFrame([(1, 0, 0, 0, 10, 10, 0.9), (1, 1, 0, 0, 10, 10, 0.8), (2, 0, 2, 0, 10, 10, 0.5)], BOX)
    truths = spark.createDataFrame([(1, 0, 0, 0, 10, 10), (2, 0, 0, 0, 10, 10), (2, 1, 1, 0, 10, 10), (3, 0, 0, 0, 5, 5)], TRUTH)
    counts = {r.image_id: (r.tp, r.fp, r.fn) for r in evaluation.match_counts(preds, truths).collect()}
    assert counts == {1: (1, 1, 0), 2: (1, 0, 1), 3: (0, 0, 1)}
    assert [r.gid for r in evaluation.match_flags(preds, truths).where("image_id = 2").collect()] == [1]
    ap = {r.image_id: r.ap for r in evaluation.average_precision(preds, truths).collect()}
    assert ap == {1: 1.0, 2: 0.5, 3: 0.0}
    coco = {r.image_id: (r.ap50, r.ap) for r in evaluation.coco_ap(preds, truths).collect()}
    assert coco[1] == (1.0, 1.0) and coco[3] == (0.0, 0.0)


def test_unassessed_is_not_zero(spark):
    p = spark.createDataFrame([(0, 0, 0), (0, 0, 3), (2, 1, 1)], "tp int, fp int, fn int")
    rows = evaluation.prf(p).collect()
    assert [r.precision for r in rows] == [None, None, 2 / 3]
    assert [r.recall for r in rows] == [None, 0.0, 2 / 3]
    assert [r.f1_strict for r in rows] == [None, None, pytest.approx(2 / 3)]
    assert [r.f1_dice for r in rows] == [None, 0.0, pytest.approx(2 / 3)]


def test_counting_errors(spark):
    df = spark.createDataFrame([("a", 3, 2), ("a", 5, 0), ("b", 2, 0)], "g string, predicted_count int, true_count int")
    r = {x.g: x for x in evaluation.counting_errors(df, ["g"]).collect()}
    assert (r["a"].mae, r["a"].nae, r["b"].nae) == (3.0, 0.5, 0.0)
    assert r["a"].rmse == pytest.approx(math.sqrt(13))


@pytest.mark.parametrize(("s", "n", "low", "high"), [(0, 10, 0.0, 0.2775), (10, 10, 0.7225, 1.0), (1, 1, 0.2065, 1.0)])
def test_wilson(spark, s, n, low, high):
    w = one(spark, rates.wilson(F.lit(s), F.lit(n)))
    assert (round(w.low, 4), round(w.high, 4)) == (low, high)
    assert one(spark, rates.wilson(F.lit(0), F.lit(0))) is None


def test_bradley_terry(spark):
    edges = spark.createDataFrame([("a", "b", 5.0), ("b", "c", 3.0)], "winner string, loser string, weight double")
    rows = ranking.bradley_terry(edges).orderBy("rank").collect()
    assert [r.method for r in rows] == ["a", "b", "c"]
    assert math.prod(r.strength for r in rows) == pytest.approx(1.0) and all(math.isfinite(r.stderr) for r in rows)
    assert not ranking.strongly_connected(edges).first().connected
    cycle = edges.union(spark.createDataFrame([("c", "a", 1.0)], edges.schema))
    assert ranking.strongly_connected(cycle).first().connected


def test_largest_gap(spark):
    df = spark.createDataFrame([("a", 0.9, 1), ("a", 0.8, 2), ("a", 0.3, 3), ("b", 0.4, 1)], "g string, score double, key int")
    r = {x.g: x.threshold for x in calibration.largest_gap(df, ["g"]).collect()}
    assert r == {"a": pytest.approx(0.55), "b": pytest.approx(0.4 - 1e-9)}
    with pytest.raises(Exception, match="self_score"):
        spark.range(1).select(calibration.self_similarity(F.lit(None).cast("double"))).collect()


def test_gmm(spark):
    df = spark.createDataFrame([("two", x / 100) for x in (10, 11, 12, 13, 80, 81, 82, 83)] + [("one", 0.5)] * 5, "g string, score double")
    r = {x.g: x for x in calibration.gmm(df, ["g"], "g string").collect()}
    assert 0.13 < r["two"].threshold < 0.8 and not r["two"].degenerate and r["one"].degenerate


def test_vectors(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(2.0))
    assert one(spark, cosine(a, b)) == 0.0
    assert one(spark, hamming(F.array(F.lit(7)), F.array(F.lit(0)))) == 3
    assert one(spark, fnv1a(F.lit("rpine-1"))) == 76531697
    assert one(spark, fnv1a(F.lit(""))) == 2166136261


def test_ransac_finds_planted_similarity(spark):
    rows = [(1, i, float(i * 7 % 30), float(i * 11 % 30), 2.0 * (i * 7 % 30) + 5, 2.0 * (i * 11 % 30) + 9) for i in range(12)] + [(1, 20 + i, float(i), float(i), 900.0 + 70 * i, 13.0 * i * i) for i in range(3)]
    df = spark.createDataFrame(rows, "image_id bigint, vid bigint, crop_x double, crop_y double, scene_x double, scene_y double")
    r = hough.ransac(df).collect()
    assert len(r) == 1 and r[0].inliers == 12 and r[0].a == pytest.approx(2.0) and r[0].tx == pytest.approx(5.0)


def test_assignment_is_cheapest(spark):
    import itertools

    import numpy as np

    cost = np.random.default_rng(0).random((4, 6))
    got = cost[np.arange(4), training.assignment(cost)].sum()
    assert got == pytest.approx(min(sum(cost[i, p[i]] for i in range(4)) for p in itertools.permutations(range(6), 4)))


def test_peaks_and_components(spark):
    cells = spark.createDataFrame([(y, x, 9.0 if (y, x) in ((1, 1), (4, 4), (5, 5)) else 0.0) for y in range(7) for x in range(7)], "y int, x int, v double")
    assert sorted((r.y, r.x) for r in dense.local_peaks(cells, 1.0, 1, 1, 3.0).collect()) == [(1, 1), (4, 4)]
    assert sorted(r.area for r in dense.components(cells, 5.0).collect()) == [1, 2]


def test_splits(spark):
    rows = spark.createDataFrame([(1, "a", "train"), (1, "a", "test"), (2, "b", "train"), (3, "b", "val")], "image_id bigint, content string, split string")
    assert [r.image_id for r in splits.leaks(rows).collect()] == [1]
    assert [r.image_id for r in splits.clean(rows).collect()] == [2]
    ids = spark.range(100).select(F.col("id").alias("image_id"))
    a, b = (sorted(r.image_id for r in splits.carve_val(ids.repartition(n), 0.15, 3).where("split = 'val'").collect()) for n in (1, 7))
    assert a == b and len(a) == 15
    boxes = spark.createDataFrame([(1, i, i == 2) for i in range(6)], "image_id int, gid bigint, native boolean")
    few, many = ([r.gid for r in splits.exemplars(boxes, n, 1).orderBy("position").collect()] for n in (2, 4))
    assert few[0] == 2 and many[:2] == few
    with pytest.raises(ValueError, match="1 or more"):
        splits.exemplars(boxes, 0, 1)


def test_diagnostics_cap(spark):
    d = F.struct(F.lit("n").alias("notes"), F.repeat(F.lit("x"), 300000).alias("similarity_heatmap"))
    assert one(spark, store.without_large_heatmap(d)).similarity_heatmap is None


def test_registry(spark):
    assert {"ncc", "mosse", "sparse-geo", "propose-retrieve", "owlv2-oneshot", "dino-dense"} <= {r.name for r in registry.listing(spark, "method").collect()}
    with pytest.raises(registry.UnknownName):
        registry.get("none")
    with pytest.raises(registry.InvalidConfig) as e:
        registry.configured("ncc", {"nms_iou": 0.3, "bad": 1})
    assert e.value.faults == [("bad", "unknown option")]
    with pytest.raises(ValueError, match="already"):
        registry.register("ncc", "", "1", search.Correlation)(search.ncc)


def test_ncc_finds_copies(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    scene, patch = rng.random((60, 60)), rng.random((12, 12)) * 5
    for y, x in ((5, 5), (40, 30)):
        scene[y : y + 12, x : x + 12] = patch
    df = spark.createDataFrame([(1, 60, 60, scene.reshape(-1).tolist(), 5, 5, 12, 12)], "image_id bigint, height int, width int, pixels array<double>, ex int, ey int, ew int, eh int")
    found = search.ncc(df, search.Correlation(threshold=0.95, scales=(1.0,), angles=(0,))).collect()
    assert sorted((r.x, r.y) for r in found) == [(5, 5), (30, 40)]


def test_label_readers(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.gt.json").write_text('{"image": "one.png",\n "spec": {"width": 9, "height": 8}, "boxes": [{"x": 1, "y": 2, "w": 3, "h": 4}], "achieved_n": 1}')
    (tmp_path / "a" / "two.gt.json").write_text('{"image": "two.png", "boxes": [], "achieved_n": 1}')
    rows = {r.image_id: r for r in labels.sidecars(spark, [str(tmp_path / "a")]).collect()}
    assert (rows["one"].width, rows["one"].fault, rows["one"].exemplar_indices) == (9, None, [0]) and rows["two"].fault == "no_boxes"
    assert labels.boxes_of(labels.sidecars(spark, [str(tmp_path / "a")])).count() == 1
    (tmp_path / "cars").mkdir()
    (tmp_path / "cars" / "lot.txt").write_text("1 2 11 22 1\nbad line\n5 5 5 9 1\n")
    assert [tuple(r) for r in labels.car_lines(spark, str(tmp_path / "cars")).collect()] == [("lot", 0, 1, 2, 10, 20)]
    (tmp_path / "c.json").write_text('{"images": [{"id": 1, "file_name": "p.png", "width": 50, "height": 40}], "categories": [{"id": 7, "name": "door"}], "annotations": [{"id": 1, "image_id": 1, "category_id": 7, "bbox": [1.5, 2.4, 3.0, 4.0]}, {"id": 2, "image_id": 1, "category_id": 8, "bbox": [1, 1, 1, 1]}]}')
    assert [tuple(r)[:6] for r in labels.coco(spark, str(tmp_path / "c.json"), "door").collect()] == [("p", 0, 2, 2, 3, 4)]
    (tmp_path / "s.json").write_text('{"dataset": "d", "seed": 1, "val_strategy": "native", "train": ["a"], "val": [], "test": ["b", "c"]}')
    assert sorted(r.image_id for r in labels.split_ids(spark, str(tmp_path / "s.json")).collect()) == ["a", "b", "c"]
    (tmp_path / "d.json").write_text('{"q.jpg": {"box_examples_coordinates": [[[20, 20], [20, 30], [30, 30], [30, 20]]], "points": [[1, 1]], "boxes": [[0, 0, 9, 9], [19, 19, 30, 30]]}}')
    assert labels.dense_counts(spark, str(tmp_path / "d.json")).first().exemplar_indices == [1]


def test_store_sink(spark, tmp_path):
    s = sinks.Store(spark, str(tmp_path))
    for part in (["b", "a"], ["c"]):
        s.append("runs", spark.createDataFrame([(x,) for x in part], "name string"), key="run_id", order="name")
    assert sorted((r.run_id, r.name) for r in s.read("runs").collect()) == [(1, "a"), (2, "b"), (3, "c")]
    assert [r.line for r in sinks.report_rows(spark.createDataFrame([("m", None)], "a string, b double")).collect()] == ["| m | n/a |"]


def test_stream_equals_batch(spark, tmp_path):
    runs = catalog.QUERIES and spark.range(50).select(F.expr("timestamp '2024-01-01' + make_interval(0,0,0,0,id)").alias("created_at"), F.lit("m").alias("method"), F.lit(1.0).alias("preprocess_ms"), F.col("id").cast("double").alias("inference_ms"), F.lit(0.0).alias("postprocess_ms"), F.when(F.col("id") % 7 == 0, "empty").otherwise("ok").alias("outcome"))
    runs.write.parquet(str(tmp_path / "in"))
    q = monitor.windows(spark.readStream.schema(runs.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, monitor.windows(runs).collect()))


def test_retrieval_bound_is_checked(spark):
    assert similarity.small(spark.range(5)).count() == 5


@pytest.mark.parametrize("name", ["scoreboard", "match_counts", "nms", "average_precision", "cosine_topk", "slices_grouping_sets", "hough_histogram"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("orders", "lineitem", "events", "documents", "embeddings", "part", "nation", "supplier"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, SF)
    want = con.execute(catalog.ORACLES[name])
    columns = [c[0] for c in want.description]

    def plain(v):
        return round(float(v), 5) + 0.0 if isinstance(v, float) or type(v).__name__ == "Decimal" else v

    assert sorted(columns) == sorted(got.columns)
    a = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=str)
    assert a == sorted((tuple(plain(v) for v in r) for r in want.fetchall()), key=str)


def test_every_query_has_a_plan(spark):
    for name, q in catalog.QUERIES.items():
        if name not in ("components", "strong_connectivity", "bradley_terry", "win_graph"):
            assert q(spark, SF).columns, name
