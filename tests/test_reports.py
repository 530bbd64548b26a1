import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lodestone.operators import reports as rep
from lodestone.queries.base import rounded
from lodestone.sources import labels


@pytest.mark.parametrize("path", ["../x", "a/../../x", "/etc/passwd", "a\\..\\x", "a\x00b"])
def test_paths_that_leave_the_base(path):
    with pytest.raises(ValueError):
        rep.confined(path, "/data")


def test_paths_under_the_base():
    assert rep.confined("a/../b/c.png", "/data/sets") == "/data/sets/b/c.png" and rep.confined("", "/data") == "/data"


def test_comparison_needs_every_arm(spark):
    rows = [("d1", "a", "default", 0.5), ("d1", "a", "tuned", 0.75), ("d1", "b", "default", 0.25), ("d1", "b", "tuned", 0.5)]
    results = spark.createDataFrame(rows, "dataset string, arm string, setting string, f1 double")
    datasets = spark.createDataFrame([("d1",)], "dataset string")
    assert sorted(tuple(r) for r in rep.arm_comparison(results, datasets, ["a", "b"]).collect()) == [("d1", "a", 0.5, 0.75, 0.25), ("d1", "b", 0.25, 0.5, 0.25)]
    for broken in (results.where("arm = 'a' OR setting = 'tuned'"), results.withColumn("f1", F.when(F.col("f1") != 0.75, F.col("f1")))):
        with pytest.raises(PySparkException, match="no (default|tuned) F1"):
            rep.arm_comparison(broken, datasets, ["a", "b"]).collect()


def test_bands_gaps_and_canvases(spark):
    one = spark.createDataFrame([("m", "large", 1, 2), ("m", "small", 1, 4), ("n", "large", 1, 1)], "method string, bucket string, found int, n int")
    assert {r.method: (r.gap, r.widest, r.narrowest) for r in rep.size_gap(one).collect()} == {"m": (0.25, True, True), "n": (None, False, False)}
    canvases = spark.createDataFrame([("m", "1280x720", 4.0), ("m", "640x480", 1.0), ("m", "bad", 9.0), ("m", None, 9.0), ("m", "x", 9.0)], "method string, canvas_size string, latency_ms double")
    assert {(r.canvas_size, r.place) for r in rep.latency_by_canvas(canvases).collect()} == {("640x480", 1), ("1280x720", 2)}


def test_results_files(spark, tmp_path):
    (tmp_path / "results.json").write_text(json.dumps({"run": 1, "methods": {"ncc": {"per_image": [{"image_id": "a", "tp": 1, "f1": 0.5}, {"image_id": "b"}]}, "mosse": {"per_image": []}}}))
    assert sorted((r.method, r.image_id, r.tp, r.f1) for r in labels.run_results(spark, str(tmp_path / "results.json")).collect()) == [("ncc", "a", 1, 0.5), ("ncc", "b", None, None)]


def test_rounding_is_binary(spark):
    df = spark.createDataFrame([(0.0000005,), (-0.5046875,), (1e300,), (float("inf"),), (None,), (2.5e-7,)], "x double")
    want = [r.x if r.x is None or abs(r.x) > 1e9 else (1 if r.x > 0 else -1) * int(abs(r.x) * 1e6 + 0.5) / 1e6 for r in df.collect()]
    assert [r.y for r in df.select(rounded(F.col("x")).alias("y")).collect()] == want
