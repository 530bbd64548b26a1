import pytest

from lodestone.operators import hough
from lodestone.plans import search

FIELDS = "image_id bigint, vid bigint, crop_x double, crop_y double, scene_x double, scene_y double"


def test_pairs_of_all_correspondences(spark):
    rows = [(k, i, float(i % 17), float(i // 17), float(i % 17 + 5), float(i // 17 + 9)) for k, n in ((1, 100), (2, 400)) for i in range(n)]
    got = hough.pairwise_votes(spark.createDataFrame(rows, FIELDS), 0.0, 0.0).select("image_id", "vid_a", "vid_b").collect()
    of = lambda k: {(r.vid_a, r.vid_b) for r in got if r.image_id == k}
    assert of(1) == {(i, j) for j in range(100) for i in range(j)}
    assert len(of(2)) == 20_000 == sum(r.image_id == 2 for r in got) and all(a < b for a, b in of(2)) and max(b for _, b in of(2)) > 390


def test_more_than_64_instances(spark):
    # 70 copies of a crop of 6 points, each moved far from the others; samples find them one after the other
    shape = [(0, 0), (30, 0), (0, 30), (30, 30), (15, 7), (7, 22)]
    rows = [(1, k * 6 + i, float(x), float(y), float(x + 1000 * k), float(y + 700 * (k * k % 71))) for k in range(70) for i, (x, y) in enumerate(shape)]
    found = hough.ransac(spark.createDataFrame(rows, FIELDS), tries=20_000).collect()
    assert len(found) == 70


@pytest.mark.parametrize("voting", ["single-4dof", "translation-2dof", "pairwise-4dof"])
def test_sparse_geometry_finds_instances_by_peaks(spark, voting):
    shape = [(x, y) for x in range(2, 40, 7) for y in range(2, 40, 7)]  # soft bins part a vote up to 16 ways
    n = 30 if voting != "pairwise-4dof" else 4  # two of 1,080 points are seldom of one instance
    rows = [(1, k * 36 + i, float(x), float(y), float(x + 1000 * k + 7), float(y + 700 * (k * k % 31) + 7), 1.0, 1.0, 0.0, 0.0) for k in range(n) for i, (x, y) in enumerate(shape)]
    df = spark.createDataFrame(rows, FIELDS + ", crop_scale double, scene_scale double, crop_angle double, scene_angle double")
    got = search.sparse_geo(df, search.SparseGeometry(voting=voting)).collect()
    assert {(r.x, r.y) for r in got} >= {(1000 * k + 7, 700 * (k * k % 31) + 7) for k in range(n)}
