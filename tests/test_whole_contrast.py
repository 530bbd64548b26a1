"""Contrast thresholds on the half of a digit go by the order in which scores are added; sums in order say which."""

import random

import duckdb
import numpy as np

from lodestone import catalog
from lodestone.operators import calibration as cal


def straight(scores):
    """The threshold by plain sums, one score after the other."""
    n, mean, squares, total = 0, 0.0, 0.0, 0.0
    for x in scores:
        n, off = n + 1, x - mean
        mean += off / n
        squares, total = squares + (x - mean) * off, total + x
    return 0.5 * (total / n + (squares / n) ** 0.5) + 0.425 * float(np.percentile(scores, 99.5))


def test_scores_are_added_in_the_order_given(spark):
    draw = random.Random(3)
    groups = {i: [draw.randrange(19) / 100 for _ in range(i % 9 + 1)] for i in range(300)}
    rows = [(i, k, s) for i, own in groups.items() for k, s in enumerate(own)]
    draw.shuffle(rows)
    scores = spark.createDataFrame(rows, "image_id int, row int, score double").repartition(7)
    found = {r.image_id: r.threshold for r in cal.contrast(scores, ["image_id"], ["row"]).collect()}
    assert found.keys() == groups.keys()
    assert all(abs(found[i] - straight(own)) < 1e-15 for i, own in groups.items())
    plain = {r.image_id: r.threshold for r in cal.contrast(scores, ["image_id"]).collect()}
    assert all(abs(found[i] - plain[i]) < 1e-12 for i in groups)


def test_groups_without_a_score_have_no_threshold(spark):
    scores = spark.createDataFrame([(1, 0, None), (2, 0, 0.4), (2, 1, None)], "image_id int, row int, score double")
    found = {r.image_id: r.threshold for r in cal.contrast(scores, ["image_id"], ["row"]).collect()}
    assert found[1] is None and abs(found[2] - 0.37) < 1e-12


def test_all_thresholds_equal_the_sql(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet'")
    expected = dict(con.execute(catalog.ORACLES["calib_contrast"]).fetchall())
    found = {r.image_id: r.threshold for r in catalog.QUERIES["calib_contrast"](spark, folder).collect()}
    assert found == expected
