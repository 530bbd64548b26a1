import pytest

from lodestone import catalog
from lodestone.queries.base import Views


@pytest.mark.parametrize("name, view, sf", [("calib_gmm", "boxes", "0.001"), ("hough_peaks", "boxes", "0.01"), ("hungarian", "gt_boxes", "0.001"), ("ransac_instances", "boxes", "0.01")])
def test_queries_without_sql_read_whole_tables(spark, name, view, sf):
    d = f"/root/testdata/sf{sf}"
    got = {r[0] for r in catalog.QUERIES[name](spark, d).select("image_id").distinct().collect()}
    every = {r[0] for r in getattr(Views(spark, d), view).select("image_id").distinct().collect()}
    assert got <= every and max(got) > (2000 if sf == "0.01" else 1000)
    if name == "calib_gmm":
        assert got == every
