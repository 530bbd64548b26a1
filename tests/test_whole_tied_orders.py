"""Registered queries against their SQL on an order in which two boxes share score and corner."""

import duckdb
import pytest

from lodestone import catalog

LINE = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double"
ORDERS = {
    "decoded_proposals": [(1679, 3902, 3, 33.0, 9620.4, 0.06, 0.08), (279, 2102, 7, 12.0, 46746.46, 0.09, 0.05)],
    "fusion_dedupe": [(1375, 1976, 7, 39.0, 86667.07, 0.07, 0.08), (1775, 2576, 4, 48.0, 10696.45, 0.09, 0.04)],
    "match_flags": [(328, 1326, 7, 45.0, 75825.31, 0.03, 0.08), (614, 4126, 7, 44.0, 3473.29, 0.08, 0.03), (1288, 1281, 4, 16.0, 29051.53, 0.0, 0.04), (1646, 1831, 2, 41.0, 4982.9, 0.07, 0.08)],
    "overlay_labels": [(604, 1353, 2, 22.0, 13683.15, 0.1, 0.05), (852, 4023, 3, 3.0, 66046.04, 0.1, 0.08), (793, 1261, 1, 39.0, 58270.4, 0.02, 0.05), (932, 79, 2, 45.0, 5724.94, 0.03, 0.01), (764, 243, 4, 35.0, 39987.19, 0.03, 0.08), (1232, 3276, 2, 9.0, 10636.33, 0.09, 0.07)],
    "pr_curve": [(604, 1353, 2, 22.0, 13683.15, 0.1, 0.05), (852, 4023, 3, 3.0, 66046.04, 0.1, 0.08), (793, 1261, 1, 39.0, 58270.4, 0.02, 0.05), (932, 79, 2, 45.0, 5724.94, 0.03, 0.01), (764, 243, 4, 35.0, 39987.19, 0.03, 0.08), (1232, 3276, 2, 9.0, 10636.33, 0.09, 0.07)],
}


@pytest.mark.parametrize("name", ORDERS)
def test_tied_boxes_go_as_in_the_sql(spark, tmp_path, name):
    spark.createDataFrame([(1, *line) for line in ORDERS[name]], LINE).write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.execute(catalog.ORACLES[name])
    got = catalog.QUERIES[name](spark, str(tmp_path)).select([c[0] for c in want.description])
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)
