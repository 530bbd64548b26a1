"""Mean average precision on the half of the sixth digit."""

import math
import random

import duckdb
from pyspark.sql import functions as F

from lodestone import catalog
from lodestone.operators import evaluation

PREDS = [(0, 6, 103, 58, 25, 0.08), (6, 163, 104, 56, 40, 0.17), (7, 168, 102, 56, 40, 0.16), (8, 90, 71, 38, 40, 0.08), (10, 183, 67, 55, 50, 0.09), (12, 32, 102, 21, 50, 0.16), (14, 104, 58, 46, 55, 0.12), (15, 104, 58, 46, 55, 0.11)]
TRUTHS = [(0, 6, 105, 58, 25), (1, 25, 185, 50, 30), (2, 55, 86, 27, 40), (3, 167, 102, 56, 40), (4, 86, 74, 38, 40), (5, 182, 65, 55, 50), (6, 32, 104, 21, 50), (7, 103, 58, 46, 55)]


def test_a_mean_of_63_in_128_is_on_the_half(spark):
    preds = spark.createDataFrame([(1, *p) for p in PREDS], "image_id int, pid bigint, x int, y int, w int, h int, score double")
    truths = spark.createDataFrame([(1, *t) for t in TRUTHS], "image_id int, gid bigint, x int, y int, w int, h int")
    (row,) = evaluation.coco_ap(preds, truths).collect()
    assert (row.ap, row.ap50) == (63 / 128, 0.625)


# lines of two orders, (number, part, supplier, quantity, discount, tax); their means, 1667/3200 and 1547/3200, are on a half, and below it in whatever order binary fractions are added
LINES = {
    1: [(1, 2644, 612, 8, 0.1, 0.02), (1, 14025, 250, 32, 0.08, 0.01), (2, 6885, 17, 22, 0.07, 0.06), (5, 18776, 956, 18, 0.08, 0.0), (6, 3469, 90, 35, 0.07, 0.06), (7, 11688, 398, 22, 0.08, 0.03), (7, 6594, 817, 42, 0.0, 0.0), (7, 8587, 87, 35, 0.08, 0.07)],
    2: [(3, 11936, 203, 15, 0.1, 0.05), (3, 5629, 307, 12, 0.05, 0.03), (3, 15589, 138, 47, 0.09, 0.05), (4, 1665, 817, 15, 0.07, 0.03), (5, 15096, 3, 35, 0.01, 0.03), (6, 16799, 84, 23, 0.09, 0.07), (6, 11451, 137, 22, 0.04, 0.03), (6, 9295, 693, 28, 0.06, 0.02)],
}


def test_a_half_that_binary_sums_miss_in_any_order_goes_as_in_the_sql(spark, tmp_path):
    lines = [(order, part, supplier, number, float(quantity), 0.0, discount, tax) for order, own in LINES.items() for number, part, supplier, quantity, discount, tax in own]
    columns = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double"
    spark.createDataFrame(lines, columns).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    expected = {r[0]: r[1:] for r in con.execute(catalog.ORACLES["coco_ap"]).fetchall()}
    found = {r.image_id: (r.ap, r.ap50, r.ap75) for r in catalog.QUERIES["coco_ap"](spark, str(tmp_path)).collect()}
    assert found == expected
    assert (found[1][0], found[2][0]) == (0.520937, 0.483437)


def test_the_mean_is_the_middle_of_the_sums(spark):
    draw = random.Random(5)
    rows = [(i, [draw.randrange(1, 60) / draw.choice((60, 84, 96)) % 1 for _ in range(10)]) for i in range(500)]
    found = spark.createDataFrame(rows, "i int, xs array<double>").select("i", evaluation.mean_of(F.col("xs"), 10).alias("mean")).collect()

    def plain(xs):
        s = 0.0
        for x in xs:
            s += x
        return s

    for (_, xs), r in zip(rows, sorted(found)):
        assert r.mean == sorted((plain(xs), plain(xs[::-1]), math.fsum(xs)))[1] / 10
