from lodestone.operators import dense


def test_components_longer_than_64_steps(spark):
    line = [(0, x, 9.0) for x in range(150)] + [(y, 149, 9.0) for y in range(1, 80)]
    got = dense.components(spark.createDataFrame(line, "y int, x int, v double"), 5.0).collect()
    assert [(r.label, r.x, r.y, r.w, r.h, r.area) for r in got] == [(0, 0, 0, 150, 80, 229)]
