import numpy as np

from lodestone.operators import calibration


def test_fits_of_many_groups_are_the_fits_of_each(spark):
    rng = np.random.default_rng(4)
    two = np.sort(np.concatenate([rng.normal(0.2, 0.02, (40, 6)), rng.normal(0.8, 0.02, (40, 6))], 1), 1)
    every = [calibration.separated(r[None]) for r in two]
    threshold, degenerate = calibration.separated(two)
    assert not degenerate.any() and (threshold > 0.25).all() and (threshold < 0.75).all()
    assert np.array_equal(threshold, [t[0] for t, _ in every])
    df = spark.createDataFrame([(i, float(x)) for i, r in enumerate(two) for x in r] + [(50, 0.5), (51, None), (52, 0.1), (52, None), (52, 0.3)], "image_id bigint, score double")
    got = {r.image_id: (r.threshold, r.degenerate) for r in calibration.gmm(df.repartition(5), ["image_id"], "image_id bigint").collect()}
    assert {i: t for i, (t, _) in got.items() if i < 40} == dict(enumerate(threshold.tolist()))
    assert got[50] == (0.5 - 1e-9, True) and got[51] == (None, True) and got[52] == (0.2, True)
