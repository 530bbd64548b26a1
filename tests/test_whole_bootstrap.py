import numpy as np
import pytest

from lodestone.operators import ranking


def test_resamples_are_drawn_in_parts(spark):
    rng = np.random.default_rng(2)
    v = np.sort(rng.integers(0, 101, 3000) / 100)
    whole = v[np.random.default_rng(12345).integers(0, len(v), (300, len(v)))].mean(1)
    for draws in (1000, 2999, 3000, 10_000, 1 << 21):  # fewer than a resample, and several resamples at once
        assert ranking.resampled_means(v, 300, 12345, draws) == pytest.approx(whole, abs=1e-14)
    df = spark.createDataFrame([("a", float(x)) for x in v] + [("a", None), (None, 0.5)], "g string, x double").repartition(3)
    got = {r.g: (r.mean, r.low, r.high) for r in ranking.bootstrap_numpy(df, "g", "x", resamples=300).collect()}
    assert got == {"a": pytest.approx((v.mean(), *np.percentile(whole, [2.5, 97.5]))), None: (0.5, 0.5, 0.5)}


def test_a_large_group_takes_little_memory():
    import tracemalloc

    v = np.linspace(0, 1, 400_000)
    tracemalloc.start()
    ranking.resampled_means(v, 30, 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6  # all draws at once are 192 MB
