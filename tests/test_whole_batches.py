"""Many small groups are computed at once, with the results of each alone."""

import itertools

import numpy as np

from lodestone.operators import hough, training


def test_many_assignments_at_once():
    rng = np.random.default_rng(3)
    for n, m in ((1, 4), (3, 3), (3, 5), (5, 3)):
        cost = rng.integers(0, 6, (300, n, m)).astype(float)
        rows, cols = training.cheapest(cost)
        got = cost[np.arange(300)[:, None], rows, cols].sum(1)
        for t, c in zip(got, cost if n <= m else cost.transpose(0, 2, 1)):
            assert t == min(sum(c[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(c.shape[1]), c.shape[0]))


def test_a_pair_without_cost_comes_last(spark):
    rows = [(1, 0, 0, None), (1, 0, 1, 9.0), (1, 1, 0, 1.0), (1, 1, 1, 1.0), (2, 0, 7, None)]
    got = training.cheapest_pairs(spark.createDataFrame(rows, "image_id bigint, gid bigint, pid bigint, cost double")).collect()
    assert {tuple(r) for r in got} == {(1, 0, 1, 9.0), (1, 1, 0, 1.0), (2, 0, 7, None)}


def test_matches_of_images_of_many_shapes(spark):
    rng = np.random.default_rng(8)
    box = lambda: tuple(int(a) for a in rng.integers(0, 50, 4))
    preds = [(i, p, *box()) for i in range(40) for p in range(i % 5)]
    truths = [(i, g, *box()) for i in range(40) for g in range(i % 4)]
    got = {}
    for r in training.optimal_match(spark.createDataFrame(preds, "image_id bigint, pid bigint, x int, y int, w int, h int"), spark.createDataFrame(truths, "image_id bigint, gid bigint, x int, y int, w int, h int")).collect():
        got.setdefault(r.image_id, []).append(r.cost)
    for i in range(40):
        a, b = ([np.array(r[2:]) for r in rows if r[0] == i] for rows in (truths, preds))
        a, b = sorted((a, b), key=len)
        assert sum(got.get(i, [])) == min(sum(abs(x - y).sum() for x, y in zip(a, p)) for p in itertools.permutations(b, len(a)))


def test_fits_of_pairs_are_the_fits_of_draws():
    rng = np.random.default_rng(6)
    z = rng.integers(0, 9, (50, 6)) + 1j * rng.integers(0, 9, (50, 6))
    w = z + rng.integers(0, 3, (50, 6)) * 4 + 7j
    draws = rng.integers(0, 6, (50, 2, 200))
    by_pair = hough.best_fits(z, w, draws, 3.0)
    by_draw = hough.best_fits(z, w, draws[:, :, :30], 3.0)  # fewer draws than pairs: each is fitted
    again = hough.best_fits(z, w, np.concatenate([draws[:, :, :30]] * 2, 2), 3.0)  # 60 draws of the same 30
    assert by_pair[0].all() and (by_pair[1].sum(1) >= by_draw[1].sum(1)).all()
    assert np.array_equal(by_draw[1], again[1]) and np.array_equal(by_draw[3], again[3]) and np.allclose(by_draw[2], again[2])
