"""Seeded scenes with exact boxes for tests of searches: shapes on a lattice or scattered, over clutter, with other shapes as bait."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

SPEC = "image_id bigint, seed bigint, width int, height int, layout string, instances int, size int, jitter double, distractors int, clutter double"
SCENE = "image_id bigint, height int, width int, pixels array<double>, boxes array<struct<x:int,y:int,w:int,h:int>>, requested_n int, achieved_n int"


def disc(side: int) -> np.ndarray:
    y, x = np.mgrid[:side, :side] - (side - 1) / 2
    return np.hypot(y, x) <= side / 2


def cross(side: int) -> np.ndarray:
    third = max(1, side // 3)
    m = np.zeros((side, side), bool)
    at = (side - third) // 2
    m[at : at + third], m[:, at : at + third] = True, True
    return m


def painted(r) -> tuple[np.ndarray, list[dict[str, int]]]:
    """A scene's pixels and the boxes of its instances by row and column; what finds no free place after 200 draws is left out."""
    rng = np.random.default_rng(r.seed)
    scene, boxes, taken = rng.uniform(0, r.clutter, (r.height, r.width)), [], []
    sides = np.maximum(3, np.rint(r.size * (1 + rng.uniform(-r.jitter, r.jitter, r.instances)))).astype(int)

    def free(x: int, y: int, side: int) -> bool:
        return 0 <= x <= r.width - side and 0 <= y <= r.height - side and all(x + side < a or a + n < x or y + side < b or b + n < y for a, b, n in taken)

    step = int(np.ceil(r.size * (1 + r.jitter))) + 2
    across = max(1, r.width // step)
    for k, side in enumerate([*sides, *[r.size] * r.distractors]):
        bait = k >= r.instances
        if r.layout == "lattice" and not bait:
            tries = [((k % across) * step + (step - side) // 2, (k // across) * step + (step - side) // 2)]
        else:
            tries = rng.integers(0, (max(1, r.width - side + 1), max(1, r.height - side + 1)), (200, 2)).tolist()
        x, y = next(((x, y) for x, y in tries if free(x, y, side)), (None, None))
        if x is None:
            continue
        taken.append((x, y, side))
        mask = cross(side) if bait else disc(side)
        scene[y : y + side, x : x + side][mask] = 200.0 if bait else 255.0
        if not bait:
            ys, xs = np.nonzero(mask)
            boxes.append({"x": int(x + xs.min()), "y": int(y + ys.min()), "w": int(np.ptp(xs) + 1), "h": int(np.ptp(ys) + 1)})
    return scene, sorted(boxes, key=lambda b: (b["y"], b["x"]))


def scenes(specs: DataFrame) -> DataFrame:
    """A row for each spec (SPEC): pixels and exact boxes; achieved_n says how many of the instances found a place. Rows don't depend on each other."""

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                scene, boxes = painted(r)
                yield pd.DataFrame({"image_id": [r.image_id], "height": [r.height], "width": [r.width], "pixels": [scene.ravel()], "boxes": [boxes], "requested_n": [r.instances], "achieved_n": [len(boxes)]})

    return specs.mapInPandas(run, SCENE)
