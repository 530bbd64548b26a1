"""The votes of every document against plain loops over all labelled vectors, and the latent space against a full decomposition."""

import math
import zlib

import numpy as np
import pytest

from lodestone.llm import quality_knn

SF = "/root/testdata/sf0.001"


def test_every_score_is_the_vote_of_the_nearest(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    space = quality_knn.fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    marked = {r.doc_id for r in labels.collect() if r.doc_id in texts and r.quality is not None}
    assert len(space.label) == sum(zlib.crc32(str(k).encode()) % 5 != 0 for k in marked)
    assert np.allclose(np.linalg.norm(space.vectors, axis=1), 1, atol=1e-4)
    compared = 0
    for r in quality_knn.quality_report(docs, labels).collect():
        x = quality_knn.terms([texts[r.doc_id]]) * space.idf
        v = (quality_knn.by_kind(x) * space.force @ space.projection)[0].tolist()
        length = math.sqrt(sum(a * a for a in v))
        near = sorted(((sum(a * b for a, b in zip(v, u)) / max(length, 1e-9), k) for k, u in enumerate(space.vectors.tolist())), reverse=True)
        n = min(quality_knn.NEIGHBOURS, len(near))
        assert r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if n < len(near) and near[n - 1][0] - near[n][0] < 1e-5:
            continue  # either of both may vote
        force = [(min(max(c, 0), 1) ** quality_knn.SHARPNESS * space.weight[k], space.label[k]) for c, k in near[:n]]
        total = sum(f for f, _ in force)
        assert r.score == pytest.approx(sum(f * y for f, y in force) / total if total else space.mean, abs=1e-4)
        compared += 1
    assert compared > 100


def test_leading_directions_are_those_of_a_full_decomposition():
    rng = np.random.default_rng(5)
    x = (rng.standard_normal((80, 12)) * 2.0 ** -np.arange(12) @ rng.standard_normal((12, 60))).astype(np.float32)
    own = quality_knn.leading(x, 5)
    want = np.linalg.svd(x.astype(np.float64))[2][:5].T
    assert np.allclose(own @ own.T, want @ want.T, atol=1e-3)
