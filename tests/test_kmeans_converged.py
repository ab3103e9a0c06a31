import hashlib

import numpy as np
import pytest

from quernel.plans.queries import QUERIES, RFM, K, points

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain(spark):
    rows = sorted(points(spark, SF).collect(), key=lambda r: (hashlib.md5(f"{r.id}:42".encode()).hexdigest(), r.id))
    return [r.id for r in rows], np.array([[r[f] for f in RFM] for r in rows])


def lloyd(x, k):
    """Centres that move less than 1e-4 in the mean, the last move, and squared distances of the points."""
    c = x[:k]
    for _ in range(250):
        near = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        new = np.array([np.round(x[near == j].mean(axis=0), 9) if (near == j).any() else c[j] for j in range(k)])
        shift = np.sqrt(((new - c) ** 2).sum(axis=1)).mean()
        c = new
        if shift < 1e-4:
            break
    return c, shift, ((x[:, None] - c[None]) ** 2).sum(axis=2)


def test_centres_come_to_rest(spark, plain):
    ids, x = plain
    centres, shift, far = lloyd(x, K)
    got = {r.cluster: [r[f] for f in RFM] for r in QUERIES["kmeans_centroids"](spark, SF).collect()}
    assert np.allclose([got[j] for j in range(K)], centres, atol=2e-6)
    assert QUERIES["kmeans_shift"](spark, SF).first().shift == pytest.approx(shift, abs=2e-6) and shift < 1e-4
    assert QUERIES["kmeans_wssse"](spark, SF).first().wssse == pytest.approx(far.min(axis=1).sum(), abs=2e-4)
    labels = {r.id: r.cluster for r in QUERIES["kmeans_assign"](spark, SF).collect()}
    assert labels == dict(zip(ids, far.argmin(axis=1).tolist(), strict=True))
    sizes = np.bincount(list(labels.values()), minlength=K).tolist()
    assert [r.size for r in QUERIES["segment_profile"](spark, SF).orderBy("cluster").collect()] == sizes
    assert {(r.cluster, r.n) for r in QUERIES["cluster_summary"](spark, SF).collect()} == set(enumerate(sizes))
    assert QUERIES["relative_importance"](spark, SF).count() == K


def test_elbows_go_from_2_to_10(spark, plain):
    got = {r.k: r.wssse for r in QUERIES["kmeans_elbow"](spark, SF).collect()}
    assert got == pytest.approx({k: lloyd(plain[1], k)[2].min(axis=1).sum() for k in range(2, 11)}, abs=2e-4)
    assert sorted(r.k for r in QUERIES["kmeans_elbow_ml"](spark, SF).collect()) == list(range(2, 11))


def test_library_fits_and_projection_have_right_values(spark, plain):
    ids, x = plain
    for name in ("kmeans_ml_random", "kmeans_ml_parallel"):
        rows = QUERIES[name](spark, SF).orderBy("cluster").collect()
        centres = np.array([[r[f] for f in RFM] for r in rows])
        far = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
        near = far.argmin(axis=1)
        # every cluster's mean is the mean of the points nearest to it, its size their number, and the cost their squared distances
        assert [r.n for r in rows] == np.bincount(near, minlength=K).tolist()
        assert np.allclose([x[near == j].mean(axis=0) for j in range(K)], centres, atol=1e-3)
        assert rows[0].cost == pytest.approx(far.min(axis=1).sum(), rel=1e-3)
    costs = {r.k: r.cost for r in QUERIES["kmeans_elbow_ml"](spark, SF).collect()}
    assert all(0 < costs[k] <= ((x - x.mean(axis=0)) ** 2).sum() for k in costs) and costs[10] < costs[2]
    got = {r.id: (r.pc1, r.pc2) for r in QUERIES["pca_projection"](spark, SF).collect()}
    _, _, axes = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    want, mine = x @ axes[:2].T, np.array([got[i] for i in ids])
    sign = np.sign((want * mine).sum(axis=0))
    assert np.allclose(want * sign, mine, atol=1e-4)
