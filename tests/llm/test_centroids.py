import random
from collections import Counter
from hashlib import sha256
from math import floor, inf, nan
from pathlib import Path

import numpy as np
import pytest

from sextant.llm import centroids
from sextant.llm.centroids import Centroids, assign, clusters, down, elkan, up

KIND = "vec_id long, embedding array<float>, cluster int, v string, label int"


def brute(rows, k, rounds, dims):
    """Plain integers, all distances."""
    kept = [(i, [min(max(floor(256 * x), -centroids.MOST), centroids.MOST) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and abs(x) < inf for x in v)]
    at = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))][:k]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for r in range(rounds + 1):
        near = [min((far(v, c), j) for j, c in enumerate(at)) for _, v in kept]
        if r < rounds:
            for j in range(len(at)):
                own = [v for (_, v), n in zip(kept, near, strict=True) if n[1] == j]
                at[j] = [sum(x) // len(own) for x in zip(*own, strict=True)] if own else at[j]
    total = sum(d for d, _ in near)
    inertia = Counter()
    for d, j in near:
        inertia[j] += d
    return Counter((i, j, d, inertia[j], total, sha256(",".join(map(str, at[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, near, strict=True))


def found(spark, rows, k=6, rounds=3, dims=4):
    table = spark.createDataFrame([(i, v, 1, "v", 0) for i, v in rows], KIND).repartition(3)
    return Counter((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in clusters(table, k=k, rounds=rounds, dims=dims).collect())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_clusters_equal_brute_force(spark, seed):
    """On a coarse grid, so that ties and copies abound."""
    rng = random.Random(seed)
    rows = [(k, [rng.randrange(-3, 4) / 256 for _ in range(4)]) for k in range(300)]
    rows += [(k, rows[0][1]) for k in range(300, 400)] + [rows[3]] * 3 + [(None, rows[5][1])]
    rows += [(900, None), (901, []), (902, [1.0, 2.0, 3.0]), (903, [1.0, None, 0.0, 0.0]), (904, [nan, 0.0, 0.0, 0.0]), (905, [inf, 0.0, 0.0, 0.0]), (906, [0.0] * 4)]
    assert found(spark, rows) == brute(rows, 6, 3, 4)


def test_large_components_and_few_vectors(spark):
    rows = [(1, [3e38, -3e38, 1e6, 0.1]), (2, [1e5, 2e5, -3e5, 7.7]), (3, [1e5, 2e5, -3e5, 7.6])]
    assert found(spark, rows) == brute(rows, 6, 3, 4)
    assert found(spark, []) == Counter()
    assert found(spark, [(1, [nan] * 4)]) == Counter()


def test_bounds_hold_and_skip():
    """After each move the bounds enclose the true distances, the nearest are right, and most distances of clustered vectors are skipped."""
    rng = np.random.default_rng(5)
    middles = rng.integers(-500, 500, (12, 16))
    vectors = np.concatenate([m + rng.integers(-15, 16, (100, 16)) for m in middles])
    at = np.array([vectors[k * 100] for k in range(12)])
    state = np.zeros(len(vectors), np.int32), np.full(len(vectors), np.inf, np.float32), np.zeros((len(vectors), 12), np.float32)
    now, measured = Centroids.of(at), []
    for _ in range(4):
        *state, counts = assign(vectors, *state, now)
        measured.append(int(counts.sum()))
        true = ((vectors[:, None] - now.at[None]) ** 2).sum(2)
        assert (state[0] == true.argmin(1)).all()
        assert (state[1].astype(float) ** 2 >= true.min(1)).all() and (state[2].astype(float) ** 2 <= true).all()
        after = np.array([vectors[state[0] == j].sum(0) // max((state[0] == j).sum(), 1) for j in range(12)])
        now = Centroids.of(after, now.at)
    assert measured[0] < vectors.shape[0] * 12 and measured[-1] < 0.05 * vectors.shape[0] * 12


def test_rounding_is_conservative():
    x = np.sqrt(np.arange(1, 100_000, dtype=np.float64))
    assert (up(x).astype(float) > x).all() and (down(x).astype(float) < x).all() and (down(x) >= 0.999 * x).all()


def test_old_bounds_are_removed(spark):
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")) / "sextant"
    bounds = lambda: set(folder.glob("bounds-*"))
    before = bounds()
    state, _ = elkan(spark.createDataFrame([(k, [k / 7, k / 5]) for k in range(50)], "vec_id long, embedding array<double>"), k=3, rounds=4, dims=2)
    assert state.count() == 50 and len(bounds() - before) == 1
