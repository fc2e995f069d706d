import random
from collections import defaultdict
from math import inf, nan

import numpy as np
import pytest
from pyspark.sql import functions as F

from sextant.llm.curves import hilbert, inner, nearest

KIND = "vec_id long, embedding array<double>, node long, score double, q long"


def brute(rows, k):
    """All pairs of different rows, sums in the order of the components."""
    kept = sorted({(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(x is not None and abs(x) < inf for x in v) and any(v)})
    out = {}
    for n, (i, v) in enumerate(kept):
        if i % 20 == 0:
            scores = []
            for m, (j, w) in enumerate(kept):
                if m != n:
                    total = 0.0
                    for a, b in zip(v, w):  # noqa: B905  the shorter one ends in zeros
                        total += a * b
                    scores.append((-total, j))
            out.setdefault(i, []).append([(j, -s) for s, j in sorted(scores)[:k]])
    return {i: sorted(lists) for i, lists in out.items()}


def found(spark, rows, k, **options):
    table = spark.createDataFrame([(i, v, 1, 0.5, 2) for i, v in rows], KIND).repartition(3)
    out = defaultdict(list)
    for r in nearest(table, F.col("vec_id") % 20 == 0, k=k, **options).orderBy("query_id", "rank").collect():
        out[r.query_id].append((r["rank"], r.vec_id, r.score))
    return {i: [[(j, s) for _, j, s in rows]] for i, rows in out.items()}


def test_hilbert_curve_visits_neighbours():
    for axes, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes), -1).reshape(-1, axes)
        keys = hilbert(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_ties_copies_and_invalid_vectors(spark):
    """A third of the rows is one vector, components are few numbers, lengths differ."""
    rng = random.Random(8)
    rows = [(i, [rng.randrange(-2, 3) / 4 for _ in range(5)]) for i in range(150)]
    rows += [(i, [0.5, 0.25, -0.5, 0.0, 1.0]) for i in range(150, 230)]
    rows += [(300, None), (320, []), (340, [0.0] * 5), (360, [nan] + [1.0] * 4), (361, [inf] * 5), (380, [None, 1.0, 1.0, 1.0, 1.0]), (None, [1.0] * 5)]
    rows += [(400, [3.0, -0.0, 0.0, 1.0, 1.0])] * 3 + [(401, [1.0, 2.0]), (402, [100.0, 50.0, 0.0, 0.0, 0.0]), (403, [1e-9] * 5)]
    assert found(spark, rows, 7, segment=16) == brute(rows, 7)


@pytest.mark.parametrize("lengths", [False, True])
def test_clustered_vectors(spark, lengths):
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(10, 12))
    vectors = middles[rng.integers(0, 10, 900)] + 0.1 * rng.normal(size=(900, 12))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None] / (rng.uniform(0.2, 5, (900, 1)) if lengths else 1)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    assert found(spark, rows, 20, segment=32) == brute(rows, 20)


def test_few_or_no_vectors(spark):
    assert found(spark, [], 5) == {}
    assert found(spark, [(20, [1.0, 2.0])], 5) == {}
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [-1.0, 0.0])]
    assert found(spark, rows, 5) == brute(rows, 5)


def test_recall_of_the_windows_alone(spark):
    """Clustered directions are found on the curves; the exact search then finds all."""
    rng = np.random.default_rng(6)
    middles = rng.normal(size=(200, 32))
    vectors = middles[rng.integers(0, 200, 4000)] + 0.15 * rng.normal(size=(4000, 32))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    true = {i: {j for j, _ in lists[0]} for i, lists in brute_fast(vectors, 10).items()}

    def recall(**options):
        got = found(spark, rows, 10, segment=128, **options)
        return sum(len(true[i] & {j for j, _ in got[i][0]}) for i in true) / sum(len(x) for x in true.values())

    assert recall(exact=False) >= 0.9
    assert recall() == 1


def brute_fast(vectors, k):
    out = {}
    for i in range(0, len(vectors), 20):
        scores = inner(np.broadcast_to(vectors[i], vectors.shape), vectors)
        scores[i] = -inf
        order = np.lexsort((np.arange(len(scores)), -scores))[:k]
        out[i] = [[(int(j), float(scores[j])) for j in order]]
    return out
