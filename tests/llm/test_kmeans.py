"""Delta Lloyd against plain Lloyd over Python's integers."""

import hashlib
import math
import random

import pytest

from eligspark.llm import kmeans


def lloyd(rows, clusters, rounds, components, scale=64):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == components and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in named[:clusters]]
    gap = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    for step in range(rounds + 1):
        owner = [min(range(len(centres)), key=lambda c: (gap(v, centres[c]), c)) for _, v in kept]
        if step < rounds:
            for c in range(len(centres)):
                own = [v for (_, v), o in zip(kept, owner) if o == c]
                if own:
                    centres[c] = [sum(x) // len(own) for x in zip(*own)]
    far = [gap(v, centres[o]) for (_, v), o in zip(kept, owner)]
    return sorted(
        (str(i), o, d, sum(x for x, p in zip(far, owner) if p == o), sum(far), hashlib.sha256(",".join(map(str, centres[o])).encode()).hexdigest()) for (i, _), o, d in zip(kept, owner, far)
    )


def vectors(seed, n, components, large=False):
    rnd = random.Random(seed)
    rows = [(k, [rnd.choice([-1, 1]) * rnd.random() ** 2 * (3 if k % 5 else 0.1) for _ in range(components)]) for k in range(n)]
    rows += [(n + k, rows[7][1]) for k in range(6)] + [(2, rows[2][1]), (None, rows[3][1]), (None, rows[4][1])]
    rows += [(900, None), (901, [0.0] * (components - 1)), (902, [None] + [0.0] * (components - 1)), (903, [float("nan")] * components), (904, [float("inf")] + [0.0] * (components - 1)), (905, [])]
    rows += [(950 + k, [k % 2 / 64.0] * components) for k in range(8)]  # ties between centroids
    return rows + [(990, [3e6] * components), (991, [-2.5e9] + [1.0] * (components - 1))] * large


@pytest.mark.parametrize(("n", "clusters", "components", "large"), [(120, 5, 4, False), (60, 16, 64, False), (80, 4, 3, True), (0, 30, 4, False)])
def test_delta_equals_plain(spark, n, clusters, components, large):
    rows = vectors(n, max(n, 9), components, large)
    df = spark.createDataFrame([(i, v, 3, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, distance string").repartition(3)
    got = kmeans.cluster_vectors(df, clusters=clusters, rounds=3, components=components)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "rounds_moved"]
    assert sorted((str(r[0]), *r[1:6]) for r in got.collect()) == lloyd(rows, clusters, 3, components)


def test_empty(spark):
    assert kmeans.cluster_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_later_rounds_compare_less():
    import numpy as np

    rng = np.random.default_rng(3)
    rows = rng.integers(-200, 200, (500, 8))
    centres = rows[:6].tolist()
    owner, gap, first = kmeans.reassigned(rows, None, None, kmeans.Centroids(centres, list(range(6))))
    assert first == 500 * 6
    then = [c if k else [x + 1 for x in c] for k, c in enumerate(centres)]
    again, _, compared = kmeans.reassigned(rows, owner, gap, kmeans.Centroids(then, [0]))
    plain, _, _ = kmeans.reassigned(rows, None, None, kmeans.Centroids(then, list(range(6))))
    assert again.tolist() == plain.tolist()
    assert compared < 500 * 2


def test_packing():
    import numpy as np

    rows = np.array([[1, -127], [128, 5], [-(1 << 26), 3], [1 << 40, -1]])
    packed = kmeans.pack(rows)
    assert [len(p) for p in packed] == [3, 5, 9, 17]
    assert kmeans.unpack(packed, 2).tolist() == rows.tolist()
