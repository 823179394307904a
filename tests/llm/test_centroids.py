import hashlib
import math
import random

from jointwork.llm import centroids
from jointwork.llm.registry import ship

EXTRA = "id long, q int, cluster int, distance string, near int"


def vectors(spark, rows):
    ship(spark)
    return spark.createDataFrame([(i, v, *([None] * 5)) for i, v in rows], "vec_id long, embedding array<float>, " + EXTRA)


def brute(rows, dim, k, rounds, scale=64, seed="1"):
    """(id, cluster, distance) and centroids, one vector after the other."""
    import numpy as np

    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, q) for i, q in kept if all(abs(x) < 2**27 for x in q)]
    first = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)
    centres = [q for _, q in first[:k]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        found = [near(q)[1] for _, q in kept]
        for j in range(len(centres)):
            mine = [q for (_, q), c in zip(kept, found) if c == j]
            if mine:
                centres[j] = [sum(x) // len(mine) for x in zip(*mine)]
    return [(i, near(q)[1], near(q)[0]) for i, q in kept], centres


def rows_of(seed=3, n=150, dim=6):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(3 * (i % 5), 1.0) for _ in range(dim)]) for i in range(n)]
    rows += [(500 + i, rows[7][1]) for i in range(60)]  # one vector many times, ties with it
    rows += [(7, rows[7][1]), (8, rows[9][1]), (None, rows[3][1]), (900, None), (901, []), (902, [1.0] * (dim - 1)), (903, [1.0] * (dim + 1))]
    rows += [(904, [None] + [1.0] * (dim - 1)), (905, [float("nan")] + [1.0] * (dim - 1)), (906, [float("-inf")] + [0.0] * (dim - 1)), (907, [3e38] + [0.0] * (dim - 1))]
    return rows


def test_equals_brute_force(spark):
    rows = rows_of()
    want, centres = brute(rows, 6, 4, 3)
    assigned, found = centroids.cluster(vectors(spark, rows).repartition(5), dim=6, k=4)
    assert found == centres
    got = [tuple(r) for r in centroids.with_inertia(assigned, found).collect()]
    assert sorted((r[:3] for r in got), key=str) == sorted(want, key=str)
    total = sum(d for _, _, d in want)
    for i, c, d, own, every, digest in got:
        assert own == sum(x for _, j, x in want if j == c) and every == total
        assert digest == hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()


def test_few_vectors_and_empty_centroids(spark):
    rows = [(1, [1.0, -0.3]), (2, [1.0, -0.3]), (3, [-5.0, 2.0])]
    want, centres = brute(rows, 2, 16, 3)
    assigned, found = centroids.cluster(vectors(spark, rows), dim=2)
    assert found == centres and len(found) == 3
    assert sorted(map(tuple, assigned.collect())) == sorted(want)
    assert {r["cluster"] for r in assigned.collect()} == {c for _, c, _ in want}  # of equal centroids the smaller number


def test_empty(spark):
    for rows in (vectors(spark, [(1, [1.0])]).limit(0), vectors(spark, [(1, None), (2, [float("inf")] * 64)])):
        out = centroids.with_inertia(*centroids.cluster(rows))
        assert out.count() == 0 and len(out.columns) == 6
