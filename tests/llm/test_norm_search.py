import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from jointwork.llm import norm_search
from jointwork.llm.registry import ship

EXTRA = "id long, row int, q int, norm string, dim int, class int, block int, rank int, score long"


def vectors(spark, rows):
    ship(spark)
    return spark.createDataFrame([(i, v, *([None] * 9)) for i, v in rows], "vec_id long, embedding array<float>, " + EXTRA)


def brute(rows, k, every):
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    good = [(i, q) for i, q in good if sum(x * x for x in q) < 2**62]
    out = []
    for a, (i, q) in enumerate(good):
        if i is None or i % every:
            continue
        found = [(-sum(x * y for x, y in zip(q, p)), j is None, j or 0) for b, (j, p) in enumerate(good) if a != b and len(p) == len(q)]
        out += [(i, r + 1, None if absent else j, -s) for r, (s, absent, j) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def case(seed, n=400, dim=16):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        size = rng.choice([0.01, 0.5, 1.0, 1.0, 1.05, 4.0])
        rows.append((i, [size * rng.gauss(math.sin(i % 7 + j), 0.2) for j in range(dim)]))
    rows += [(1000 + i, rows[20][1]) for i in range(40)]  # copies, so ties
    rows += [(20, rows[20][1]), (20, rows[21][1]), (None, rows[40][1]), (None, rows[40][1]), (2000, None), (2010, []), (2020, [])]
    rows += [(2030, [None] * dim), (2040, [float("nan")] * dim), (2050, [float("inf")] * dim), (2060, [0.0] * dim), (2070, [-x for x in rows[20][1]])]
    rows += [(2080, [1.0, 2.0]), (2090, [3e38] * dim), (2100, [1e5] * dim), (2110, [-1e6] * dim)]
    return rows


@pytest.mark.parametrize("rows_, queries, first", [(4096, 1024, 8192), (50, 7, 60), (20, 3, 5)])
def test_equals_brute_force(spark, monkeypatch, rows_, queries, first):
    monkeypatch.setattr(norm_search, "ROWS", rows_)
    monkeypatch.setattr(norm_search, "QUERIES", queries)
    monkeypatch.setattr(norm_search, "FIRST_ROWS", first)
    rows = case(1)
    found = norm_search.top_products(vectors(spark, rows).repartition(3), F.col("id") % 10 == 0)
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(rows, 5, 10)


def test_coordinates_prune_and_lose_nothing():
    """Both ways of pruning against plain products, for scores from low to out of reach."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    p = rng.integers(-300, 300, (500, 32)) * (rng.random((500, 32)) < 0.2)
    q = p[:40] + rng.integers(-20, 20, (40, 32))
    products = q @ p.T
    for share in (-1.0, 0.3, 0.6, 0.95, 1.2):
        least = (share * np.linalg.norm(q, axis=1) * np.linalg.norm(p, axis=1).max()).astype(int)
        lists = lambda x: pa.array(x.tolist(), pa.list_(pa.int64()))
        a = pa.table({"row": pa.array(range(1000, 1040)), "id": pa.array(range(40)), "q": lists(q), "norm": np.linalg.norm(q, axis=1), "least": pa.array(least, pa.int64())})
        b = pa.table({"row": pa.array(range(500)), "id": pa.array(range(500)), "q": lists(p), "norm": np.linalg.norm(p, axis=1)})
        got = norm_search._cell(a, b, 500).to_pylist()
        want = {(i, j) for i in range(40) for j in range(500) if products[i, j] >= least[i]}
        assert {(r["query_id"], r["vec_id"]) for r in got} == want
        assert all(r["score"] == products[r["query_id"], r["vec_id"]] for r in got)


def test_few_and_empty(spark):
    rows = [(0, [1.0, 2.0]), (10, [0.5, -1.0]), (3, [0.0, 0.0])]
    found = norm_search.top_products(vectors(spark, rows), F.col("id") % 10 == 0)
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(rows, 5, 10)
    assert norm_search.top_products(vectors(spark, rows).limit(0), F.col("id") % 10 == 0).count() == 0
    assert norm_search.top_products(vectors(spark, rows), F.col("id") < 0).count() == 0
