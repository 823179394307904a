"""Hand-made works with exact expectations, and brute-force comparisons."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from jointwork.operators import admin as ad, bitmaps as bm, counts as c, extract as ex, network as n, reconcile as q, relations as r, scopes as s
from jointwork.operators.skew import dense_index, pair_up

AFFIL = "pid bigint, is_ext boolean, inst string, unit_type string, unit_id bigint, unit_label string, college string, discipline string, broad_field string"


def affil_row(pid, unit, unit_id, college, disc, ext=False, unit_type="Department"):
    return (pid, ext, "X" if ext else "HOME", unit_type, unit_id, unit, college, disc, "F")


@pytest.fixture(scope="module")
def micro(spark):
    affil = spark.createDataFrame(
        [affil_row(1, "A", 10, "X", "d1"), affil_row(2, "A", 10, "X", "d1"), affil_row(3, "B", 20, None, "d2"),
         affil_row(4, "A", 10, "X", "d1"), affil_row(4, "B", 20, None, "d2"), affil_row(9, "A", 990, "X", "d1", ext=True)], AFFIL)
    person = spark.createDataFrame([(1, "a", False, "HOME"), (2, "b", False, "HOME"), (3, "c", False, "HOME"), (4, "d", False, "HOME"),
                                    (9, "e", True, "X")], "pid bigint, pname string, is_ext boolean, inst string")
    works = {1: [1, 2], 2: [1, 3, 4], 3: [1, 9], 4: [3], 5: [2, 4, 9]}
    matches = spark.createDataFrame([(w, p) for w, ps in works.items() for p in ps for _ in range(2)], "wid bigint, pid bigint")
    return affil, person, ex.membership(matches, person)


def long(df):
    return {(x["id"], x["category"], x["wid"]): x["pairs"] for x in df.collect()}


def test_solo_work_is_not_in_the_universe(micro):
    _, _, member = micro
    got = {x["wid"]: x["n_people"] for x in member.select("wid", "n_people").distinct().collect()}
    assert got == {1: 2, 2: 3, 3: 2, 5: 3}


def test_unit_pairs(micro):
    affil, _, member = micro
    assert long(c.unit_pairs(member, affil, "Department", "department")) == {
        ("10", "within", 1): 1, ("10", "within", 2): 1, ("10", "across", 2): 2, ("10", "inter", 3): 1,
        ("10", "within", 5): 1, ("10", "inter", 5): 2,
        ("20", "within", 2): 1, ("20", "across", 2): 2, ("20", "across", 5): 1, ("20", "inter", 5): 1,
    }


@pytest.mark.parametrize("scope,across", [("level", None), ("kind", 2)])
def test_total_scope_at_college_level(micro, scope, across):
    affil, _, member = micro
    got = long(c.unit_pairs(member, affil, "Department", "college", scope))
    assert got.get(("X", "across", 2)) == across


def test_person_counts_formula_equals_pairs(micro):
    affil, _, member = micro
    a = c.person_pairs(c.person_work_counts(member, affil), affil, "Department").select("id", "category", "wid", "pairs")
    b = c.person_pairs_from_rel(c.person_min_rel(member, affil), affil, "Department").select("id", "category", "wid", "pairs")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_joint_person_alone_flags_interdisciplinary(micro):
    affil, _, member = micro
    got = {x["wid"]: x["interdisc"] for x in c.interdisciplinary(member, affil).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 5: 1}


def test_matrix_needs_two_people(micro):
    affil, _, member = micro
    got = {(x["a"], x["b"]): x["works"] for x in r.matrix(member, affil, "Department").collect()}
    assert got == {("10", "10"): 3, ("10", "20"): 2, ("20", "20"): 1}


def test_author_cap_and_types(micro):
    _, _, member = micro
    assert {x["wid"] for x in s.author_cap(member, 2).collect()} == {1, 3}


def test_random_graphs_against_brute_force(spark):
    """Matrix, partner units and pair formula on random joint memberships."""
    rng = random.Random(7)
    people = {p: rng.sample(range(6), rng.choice([1, 1, 2, 3])) for p in range(25)}
    ext = {p for p in people if p % 6 == 5}
    rows = [affil_row(p, f"U{u}", u + (100 if p in ext else 0), None, "d", ext=p in ext, unit_type="Department" if u < 4 else "Program")
            for p, us in people.items() for u in us]
    affil = spark.createDataFrame(rows, AFFIL)
    person = spark.createDataFrame([(p, f"n{p}", p in ext, f"I{p % 2}" if p in ext else "HOME") for p in people],
                                   "pid bigint, pname string, is_ext boolean, inst string")
    works = {w: rng.sample(range(25), rng.randint(1, 8)) for w in range(60)}
    works = {w: ps for w, ps in works.items() if len(ps) > 1 and any(p not in ext for p in ps)}
    member = ex.membership(spark.createDataFrame([(w, p) for w, ps in works.items() for p in ps], "wid bigint, pid bigint"), person)
    unit_type = {u: "Department" if u < 4 else "Program" for u in range(6)}

    cells, partners = {}, {}
    for w, ps in works.items():
        home = [p for p in ps if p not in ext]
        for p, q in itertools.permutations(home, 2):
            for u, v in itertools.product(people[p], people[q]):
                if unit_type[u] == unit_type[v] == "Department":
                    cells.setdefault((str(min(u, v)), str(max(u, v))), set()).add(w)
                if u not in people[q] and unit_type[u] == unit_type[v]:
                    partners.setdefault((str(u), str(v)), []).append((w, p, q))
    got = {(x["a"], x["b"]): x["works"] for x in r.matrix(member, affil, "Department").collect()}
    assert got == {k: len(v) for k, v in cells.items()}
    got = {(x["anchor"], x["partner"]): (x["works"], x["pairs"]) for x in r.partner_units(member, affil).collect()}
    assert got == {k: (len({w for w, _, _ in v}), len(set(v))) for k, v in partners.items()}
    edges = {(x["a"], x["b"]): x["works"] for x in n.pair_works(member).collect()}
    brute = {}
    for ps in works.values():
        for p, q in itertools.combinations(sorted(ps), 2):
            if not (p in ext and q in ext):
                brute[(p, q)] = brute.get((p, q), 0) + 1
    assert edges == brute


def test_tiled_pairs_equal_plain_pairs(spark):
    """One group holds most rows and is cut into many tiles."""
    sizes = {1: 90, 2: 3, 3: 1}
    rows = spark.createDataFrame([(g, g * 1000 + i, size) for g, size in sizes.items() for i in range(size)], "g bigint, i bigint, size bigint")
    got = pair_up(rows, "g", "i", "size", tile=8)
    assert got.count() == 90 * 89 // 2 + 3
    assert got.distinct().count() == got.count()
    assert pair_up(rows, "g", "i", "size", ordered=True, tile=8).count() == 90 * 89 + 6


def test_dense_index(spark):
    df = spark.range(0, 500).select((F.col("id") * 7 % 1000).alias("k")).repartition(7)
    got = [(x["k"], x["pos"]) for x in dense_index(df, ["k"], "pos").collect()]
    assert sorted(got) == [(k, i) for i, k in enumerate(sorted(k for k, _ in got))]


def test_cosine_join_is_exact_and_prunes(spark):
    """Against all pairs, for several thresholds; a discipline that everybody has is cut into tiles."""
    import itertools
    import math
    import random

    rng = random.Random(3)
    vectors = {}
    for d in range(60):
        own = {f"x{rng.randrange(40)}": rng.randrange(1, 9) for _ in range(rng.randrange(1, 6))}
        vectors[f"d{d:02}"] = own | {"common": rng.randrange(1, 3)}
    frame = spark.createDataFrame([(d, k, n) for d, v in vectors.items() for k, n in v.items()], "dept string, discipline string, n long")
    norm = {d: math.sqrt(sum(n * n for n in v.values())) for d, v in vectors.items()}
    sims = {(a, b): sum(n * vectors[b].get(k, 0) for k, n in vectors[a].items()) / (norm[a] * norm[b]) for a, b in itertools.combinations(sorted(vectors), 2)}
    for t in (0.04, 0.5, 0.9):
        got = {(r["a"], r["b"]): r["sim"] for r in ad.cosine_join(frame, t).collect()}
        want = {p: s_ for p, s_ in sims.items() if s_ >= t}
        assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-12 for p in want)
        met = {(r["a"], r["b"]) for r in ad.cosine_candidates(frame, t, tile=16).collect()}
        assert want.keys() <= met
        if t >= 0.5:
            assert len(met) < len(sims) / 2


def test_row_difference_of_any_rows(spark):
    a = spark.range(5000).selectExpr("id % 900 AS k", "CASE WHEN id % 7 = 0 THEN NULL ELSE CAST(id % 3 AS STRING) END AS v")
    rows = [(k, v) for k, v in a.collect()]
    assert q.row_difference(a, a.repartition(3), ranges=64).count() == 0
    b = spark.createDataFrame(rows[3:] + [(1, None), (2, "new"), rows[50], rows[50]], "k long, v string")
    import collections

    ca, cb = collections.Counter(rows), collections.Counter(map(tuple, b.collect()))
    want = {(*r, ca[r], cb[r]) for r in ca.keys() | cb.keys() if ca[r] != cb[r]}
    for levels in (1, 3):
        assert {tuple(r) for r in q.row_difference(a, b, ranges=64, levels=levels).collect()} == want
    differ = q.differing_ranges(*[df.selectExpr("*", "xxhash64(k, v) AS _h", "xxhash64(1, k, v) AS _g", "pmod(xxhash64(1, k, v), 256) AS r") for df in (a, b)], 256, ["r"])
    assert 0 < differ.count() <= len(want)


def test_bitmaps_equal_distinct_counts(spark, micro):
    """Works whose type, year or size is unknown are counted where no filter asks for them."""
    affil, _, member = micro
    cells = c.work_cells(member, affil, ["Department"], ["department"])
    work = spark.createDataFrame([(1, "Article", 2000), (2, None, 2001), (3, "Book", None)], "wid long, work_type string, pub_year int")
    maps = bm.work_bitmaps(cells, bm.numbered_works(member, work))
    count = lambda where: {r["id"]: r["n_works"] for r in bm.count_works(maps.filter(where), "id").collect()}
    assert count(bm.chosen()) == {"10": 4, "20": 2}
    assert count(bm.chosen(["within"])) == {"10": 3, "20": 1}
    assert count(bm.chosen(types=["Article", "Book"])) == {"10": 2}
    assert count(bm.chosen(years=(2000, 2001), cap=20)) == {"10": 2, "20": 1}
    assert bm.count_works(maps, F.lit("x").alias("all")).first()["n_works"] == 4
    with pytest.raises(ValueError):
        bm.chosen(cap=7)
