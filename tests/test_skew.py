"""One work with 20,000 people must not be one row, and its counts must be right."""

import collections
import itertools
import random
import re

from pyspark.sql import functions as F

from jointwork.operators import bitmaps as bm, counts as c, network as n, relations as r

N = 20_000


def case(spark):
    """Work 1 has everybody, works 2..60 a few; people have one to three units of 30, every fifth is external."""
    rng = random.Random(4)
    units, ext = {}, {}
    for p in range(N):
        ext[p] = p % 5 == 0
        units[p] = sorted(rng.sample(range(30), rng.choice([1, 1, 1, 2, 3]))) if p % 11 else []
    works = {1: list(range(N))} | {w: rng.sample(range(N), rng.randrange(2, 9)) for w in range(2, 61)}
    rows = [(w, p, ext[p], len(ps), sum(not ext[p] for p in ps)) for w, ps in works.items() for p in ps]
    member = spark.createDataFrame(rows, "wid long, pid long, is_ext boolean, n_people long, n_internal long").repartition(8)
    places = [(p, ext[p], "HOME", "Department" if u % 3 else "Medical", u, f"U{u}", f"C{u % 4}") for p, us in units.items() for u in us]
    affil = spark.createDataFrame(places, "pid long, is_ext boolean, inst string, unit_type string, unit_id long, unit_label string, college string")
    return works, units, ext, member, affil


def heads(works, units, ext, w):
    """People and people in common per unit (internal people only)."""
    one, two = collections.Counter(), collections.Counter()
    for p in works[w]:
        if not ext[p]:
            one.update(units[p])
            two.update(itertools.permutations(units[p], 2))
    return one, two


def test_matrix_partners_and_person_counts(spark):
    works, units, ext, member, affil = case(spark)
    matrix, partners = collections.Counter(), {}
    for w in works:
        one, two = heads(works, units, ext, w)
        for a, b in itertools.product(one, one):
            a_, b_ = str(a), str(b)
            if a == b and one[a] > 1:
                matrix[a_, a_] += 1
            if a_ < b_ and one[a] * one[b] > two[a, b]:
                matrix[a_, b_] += 1
            if a != b and (a % 3 == 0) == (b % 3 == 0) and one[b] > two[a, b]:
                n, pairs = partners.get((a_, b_), (0, 0))
                partners[a_, b_] = (n + 1, pairs + one[a] * (one[b] - two[a, b]))
    found = r.matrix(member, affil, "Department").collect()
    assert {(x["a"], x["b"]): x["works"] for x in found} == matrix
    found = r.partner_units(member, affil).collect()
    assert {(x["anchor"], x["partner"]): (x["works"], x["pairs"]) for x in found} == partners
    got = {(x["pid"], x["wid"]): (x["within"], x["across"], x["inter"]) for x in c.person_work_counts(member, affil).collect()}
    assert len(got) == sum(not ext[p] for ps in works.values() for p in ps)
    rng = random.Random(1)
    inside = [p for p in range(N) if not ext[p]]
    for w, p in [(1, p) for p in rng.sample(inside, 60)] + [(w, p) for w in range(2, 61) for p in works[w] if not ext[p]]:
        near = sum(q != p and not ext[q] and bool(set(units[p]) & set(units[q])) for q in works[w])
        total = sum(not ext[q] for q in works[w])
        assert got[p, w] == (near, total - 1 - near, len(works[w]) - total)


def test_no_row_holds_a_work(spark):
    """The widest row of the matrices is one key's list of other keys; the counts have none at all."""
    _, _, _, member, affil = case(spark)
    widest = r.key_heads(member, affil, None).agg(F.max(F.size("both"))).first()[0]
    assert widest <= 30
    assert not [t for _, t in c.person_work_counts(member, affil).dtypes if t.startswith(("array", "map"))]


def test_rows_per_work_are_not_broadcast(spark, tmp_path):
    """Tables that grow with the works meet by sort and merge, however small the planner takes them to be."""
    def table(rows, schema):
        path = f"{tmp_path}/{next(serial)}"
        spark.createDataFrame(rows, schema).write.parquet(path)
        return spark.read.parquet(path)

    serial = itertools.count()
    member = table([(1, 1, False, 2, 2), (1, 2, False, 2, 2)], "wid long, pid long, is_ext boolean, n_people long, n_internal long")
    places = [(p, False, "HOME", "Department", p, f"U{p}", "C") for p in (1, 2)]
    affil = table(places, "pid long, is_ext boolean, inst string, unit_type string, unit_id long, unit_label string, college string")
    work = table([(1, "Book", 1999, "t")], "wid long, work_type string, pub_year int, title string")
    person = table([(1, "a", "HOME"), (2, "b", "HOME")], "pid long, pname string, inst string")
    ties = table([("U1", "U2", 1, 1, 2, 1)], "anchor string, partner string, rel int, pid long, other long, works long")
    frames = {
        "cells": c.work_cells(member, affil), "matrix": r.matrix(member, affil, "Department"), "partner units": r.partner_units(member, affil),
        "institutions": r.partner_institutions(member, affil, person), "numbered": bm.numbered_works(member, work),
        "edges": n.pair_works(member, work),
    }
    for name, df in frames.items():
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"BroadcastHashJoin \[(wid|w#)", plan), name
    plan = n.tie_work_titles(ties, member, person, work)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"SortMergeJoin \[(pid|wid)#", plan)) >= 2
