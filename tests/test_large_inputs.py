"""What was too slow or too large on larger tables: values stay, and the plan does the smaller work."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from jointwork.functions.text import college_anchor
from jointwork.operators import extract as ex, network as n, reports as rp
from jointwork.operators.skew import chunk_no
from jointwork.plans import catalog
from jointwork.plans.extracting import flat_fact
from jointwork.plans.fixture import Tables
from jointwork.sources import writers as wr

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def apart(spark):
    """Three networks that do not hang together: one dense, a chain and a pair."""
    rng = random.Random(5)
    dense = [(a, b) for a, b in itertools.combinations(range(100, 130), 2) if rng.random() < 0.3]
    chain = [(a, a + 1) for a in range(6)]
    return spark.createDataFrame([*dense, *chain, (500, 501)], "a bigint, b bigint")


def test_parts_of_the_network_are_worked_off_apart(spark, apart, monkeypatch):
    net = n._network(apart)
    assert net.packed.count() == 3 and not net.n_far
    assert {r["part"] for r in net.placed.collect()} == {0, min(r["v"] for r in net.placed.filter("v between 100 and 130").collect()), 500}
    hops = []
    block = n._block_dependencies
    monkeypatch.setattr(n, "_block_dependencies", lambda *args: hops.append(1) or block(*args))
    values = {r["pid"]: r["betweenness"] for r in n.betweenness(apart).collect()}
    assert not hops and [values[i] for i in range(7)] == [i * (6 - i) for i in range(7)]
    # The same hop by hop for the dense part; batches follow from the size of the state.
    monkeypatch.setattr(n, "STATE", 600)
    monkeypatch.setattr(n, "LOCAL", 7)
    assert {r["pid"]: r["betweenness"] for r in n.betweenness(apart).collect()} == pytest.approx(values)
    assert len(hops) >= 2


def test_sources_of_a_part_are_cut_for_tasks(spark, apart, monkeypatch):
    monkeypatch.setattr(n, "STARTS", 4)
    some = apart.select(F.col("a").alias("s")).distinct()
    cut = {r["v"]: (r["delta"], r["squares"]) for r in n._dependencies(n._network(apart), some).collect()}
    monkeypatch.setattr(n, "STARTS", 256)
    whole = {r["v"]: (r["delta"], r["squares"]) for r in n._dependencies(n._network(apart), some).collect()}
    assert cut.keys() == whole.keys() and all(cut[v] == pytest.approx(whole[v]) for v in cut)


def small(spark):
    """Tables of one small data set, with a person who has two rows."""
    t = Tables(spark, SF)
    return t, t.person.union(t.person.orderBy("pid").limit(1))


def test_pairs_bring_names_and_places_to_the_fact(spark):
    t, person = small(spark)
    inst = t.raw_institutions.withColumn("inst_name", F.concat(F.lit("Institution "), "inst"))
    narrow = ex.details_base(ex.collab_pairs(t.member), t.affil, person, t.work_all, "H", inst)
    wide = ex.details_base(ex.collab_pairs(t.member, affil=ex.named_places(t.affil, inst), person=person, also=ex.NAMED), t.affil, person, t.work_all, "H", inst)
    assert wide.count() == narrow.count() > 0 and wide.exceptAll(narrow).isEmpty()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin [cpid" not in flat_fact(t)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_members_reach_their_works_once(spark):
    t = Tables(spark, SF)
    text = ex.membership(t.matches, t.person)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 2  # the same one on both sides of the last join


def test_ties_meet_partners_where_edges_lie(spark, monkeypatch):
    names = "anchor string, a long, b long, works long, a_in int, b_in int, rel int"
    edges = spark.createDataFrame([("U1", 1, 2, 5, 1, 1, 0), ("U1", 1, 3, 4, 1, 0, 1), ("U1", 2, 9, 3, 1, 0, 2), ("U2", 1, 3, 4, 0, 1, 1)], names)
    members = spark.createDataFrame([("U1", 1), ("U1", 2), ("U2", 3), ("C1", 3)], "anchor string, pid long")
    person = spark.createDataFrame([(i, f"n{i}", "I9" if i == 9 else "HOME") for i in (1, 2, 3, 9)], "pid long, pname string, inst string")
    asked = spark.createDataFrame([("U1", "U2", 1), ("U1", "I9", 2), ("U2", "U1", 1), ("U1", "U1", 0)], "anchor string, partner string, rel int")
    ties = n.tie_detail(edges, members, asked, person)
    want = [("U1", "I9", 2, 2, 9, 3), ("U1", "U1", 0, 1, 2, 5), ("U1", "U2", 1, 1, 3, 4), ("U2", "U1", 1, 3, 1, 4)]
    assert sorted(map(tuple, ties.collect())) == want
    assert "SortMergeJoin" not in ties._jdf.queryExecution().executedPlan().toString()
    rows = [(w, p, p == 9, k) for w, ps, k in ((1, (1, 2, 3), 3), (2, (1, 3), 2), (3, (2, 9), 2)) for p in ps]
    member = spark.createDataFrame(rows, "wid long, pid long, is_ext boolean, n_people long")
    work = spark.createDataFrame([(i, f"t{i}", 1999, "Book") for i in (1, 2, 3)], "wid long, title string, pub_year int, work_type string")
    found = n.tie_work_titles(ties, member, person, work)
    assert "[_a" in found._jdf.queryExecution().executedPlan().toString()
    titles = sorted((r["anchor"], r["partner"], r["wid"], r["pair"]) for r in found.collect())
    assert titles == [("U1", "I9", 3, "n2 & n9"), ("U1", "U1", 1, "n1 & n2"), ("U1", "U2", 1, "n1 & n3"), ("U1", "U2", 2, "n1 & n3"), ("U2", "U1", 1, "n3 & n1"), ("U2", "U1", 2, "n3 & n1")]
    monkeypatch.setattr(n, "TILE", 2)  # the first work is a long one now
    again = n.tie_work_titles(ties, member, person, work)
    assert sorted((r["anchor"], r["partner"], r["wid"], r["pair"]) for r in again.collect()) == titles


def test_edges_are_not_stored_twice_nor_shuffled_for_members(spark, monkeypatch):
    kept = []
    whole = n.stored
    monkeypatch.setattr(n, "stored", lambda df, name: kept.append(name) or whole(df, name))
    edges = spark.createDataFrame([("U1", 1, 2, 5, 1), ("U1", 2, 3, 4, 1)], "anchor string, a long, b long, works long, rel int")
    asked = spark.createDataFrame([("r", "U1", 1, 3)], "request string, anchor string, start long, end long")
    assert n.shortest_paths(edges, asked).count() == 3 and "adjacency" not in kept
    members = spark.createDataFrame([("U1", 1), ("U1", 2)], "anchor string, pid long")
    got = n.person_graph_summary(edges, members, n.visible_people(edges, members, 1, 5, 5)).collect()
    assert {"weights", "ends"} <= set(kept)
    assert [tuple(r) for r in got] == [("U1", 2, 1, 2, 2, 1, 0)]


def test_long_tables_are_written_compressed(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(wr, "write_csv", lambda df, path, encoding="UTF-8", compression="none", write=wr.write_csv: seen.append(compression) or write(df, path, encoding, compression))
    rows = {r["tbl"]: r["n_rows"] for r in catalog.QUERIES["write_long_csv"](spark, SF).collect()}
    assert len(rows) == 6 and set(seen) == {"gzip"}


def test_parts_of_a_payload_hold_every_row_and_long_works_are_spread(spark):
    fact = flat_fact(Tables(spark, SF)).filter("UnitId < '3'")
    payload = rp.self_contained_payload(fact, chunk=3)
    back = rp.explode_payload(payload).groupBy("anchor", "wid").count()
    want = fact.select(F.explode(F.array(F.concat(F.lit("U"), "UnitId"), college_anchor(F.col("College")))).alias("anchor"), F.col("Collab_ID").alias("wid")).filter("anchor IS NOT NULL").groupBy("anchor", "wid").count()
    assert back.exceptAll(want).isEmpty() and want.exceptAll(back).isEmpty()
    text = payload.select("rows_by_work")._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in text.splitlines() if "Exchange hashpartitioning(anchor" in x and "wid" in x.split("hashpartitioning")[1].split("ENSURE")[0]]


def test_groups_of_one_part_need_no_digest(spark):
    rows = spark.createDataFrame([("a", 3), ("b", 3), ("a", 90), (None, 3)], "x string, n long").select("x", "n", chunk_no(F.col("x"), F.col("n"), 10).alias("part"))
    got = {(r["x"], r["n"]): r["part"] for r in rows.collect()}
    assert got == {("a", 3): 0, ("b", 3): 0, ("a", 90): 0x0CC175B9 % 9, (None, 3): None}
    assert "CASE WHEN" in rows._jdf.queryExecution().optimizedPlan().toString()


def test_rows_of_a_unit_lie_together_for_their_files(spark):
    t = Tables(spark, SF)
    plan = n.pair_file_rows(ex.both_sides_explode(ex.collab_pairs(t.member, affil=t.affil), t.affil), t.work_all, t.person)._jdf.queryExecution().executedPlan().toString()
    assert [x for x in plan.splitlines() if "REPARTITION_BY_COL" in x and "_share" in x and "unit_id" in x]
