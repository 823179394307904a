"""Pairs and detail rows: same pairs by either path, and no shuffle of what can stay where it is."""

import glob
import re
from types import SimpleNamespace

import pytest

from jointwork.operators import extract as ex, network as n, relations as r
from jointwork.operators.skew import pair_up, shared_base
from jointwork.plans import networking as net
from jointwork.plans.fixture import Tables
from jointwork.sources import writers as wr

ROWS = [(1, p, p % 3 == 0, 5) for p in range(5)] + [(2, 1, False, 1), (3, 2, False, 2), (3, 2, True, 2), (None, 1, False, 2), (None, 2, False, 2)]


@pytest.fixture
def unlimited(spark):
    """Without broadcast joins, as on tables too large for them."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def tables(spark):
    member = spark.createDataFrame([(w, p, p == 4, 4, 3) for w in range(3) for p in range(1, 5)], "wid long, pid long, is_ext boolean, n_people long, n_internal long")
    schema = "pid long, is_ext boolean, inst string, unit_type string, unit_id long, unit_label string, college string, discipline string, broad_field string"
    spots = [(p, p == 4, "X" if p == 4 else "HOME", "Department", u, f"U{u}", "C", "D", "F") for p in range(1, 5) for u in (p, p + 1)]
    person = spark.createDataFrame([(p, f"n{p}", "Professor") for p in range(1, 5)], "pid long, pname string, rank string")
    work = spark.createDataFrame([(w, "Book", 1999, "t", "d") for w in range(3)], "wid long, work_type string, pub_year int, title string, detail string")
    return member, spark.createDataFrame(spots, schema), person, work


@pytest.mark.parametrize("ordered", [True, False])
def test_tiles_and_short_groups_give_the_same_pairs(spark, ordered):
    rows = spark.createDataFrame(ROWS, "wid long, pid long, f boolean, size long")
    got = [sorted(pair_up(rows.filter("wid is not null"), "wid", "pid", "size", ordered, rows["f"] if ordered else None, tile).collect()) for tile in (256, 2, 1)]
    assert got[0] and got[0] == got[1] == got[2]


def test_members_are_shuffled_once_for_pairs(unlimited):
    member, affil, _, work = tables(unlimited)
    small = plan(n.pair_works(member)).split("Union")[1].split("SortMergeJoin")[0]
    assert len(re.findall("Exchange hash", small)) == 1


def test_keys_of_a_work_stay_where_it_lies(unlimited):
    member, affil, _, _ = tables(unlimited)
    text = plan(r.partner_units(member, affil, same_kind=False)).split("SortMergeJoin [_g")[0]
    # people by id (two sides), their keys, people of equal keys, works; the result's keys
    assert len(re.findall("Exchange hashpartitioning", text)) <= 6


def test_rows_of_the_fact_are_not_shuffled(unlimited):
    member, affil, person, work = tables(unlimited)
    text = plan(ex.details_base(ex.collab_pairs(member), affil, person, work, "HOME"))
    unfolded = min(m.start() for m in re.finditer("Generate explode\\(_theirs", text))
    above = [line for line in text[:unfolded].splitlines() if "Exchange" in line]
    # only the partner's names come by a shuffle of their own
    assert len(above) == 0
    by_work = ex.both_sides_explode(ex.collab_pairs(member, affil=affil), affil).groupBy("wid", "unit_id").count()
    assert by_work.collect()
    # the branch of large works is empty here and leaves while the query runs
    assert "Exchange" not in plan(by_work).split("== Initial Plan ==")[0].split("Generate explode")[0]


def test_anchor_edges_are_stored_as_parquet(spark, monkeypatch):
    member, affil, person, work = tables(spark)
    t = Tables(spark, "/nowhere")
    t.__dict__.update(member=member, affil=affil, person=person.withColumn("is_ext", person["pid"] == 4))
    edges = net.anchor_edges(t, True)
    assert "parquet" in plan(edges).lower() and edges.count() > 0
    paths = n.shortest_paths(edges, net.path_requests(edges))
    assert {x["status"] for x in paths.collect()} == {"path", "same", "none"}


def test_details_are_written_compressed(spark, tmp_path):
    df = spark.createDataFrame([("a,\"b\"", 1)], "x string, y int")
    wr.write_csv(df, f"{tmp_path}/c", "ISO-8859-1", "gzip")
    assert glob.glob(f"{tmp_path}/c/*.csv.gz")
    assert spark.read.csv(f"{tmp_path}/c", header=True, schema=df.schema, escape='"').collect() == df.collect()
    assert shared_base(spark)


@pytest.fixture
def few_broadcast(spark):
    """Broadcasts of some thousand bytes only: stored tables of a few rows are sent, edges and works are not."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "6000")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_few_people_do_not_shuffle_the_edges(few_broadcast):
    _, affil, _, _ = tables(few_broadcast)
    rows = [("U1", a, b, a * b % 7 + 1, 1, 0, 1) for a in range(1, 60) for b in range(a + 1, 80)]
    ae = wr.stored(few_broadcast.createDataFrame(rows, "anchor string, a long, b long, works long, a_in int, b_in int, rel int"), "edges")
    t = SimpleNamespace(affil=affil)
    visible = net._visible(t, ae)
    assert visible.count() and n.person_graph(ae, visible).count()
    assert "SortMergeJoin" not in plan(n.person_graph(ae, visible))
    assert "SortMergeJoin" not in plan(n.ego(ae, net.strongest(t, ae)))


def test_titles_are_not_broadcast(spark):
    """The works left after the cut go to the titles, though the table of titles is below the limit too."""
    member, _, _, _ = tables(spark)
    work = wr.stored(spark.range(3000).selectExpr("id AS wid", "'Book' AS work_type", "1999 AS pub_year", "concat('t', id) AS title"), "work")
    near = spark.createDataFrame([("U1", 1, 2, 3)], "anchor string, pid long, other long, works long")
    found = n.edge_work_titles(near, member, work)
    assert [r["wid"] for r in found.collect()] == [0, 1, 2]
    sent = plan(found).split("BroadcastExchange")[1]
    assert "cut-" in sent and "title" not in sent.split("FileScan")[1].split("Batched")[0]


def test_compared_entries_are_counted_once(spark):
    entries = spark.createDataFrame([("1", "A", 0, 5), ("2", "A", 0, 4), ("2", "B", 1, 3)], "anchor string, name string, rel int, works long")
    wanted = spark.createDataFrame([("1", "2")], "anchor_a string, anchor_b string")
    found = n.compare_anchors(entries, wanted, (0, 1))
    assert "Window" not in plan(found)
    assert sorted((r["name"], r["side"], r["works_a"], r["works_b"]) for r in found.collect()) == [("A", "shared", 5, 4), ("B", "b", 0, 3)]


def test_pairs_of_files_are_narrow_when_they_are_shuffled(unlimited):
    member, affil, person, work = tables(unlimited)
    rows = n.pair_file_rows(ex.both_sides_explode(ex.collab_pairs(member, affil=affil), affil), work, person)
    assert dict(rows.dtypes)["unit"] == dict(rows.dtypes)["partner_unit"] == "string"
    assert "REPARTITION_BY_COL" in plan(rows)
    found = {(r["unit"], r["rel"], r["pid"], r["partner_unit"], r["cpid"]): r["n_books"] for r in rows.collect()}
    assert found[("2", 0, 1, None, 2)] == 3 and found[("1", 1, 1, "3", 2)] == 3
