"""Paths, bridges, reports and streams on small fixtures."""

import os

import pytest
from pyspark.sql import functions as F

from jointwork.operators import counts as c, extract as ex, network as n, reconcile as q, reports as rp
from jointwork.operators.lookup import resolve_unit
from jointwork.plans.fixture import Tables
from jointwork.sources import readers as rd, writers as wr

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def chain(spark):
    rows = [(i, i + 1, 10 + i) for i in range(6)] + [(0, 9, 1), (9, 4, 1), (20, 21, 5)]
    return spark.createDataFrame([(min(a, b), max(a, b), w) for a, b, w in rows], "a bigint, b bigint, works bigint")


def paths(spark, edges, requests):
    asked = spark.createDataFrame(requests, "request string, anchor string, start bigint, end bigint")
    rows = n.shortest_paths(edges.selectExpr("'x' AS anchor", "a", "b", "works", "CAST(works % 3 AS INT) AS rel"), asked).collect()
    return {q[0]: sorted((r["status"], r["step"], r["pid"], r["works"], r["rel"]) for r in rows if r["request"] == q[0]) for q in requests}


def test_shortest_paths(spark, chain):
    got = paths(spark, chain, [("there", "x", 0, 6), ("back", "x", 6, 0), ("none", "x", 0, 21), ("same", "x", 3, 3), ("null", "x", None, 3), ("other", "y", 0, 6)])
    assert [r[1:4] for r in got["there"]] == [(0, 0, None), (1, 9, 1), (2, 4, 1), (3, 5, 14), (4, 6, 15)]
    assert [r[4] for r in got["there"]] == [None, 1, 1, 2, 0]
    assert got["back"][-1][1:4] == (4, 0, 1)
    assert got["same"] == [("same", 0, 3, None, None)]
    assert [got[k][0][0] for k in ("none", "null", "other")] == ["none"] * 3


def test_paths_and_betweenness_have_no_hop_limit(spark):
    """A chain longer than any earlier limit; JOINTWORK_ALL=1 takes 100 people."""
    k = 100 if os.environ.get("JOINTWORK_ALL") else 34
    line = spark.createDataFrame([(i, i + 1, 1) for i in range(k)], "a bigint, b bigint, works bigint").coalesce(1)
    got = paths(spark, line, [("end", "x", 0, k)])["end"]
    assert len(got) == k + 1 and got[-1][1:3] == (k, k)
    k = 70 if os.environ.get("JOINTWORK_ALL") else 12
    short = spark.createDataFrame([(i, i + 1) for i in range(k)], "a bigint, b bigint").coalesce(1)
    middle = {r["pid"]: r["betweenness"] for r in n.betweenness(short, batch=k // 2).collect()}
    assert all(middle[i] == i * (k - i) for i in range(k + 1))


def test_betweenness_against_brute_force(spark, chain):
    """Count shortest paths through every person with plain BFS."""
    adj = {}
    for x in chain.collect():
        adj.setdefault(x["a"], set()).add(x["b"])
        adj.setdefault(x["b"], set()).add(x["a"])

    def all_shortest(s, t):
        level = [[s]]
        seen = {s}
        while level:
            done = [p for p in level if p[-1] == t]
            if done:
                return done
            nxt = [p + [w] for p in level for w in adj[p[-1]] if w not in seen]
            seen |= {p[-1] for p in nxt}
            level = nxt
        return []

    want = dict.fromkeys(adj, 0.0)
    for s in adj:
        for t in adj:
            paths = all_shortest(s, t) if s < t else []
            for p in paths:
                for v in p[1:-1]:
                    want[v] += 1 / len(paths)
    got = {x["pid"]: x["betweenness"] for x in n.betweenness(chain).collect()}
    assert got == pytest.approx(want, abs=1e-5)


def test_payload_parts_stand_alone_and_hold_every_row(spark):
    t = Tables(spark, SF)
    few = t.member.filter("wid < 300")
    fact = wr.stored(ex.details_base(ex.collab_pairs(few), t.affil, t.person, t.work_all, "HOME"), "fact")
    payload = wr.stored(rp.self_contained_payload(fact, chunk=60), "payload")
    lengths = F.aggregate(F.map_values("rows_by_work"), F.lit(0), lambda m, r: m + F.size(r))
    assert payload.select(F.max(lengths)).first()[0] < 300 and payload.groupBy("anchor").count().agg(F.max("count")).first()[0] > 3
    # Every work and person of a part is described in it, and nothing else is.
    used = F.array_distinct(F.flatten(F.transform(F.flatten(F.map_values("rows_by_work")), lambda r: F.array(r["pid"], r["cpid"]))))
    same = lambda x, y: (F.size(x) == F.size(y)) & (F.size(F.array_except(x, y)) == 0)
    bad = payload.filter(~same(used, F.map_keys("people")) | ~same(F.map_keys("works"), F.map_keys("rows_by_work")))
    assert bad.count() == 0
    back = wr.stored(rp.explode_payload(payload), "back")
    names = {"name": "PersonName", "rank": "Rank", "c_name": "Collab_PersonName", "title": "Collab_Title", "type": "CollaborationType", "year": "Year", "detail": "Collab_Detail", "wid": "Collab_ID"}
    columns = {**rp.PAYLOAD_ROW, **names}
    want = fact.withColumn("anchor", F.explode(F.array_compact(F.array(F.concat(F.lit("U"), "UnitId"), F.concat(F.lit("C"), "College")))))
    want = want.select("anchor", *[F.col(c_).alias(n_) for n_, c_ in columns.items()])
    assert q.row_difference(back.select(*want.columns), want, ranges=16).count() == 0


def test_nested_export_is_cut_into_parts(spark):
    t = Tables(spark, SF)
    pairs = c.institution_pairs(t.member, t.affil)
    meta = c.entity_meta(t.affil, "Department", "institution").union(c.entity_meta(t.affil, "Program", "institution"))
    nested = rp.export_nested(pairs, meta, chunk=100)
    assert nested.count() > 10
    total = nested.select(F.sum(F.size("within") + F.size("across") + F.size("inter"))).first()[0]
    assert total == pairs.count()


def test_details_csv_round_trip_skips_short_rows(spark, tmp_path):
    t = Tables(spark, SF)
    d = ex.details_base(ex.collab_pairs(t.member), t.affil, t.person, t.work_all, "HOME").filter("UnitId = '200'")
    out = str(tmp_path / "details")
    wr.write_csv(d, out, "ISO-8859-1")
    names = d.columns
    line = lambda **k: ",".join(k.get(c, "x") for c in names)
    (tmp_path / "details" / "part-hand.csv").write_text("\n".join([
        ",".join(names), "HOME,HOME,short", line(Collab_Title='"A ""quoted"", comma title"', Year="1999"),
        line(Collab_Title='"Tail ""q"""', Year="not a year"),
    ]) + "\n")
    back = rd.read_details(spark, out)
    assert back.count() == d.count() + 2
    hand = {r["Collab_Title"]: r["Year"] for r in back.filter("PersonId = 'x'").collect()}
    assert hand == {'A "quoted", comma title': 1999, 'Tail "q"': None}
    assert rd.skipped_details(spark, out).first()["skipped"] == 1


def test_quotes_survive_our_own_writer(spark, tmp_path):
    df = spark.createDataFrame([('say "hi", you', "b"), ("back\\slash", '"')], "x string, y string")
    wr.write_csv(df, str(tmp_path / "q"))
    got = rd.read_csv_positional(spark, str(tmp_path / "q"), df.schema)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))


def test_ids_over_six_digits_and_works_without_discipline(spark):
    affil = spark.createDataFrame(
        [(1, False, "H", "Department", u, f"U{u}", None, None, None) for u in (1234567, 1234568)],
        "pid bigint, is_ext boolean, inst string, unit_type string, unit_id bigint, unit_label string, college string, discipline string, broad_field string")
    assert {r["units"] for r in c.multi_affil_people(affil).collect()} == {"1234567,1234568"}
    member = spark.createDataFrame([(9, 1, False, 1, 1)], "wid bigint, pid bigint, is_ext boolean, n_people bigint, n_internal bigint")
    no_work = spark.createDataFrame([], "wid bigint, work_type string, pub_year int, title string, detail string")
    assert [(r["wid"], r["n_authors"], r["title"]) for r in c.work_meta(member, affil, no_work).collect()] == [(9, 1, None)]


def test_missing_keys_match_missing_keys(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, v int")
    assert q.reconcile(a, a, ["k"], ["v"]).filter("mismatch = 1 or missing_a = 1").count() == 0


def test_long_college_names_and_other_years(spark):
    from jointwork.operators import trends as tr

    long = "A college with a very long name that goes on and on"
    intl = spark.createDataFrame(
        [(1, 1, "Department", 5, "U", long + " one", 7, "X", 1980), (2, 1, "Department", 5, "U", long + " two", 7, "X", 2030)],
        "wid bigint, pid bigint, unit_type string, unit_id bigint, unit_label string, college string, inst_id bigint, country string, pub_year int")
    assert {r["anchor"] for r in tr.by_anchor(intl).collect()} == {"U5", "C" + long + " one", "C" + long + " two"}
    assert tr.country_year(intl).first().asDict() == {"country": "X", "y1980": 1, "y2030": 1}


def test_a_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    from jointwork.operators import skew

    class Context:
        master, applicationId = "spark://host:7077", "app"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError):
        skew.shared_base(Session())
    Context.master = "local[2]"
    assert skew.shared_base(Session())


def test_sampled_betweenness_keeps_its_error(spark):
    """A ring of cliques: exact values within the stated error, fewer sources than people, errors within the scale."""
    import itertools

    pairs = [(5 * g + i, 5 * g + j) for g in range(30) for i, j in itertools.combinations(range(5), 2)]
    pairs += [(min(5 * g, 5 * ((g + 1) % 30)), max(5 * g, 5 * ((g + 1) % 30))) for g in range(30)]
    edges = spark.createDataFrame([(a, b, 1) for a, b in pairs], "a bigint, b bigint, works bigint")
    exact = {r["pid"]: r["betweenness"] for r in n.betweenness(edges).collect()}
    found = n.sampled_betweenness(edges, eps=0.9, delta=0.05, first=40).collect()
    people = 150
    assert {r["pid"] for r in found} == exact.keys()
    assert {r["n_sources"] for r in found} <= {40, 80}
    assert all(abs(r["betweenness"] - exact[r["pid"]]) <= r["error"] <= 0.9 * people * (people - 2) / 2 for r in found)
    whole = n.sampled_betweenness(edges, eps=1e-6, delta=0.05).collect()
    assert all(r["error"] == 0 and r["n_sources"] == people and abs(r["betweenness"] - exact[r["pid"]]) < 1e-4 for r in whole)
    assert n.sampled_betweenness(edges.limit(0), 0.1, 0.1).count() == 0


def test_one_work_with_very_many_people_is_tiled(spark):
    people = spark.range(3000).select(F.lit("article").alias("source"), F.lit(1).cast("bigint").alias("wid"), F.col("id").alias("pid"))
    members = ex.sided_members(people.filter("pid < 50"), people, people.filter("pid >= 10"), people.filter("pid <> 7"))
    pairs = ex.sided_pairs(members)
    assert pairs.columns == ["source", "wid", "pid", "cpid"]
    assert pairs.count() == 40 * 2998  # 40 focal people of ours, 2,999 known partners without oneself


def test_sides_of_a_work_come_from_their_own_tables(spark):
    rows = lambda *r: spark.createDataFrame(r, "source string, wid string, pid long")
    ids = lambda *i: spark.createDataFrame([(x,) for x in i], "pid long")
    focal = rows(("a", "1", 1), ("a", "1", 2), ("b", "1", 1), ("b", "2", 9), ("b", "3", 1), ("b", "3", 1))
    partners = rows(("a", "1", 2), ("a", "1", 3), ("a", "1", 8), ("b", "2", 1), ("b", "3", 1), ("c", "4", 1), ("c", "4", 2))
    members = ex.sided_members(focal, partners, ids(1, 2), ids(1, 2, 3))
    got = sorted((r["source"], r["wid"], r["pid"], r["f"], r["p"], r["n_people"]) for r in members.collect())
    # Work b/1 has one person, b/2 no focal one, b/3 one on both sides, c/4 no focal row; 8 is unknown.
    assert got == [("a", "1", 1, True, False, 3), ("a", "1", 2, True, True, 3), ("a", "1", 3, False, True, 3)]
    assert sorted(map(tuple, ex.sided_pairs(members).collect())) == [("a", "1", 1, 2), ("a", "1", 1, 3), ("a", "1", 2, 3)]


def test_duplicated_input_changes_nothing(spark):
    t = Tables(spark, SF)
    twice = ex.membership(t.matches.union(t.matches), t.person)
    a = c.scope_rollup(c.work_cells(twice, t.affil))
    b = c.scope_rollup(c.work_cells(t.member, t.affil))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_longest_unit_name_wins(spark):
    units = spark.createDataFrame([("1", "Math, Department of"), ("2", "Applied Math, The"), ("3", "Bio"), ("4", "AB")], "id string, label string")
    asked = spark.createDataFrame([(1, "works of APPLIED MATH within?"), (2, "ab"), (3, "bio or math"), (4, "the zoo")], "qid int, question string")
    got = {x["qid"]: x["unit_id"] for x in resolve_unit(asked, units, {"zoo": "bio"}).collect()}
    assert got == {1: "2", 3: "1", 4: "3"}


def test_reconcile_flags(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, v int")
    b = spark.createDataFrame([("x", 1), ("y", 5), ("z", 0)], "k string, v int")
    got = {x["k"]: (x["mismatch"], x["missing_a"]) for x in q.reconcile(a, b, ["k"], ["v"]).collect()}
    assert got == {"x": (0, 0), "y": (1, 0), "z": (1, 1)}
    buckets = {x["k"]: x["bucket"] for x in q.tolerance(a, b, ["k"], ["v"], 2).collect()}
    assert buckets == {"x": "exact", "y": "larger", "z": "exact"}


def test_betweenness_meets_arcs_by_blocks(spark, monkeypatch):
    """Many blocks and matrices of a few cells give the values of one; a start outside the network counts for nobody."""
    star = spark.createDataFrame([(0, i) for i in range(1, 9)] + [(1, 2)], "a bigint, b bigint").coalesce(1)
    monkeypatch.setattr(n, "BLOCK", 2)
    monkeypatch.setattr(n, "CELLS", 3)
    got = {r["pid"]: r["betweenness"] for r in n.betweenness(star).collect()}
    assert got == {0: 27.0, **dict.fromkeys(range(1, 9), 0.0)}
    arcs, n_blocks = n._arc_blocks(star)
    rows = spark.createDataFrame([(7, 0, 2.0), (7, 99, 5.0)], "s bigint, v bigint, x double")
    assert {(r["s"], r["v"], r["x"]) for r in n._spread(rows, arcs, n_blocks).collect()} == {(7, i, 2.0) for i in range(1, 9)}


def test_bridges_unfold_edges_for_units_only(spark):
    """College anchors were built too and then left out."""
    from jointwork.plans import networking

    t = Tables(spark, SF)
    ours, kinds = networking.unit_members(t)
    assert {x[0][0] for x in ours.select("anchor").distinct().collect()} == {"U"}
    every = n.bridge_details(networking.anchor_edges(t), networking.members(t), kinds)
    assert sorted(map(tuple, networking.bridge_rows(t).collect())) == sorted(map(tuple, every.collect()))
