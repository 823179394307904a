"""Queries on the person-pair network."""

from __future__ import annotations

from pyspark.sql import functions as F

from jointwork.functions.expressions import top_k
from jointwork.model import KIND_UNIT_TYPES, SCOPES
from jointwork.operators import network as n, relations as r, scopes as s
from jointwork.plans.registry import register
from jointwork.sources.writers import stored


def edges(t):
    return n.pair_works(t.member, t.work_all)


def anchor_edges(t, keep: bool = False):
    """Edges per anchor.  Queries that read them several times store them
    once (as Parquet) instead of rebuilding the pairs each time."""
    out = s.relate_edges(n.pair_works(t.member), members(t), t.person)
    return stored(out, "anchor-edges") if keep else out


def members(t):
    return r.anchor_members(t.affil)


def strongest(t, ae):
    """One person per anchor, stored for its size: its edges are picked without a shuffle of all others."""
    return stored(n.strongest_people(ae, members(t)), "focus")


@register("pair_works", "SELECT * FROM fx_edges")
def _(t):
    return edges(t)


@register("pair_works_capped", """SELECT a.pid AS a, b.pid AS b, COUNT(*) AS works
FROM fx_member a JOIN fx_member b ON a.wid = b.wid AND a.pid < b.pid AND NOT (a.is_ext AND b.is_ext)
JOIN fx_work w ON a.wid = w.wid WHERE a.n_people <= 3 AND w.work_type IN ('Book', 'Patent') GROUP BY a.pid, b.pid""")
def _(t):
    return n.pair_works(t.member, t.work_all, cap=3, types=["Book", "Patent"]).select("a", "b", "works")


@register("count_distinct_per_type_wide", """SELECT CAST(unit_id AS STRING) AS unit_id,
CASE rel WHEN 0 THEN 'Within Unit' ELSE 'Across Units' END AS scope, pid, cpid,
COUNT(DISTINCT CASE WHEN work_type = 'Article' THEN d.wid END) AS n_articles,
COUNT(DISTINCT CASE WHEN work_type = 'Conference Proceeding' THEN d.wid END) AS n_confproc,
COUNT(DISTINCT CASE WHEN work_type = 'Book' THEN d.wid END) AS n_books,
COUNT(DISTINCT CASE WHEN work_type = 'Book Chapter' THEN d.wid END) AS n_chapters,
COUNT(DISTINCT CASE WHEN work_type = 'Federal Grant' THEN d.wid END) AS n_grants,
COUNT(DISTINCT CASE WHEN work_type = 'Patent' THEN d.wid END) AS n_patents,
COUNT(DISTINCT CASE WHEN work_type = 'Clinical Trial' THEN d.wid END) AS n_trials
FROM fx_details d JOIN fx_work w ON d.wid = w.wid
WHERE rel IN (0, 1) AND unit_type IN ('Department', 'Medical', 'Clinical') GROUP BY unit_id, rel, pid, cpid""")
def _(t):
    return pair_counts(t)


def pair_counts(t, kind="Department"):
    units = t.affil.filter("NOT is_ext").filter(F.col("unit_type").isin(*KIND_UNIT_TYPES[kind])).select(
        "pid", F.col("unit_id").cast("string").alias("unit_id")
    ).distinct()
    return n.pair_type_counts(edges(t), t.affil, units)


@register("relation_for_edge", "SELECT anchor, a, b, works, rel FROM fx_aedges")
def _(t):
    return anchor_edges(t).select("anchor", "a", "b", "works", "rel")


@register("degree", """SELECT pid, COUNT(DISTINCT other) AS degree FROM (
  SELECT a AS pid, b AS other FROM fx_edges UNION ALL SELECT b, a FROM fx_edges) GROUP BY pid""")
def _(t):
    return n.degree(n.pair_works(t.member))


@register("weighted_degree", """SELECT anchor, pid, CAST(SUM(works) AS BIGINT) AS deg,
CAST(SUM(CASE WHEN rel = 1 THEN works ELSE 0 END) AS BIGINT) AS rank_weight FROM fx_arcs GROUP BY anchor, pid""")
def _(t):
    return n.weighted_degree(anchor_edges(t), rank_by=1)


_VISIBLE = """wdeg AS (SELECT anchor, pid, CAST(SUM(works) AS BIGINT) AS deg FROM fx_arcs GROUP BY anchor, pid),
mine AS (SELECT w.* FROM wdeg w JOIN fx_anchor m ON w.anchor = m.anchor AND w.pid = m.pid),
shown AS (SELECT anchor, pid, deg FROM (
  SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY deg DESC, pid) AS rn FROM mine) WHERE rn <= 6),
cand AS (SELECT DISTINCT x.anchor, x.other AS pid FROM fx_arcs x JOIN shown s ON x.anchor = s.anchor AND x.pid = s.pid
  WHERE NOT EXISTS (SELECT 1 FROM shown z WHERE z.anchor = x.anchor AND z.pid = x.other)),
part AS (SELECT anchor, pid, deg FROM (
  SELECT w.*, row_number() OVER (PARTITION BY w.anchor ORDER BY w.deg DESC, w.pid) AS rn
  FROM wdeg w JOIN cand c ON w.anchor = c.anchor AND w.pid = c.pid) WHERE rn <= 8),
vis AS (SELECT anchor, pid, deg, 'anchor' AS role FROM shown UNION ALL SELECT anchor, pid, deg, 'partner' FROM part)
"""


def _visible(t, ae):
    # a few people per anchor, read for both ends of the edges; of a known size, so that edges need not be shuffled for them
    return stored(n.visible_people(ae, members(t), top_anchors=6, partner_limit=10, top_n=8), "visible")


@register("person_graph_nodes", "SELECT anchor, pid, deg, role FROM vis", ctes=_VISIBLE)
def _(t):
    return _visible(t, anchor_edges(t, keep=True))


@register("person_graph", """SELECT e.anchor, e.a, e.b, e.works, e.rel FROM fx_aedges e
JOIN vis v ON e.anchor = v.anchor AND e.a = v.pid JOIN vis z ON e.anchor = z.anchor AND e.b = z.pid""", ctes=_VISIBLE)
def _(t):
    ae = anchor_edges(t, keep=True)
    return n.person_graph(ae, _visible(t, ae))


@register("person_graph_summary", """SELECT m.anchor, m.total_anchors, v.shown_anchors, v.shown_partners,
COALESCE(c.n, 0) AS total_partners, m.total_anchors - v.shown_anchors AS dropped_anchors, COALESCE(c.n, 0) - v.shown_partners AS dropped_partners
FROM (SELECT anchor, COUNT(*) AS total_anchors FROM mine GROUP BY anchor) m
LEFT JOIN (SELECT anchor, COUNT(*) AS n FROM cand GROUP BY anchor) c ON m.anchor = c.anchor
JOIN (SELECT anchor, COUNT(CASE WHEN role = 'anchor' THEN 1 END) AS shown_anchors,
        COUNT(CASE WHEN role = 'partner' THEN 1 END) AS shown_partners FROM vis GROUP BY anchor) v ON m.anchor = v.anchor""",
          ctes=_VISIBLE)
def _(t):
    ae = anchor_edges(t, keep=True)
    return n.person_graph_summary(ae, members(t), _visible(t, ae))


_FOCUS = """wdeg AS (SELECT anchor, pid, SUM(works) AS deg FROM fx_arcs GROUP BY anchor, pid),
focus AS (SELECT anchor, pid FROM (
  SELECT w.anchor, w.pid, row_number() OVER (PARTITION BY w.anchor ORDER BY w.deg DESC, w.pid) AS rn
  FROM wdeg w JOIN fx_anchor m ON w.anchor = m.anchor AND w.pid = m.pid) WHERE rn = 1)
"""


@register("ego_focus", """SELECT anchor, pid, other, works, rel, rnk FROM (
  SELECT x.*, CAST(row_number() OVER (PARTITION BY x.anchor ORDER BY x.works DESC, x.other) AS INT) AS rnk
  FROM fx_arcs x JOIN focus f ON x.anchor = f.anchor AND x.pid = f.pid) WHERE rnk <= 20""", ctes=_FOCUS)
def _(t):
    ae = anchor_edges(t, keep=True)
    return n.ego(ae, strongest(t, ae), 20).select("anchor", "pid", "other", "works", "rel", "rnk")


@register("connections", "SELECT anchor, pid, other, works, rel FROM fx_arcs WHERE pid = 5")
def _(t):
    return n.connections(anchor_edges(t).select("anchor", "a", "b", "works", "rel"), 5)


_COMPARED = """SELECT COALESCE(a.anchor_a, b.anchor_a) AS anchor_a, COALESCE(a.anchor_b, b.anchor_b) AS anchor_b,
COALESCE(a.name, b.name) AS name, COALESCE(a.rel, b.rel) AS rel,
CASE WHEN a.works IS NOT NULL AND b.works IS NOT NULL THEN 'shared' WHEN a.works IS NOT NULL THEN 'a' ELSE 'b' END AS side,
COALESCE(a.works, 0) AS works_a, COALESCE(b.works, 0) AS works_b
FROM (SELECT w.anchor_a, w.anchor_b, k.name, k.rel, k.works FROM wanted w JOIN kept k ON k.anchor = w.anchor_a) a
FULL JOIN (SELECT w.anchor_a, w.anchor_b, k.name, k.rel, k.works FROM wanted w JOIN kept k ON k.anchor = w.anchor_b) b
ON a.anchor_a = b.anchor_a AND a.anchor_b = b.anchor_b AND a.name = b.name AND a.rel = b.rel"""
_COMPARE_CTES = """kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY works DESC, name, rel) AS rn
  FROM fx_entries) WHERE rn <= 12),
wanted AS (SELECT unit AS anchor_a, partner AS anchor_b FROM (
  SELECT unit, partner, row_number() OVER (PARTITION BY unit ORDER BY works DESC, partner) AS rn FROM (
    SELECT a AS unit, b AS partner, works FROM fx_umatrix WHERE unit_kind = 'Department' AND level = 'department' AND a <> b
    UNION ALL SELECT b, a, works FROM fx_umatrix WHERE unit_kind = 'Department' AND level = 'department' AND a <> b)) WHERE rn = 1)
"""


def compared(t, limit):
    entries = r.unit_partner_entries(t.member, t.affil, t.person)
    wanted = r.top_partners(r.matrix(t.member, t.affil, "Department"), 1).select(
        F.col("unit").alias("anchor_a"), F.col("partner").alias("anchor_b")
    )
    return n.compare_anchors(entries, wanted, SCOPES["all"], limit)


@register("compare_anchors", _COMPARED, ctes=_COMPARE_CTES)
def _(t):
    return compared(t, 12)


@register("compare_shared", """SELECT anchor_a, anchor_b, name, CAST(SUM(works_a) AS BIGINT) AS works_a, CAST(SUM(works_b) AS BIGINT) AS works_b,
MIN(rel) AS rel, CAST(SUM(works_a) + SUM(works_b) AS BIGINT) AS works FROM (""" + _COMPARED.replace("rn <= 12", "rn <= 100") + """)
GROUP BY anchor_a, anchor_b, name HAVING SUM(works_a) > 0 AND SUM(works_b) > 0""", ctes=_COMPARE_CTES.replace("rn <= 12", "rn <= 100"))
def _(t):
    return n.compare_shared(compared(t, 100))


@register("compare_totals", """SELECT anchor_a, anchor_b, side, COUNT(*) AS entries, CAST(SUM(works_a) AS BIGINT) AS works_a,
CAST(SUM(works_b) AS BIGINT) AS works_b FROM (""" + _COMPARED + ") GROUP BY anchor_a, anchor_b, side", ctes=_COMPARE_CTES.replace("rn <= 12", "rn <= 100"))
def _(t):
    return n.compare_totals(compared(t, 100))


@register("compare_hidden", """SELECT anchor, COUNT(*) AS eligible, least(COUNT(*), 12) AS shown,
greatest(0, COUNT(*) - 12) AS hidden FROM fx_entries GROUP BY anchor""")
def _(t):
    e = r.unit_partner_entries(t.member, t.affil, t.person).groupBy("anchor").agg(F.count(F.lit(1)).alias("eligible"))
    cap = F.lit(12).cast("bigint")
    return e.select("anchor", "eligible", F.least("eligible", cap).alias("shown"),
                    F.greatest(F.lit(0).cast("bigint"), F.col("eligible") - cap).alias("hidden"))


def path_requests(ae):
    """Per anchor: its smallest and its largest person, its smallest person to itself, and to somebody outside the network."""
    ends = n.both_ways(ae).groupBy("anchor").agg(F.min("pid").alias("lo"), F.max("pid").alias("hi"))
    kinds = F.explode(F.array(
        F.struct(F.lit("far").alias("kind"), F.col("lo").alias("start"), F.col("hi").alias("end")),
        F.struct(F.lit("self").alias("kind"), F.col("lo").alias("start"), F.col("lo").alias("end")),
        F.struct(F.lit("out").alias("kind"), F.col("lo").alias("start"), F.lit(-1).cast("bigint").alias("end")),
    ))
    return ends.select("anchor", kinds.alias("r")).select(F.concat_ws("-", "anchor", "r.kind").alias("request"), "anchor", "r.start", "r.end")


_PATHS = """aends AS (SELECT anchor, MIN(pid) AS lo, MAX(pid) AS hi FROM fx_arcs GROUP BY anchor),
req AS (
  SELECT anchor || '-far' AS request, anchor, lo AS s, hi AS e FROM aends UNION ALL SELECT anchor || '-self', anchor, lo, lo FROM aends
  UNION ALL SELECT anchor || '-out', anchor, lo, -1 FROM aends),
hops(request, anchor, pid, d) AS (
  SELECT request, anchor, s, 0 FROM req
  UNION SELECT h.request, h.anchor, x.other, h.d + 1 FROM hops h JOIN fx_arcs x ON x.anchor = h.anchor AND x.pid = h.pid
  WHERE h.d < (SELECT COUNT(*) FROM fx_person)),
dist AS MATERIALIZED (SELECT request, anchor, pid, MIN(d) AS d FROM hops GROUP BY request, anchor, pid),
prev AS MATERIALIZED (
  SELECT request, anchor, pid, d, src, works, rel FROM (
    SELECT a.request, a.anchor, a.pid, a.d, x.pid AS src, x.works, x.rel,
      row_number() OVER (PARTITION BY a.request, a.pid ORDER BY x.pid) AS rn
    FROM dist a JOIN fx_arcs x ON x.anchor = a.anchor AND x.other = a.pid
    JOIN dist b ON b.request = a.request AND b.pid = x.pid AND b.d = a.d - 1) WHERE rn = 1),
way(request, pid, d, src, works, rel) AS (
  SELECT p.request, p.pid, p.d, p.src, p.works, p.rel FROM prev p JOIN req r ON r.request = p.request AND r.e = p.pid WHERE r.s <> r.e
  UNION ALL SELECT p.request, p.pid, p.d, p.src, p.works, p.rel FROM way w JOIN prev p ON p.request = w.request AND p.pid = w.src)
"""


@register("shortest_path", """SELECT request, 'path' AS status, CAST(d AS INT) AS step, pid, works, CAST(rel AS INT) AS rel FROM way
UNION ALL SELECT r.request, CASE WHEN r.s = r.e THEN 'same' WHEN w.request IS NOT NULL THEN 'path' ELSE 'none' END,
  CASE WHEN r.s = r.e OR w.request IS NOT NULL THEN 0 END, CASE WHEN r.s = r.e OR w.request IS NOT NULL THEN r.s END, NULL, NULL
FROM req r LEFT JOIN (SELECT DISTINCT request FROM way) w ON r.request = w.request""", ctes=_PATHS)
def _(t):
    ae = anchor_edges(t, keep=True)
    return n.shortest_paths(ae, path_requests(ae))


_BETWEEN = """warc2 AS MATERIALIZED (SELECT DISTINCT a AS v, b AS w FROM fx_edges UNION SELECT b, a FROM fx_edges),
reach(s, v, d) AS (
  SELECT DISTINCT v, v, 0 FROM warc2
  UNION SELECT r.s, x.w, r.d + 1 FROM reach r JOIN warc2 x ON x.v = r.v WHERE r.d < (SELECT COUNT(*) FROM fx_person)),
bdist AS MATERIALIZED (SELECT s, v, MIN(d) AS d FROM reach GROUP BY s, v),
paths(s, v, d, sigma) AS (
  SELECT DISTINCT v, v, 0, CAST(1 AS DOUBLE) FROM warc2
  UNION ALL SELECT p.s, x.w, p.d + 1, SUM(p.sigma) FROM paths p JOIN warc2 x ON x.v = p.v
  JOIN bdist b ON b.s = p.s AND b.v = x.w AND b.d = p.d + 1 GROUP BY p.s, x.w, p.d),
sig AS MATERIALIZED (SELECT s, v, d, sigma FROM paths)
"""


@register("betweenness", """SELECT p.pid, round(COALESCE(b.c, 0), 6) AS betweenness FROM (SELECT DISTINCT v AS pid FROM warc2) p LEFT JOIN (
  SELECT a.v AS pid, 0.5 * SUM(a.sigma * c.sigma / st.sigma) AS c FROM sig a JOIN sig c ON c.s = a.v
  JOIN sig st ON st.s = a.s AND st.v = c.v AND st.d = a.d + c.d
  WHERE a.s <> a.v AND c.v <> a.v GROUP BY a.v) b ON b.pid = p.pid""", ctes=_BETWEEN)
def _(t):
    return n.betweenness(n.pair_works(t.member))


@register("betweenness_sampled")
def _(t):
    return n.sampled_betweenness(n.pair_works(t.member), eps=0.1, delta=0.05)


@register("bridge_scholars", """SELECT anchor, pid, n_units, n_collaborators, works, rnk FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY anchor ORDER BY n_units DESC, works DESC, pid) AS INT) AS rnk FROM bscore)
WHERE rnk <= 30""", ctes="""bdet AS (
  SELECT x.anchor, x.pid, x.other, m.anchor AS unit, x.works FROM fx_arcs x
  JOIN fx_anchor f ON x.anchor = f.anchor AND x.pid = f.pid JOIN fx_unit u ON x.anchor = concat('U', u.anchor)
  JOIN fx_anchor m ON m.pid = x.other AND m.anchor <> x.anchor
  JOIN fx_unit v ON m.anchor = concat('U', v.anchor) AND v.unit_type = u.unit_type WHERE x.rel = 1),
bscore AS (
  SELECT b.anchor, b.pid, COUNT(DISTINCT b.unit) AS n_units, MAX(p.n) AS n_collaborators, MAX(p.w) AS works FROM bdet b
  JOIN (SELECT anchor, pid, COUNT(*) AS n, CAST(SUM(works) AS BIGINT) AS w
        FROM (SELECT DISTINCT anchor, pid, other, works FROM bdet) GROUP BY anchor, pid) p
  ON b.anchor = p.anchor AND b.pid = p.pid GROUP BY b.anchor, b.pid)
""")
def _(t):
    return n.bridges(bridge_rows(t), 30)


def bridge_rows(t):
    ours, kinds = unit_members(t)
    return stored(n.bridge_details(s.relate_edges(n.pair_works(t.member), ours, t.person), ours, kinds), "bridges")


def unit_members(t):
    """People of the unit anchors, and the kinds of these: bridges lead from unit to unit, so edges are not unfolded for colleges."""
    kinds = r.anchor_list(t.affil).filter("kind = 'unit'").select(F.col("key").alias("anchor"), "unit_type")
    return members(t).join(kinds, "anchor", "left_semi"), kinds


_BRIDGE = """bdet AS (
  SELECT x.anchor, x.pid, x.other, m.anchor AS unit, x.works FROM fx_arcs x
  JOIN fx_anchor f ON x.anchor = f.anchor AND x.pid = f.pid JOIN fx_unit u ON x.anchor = concat('U', u.anchor)
  JOIN fx_anchor m ON m.pid = x.other AND m.anchor <> x.anchor
  JOIN fx_unit v ON m.anchor = concat('U', v.anchor) AND v.unit_type = u.unit_type WHERE x.rel = 1),
bscore AS (
  SELECT b.anchor, b.pid, COUNT(DISTINCT b.unit) AS n_units, MAX(p.w) AS works FROM bdet b
  JOIN (SELECT anchor, pid, SUM(works) AS w FROM (SELECT DISTINCT anchor, pid, other, works FROM bdet) GROUP BY anchor, pid) p
  ON b.anchor = p.anchor AND b.pid = p.pid GROUP BY b.anchor, b.pid),
brank AS (SELECT anchor, pid, row_number() OVER (PARTITION BY anchor ORDER BY n_units DESC, works DESC, pid) AS rnk FROM bscore),
bties AS (SELECT b.anchor, b.unit, b.pid, CAST(SUM(b.works) AS BIGINT) AS works, MAX(k.rnk) AS rnk FROM bdet b
  JOIN brank k ON b.anchor = k.anchor AND b.pid = k.pid GROUP BY b.anchor, b.unit, b.pid)
"""


@register("bridge_graph", """SELECT b.anchor, b.pid, b.unit, b.works, f.freq FROM bties b JOIN (
  SELECT anchor, unit, freq, row_number() OVER (PARTITION BY anchor ORDER BY freq DESC, unit) AS rn FROM (
    SELECT anchor, unit, COUNT(*) AS freq FROM bties WHERE rnk <= 12 GROUP BY anchor, unit)) f
ON b.anchor = f.anchor AND b.unit = f.unit AND f.rn <= 10 WHERE b.rnk <= 12""", ctes=_BRIDGE)
def _(t):
    rows = bridge_rows(t)
    return n.bridge_graph(rows, n.bridges(rows, 30), units=10)


@register("bridge_unit_ties", "SELECT anchor, unit, pid, works FROM bties WHERE rnk <= 30", ctes=_BRIDGE)
def _(t):
    rows = bridge_rows(t)
    return n.bridge_unit_ties(rows, n.bridges(rows, 30))


@register("person_fingerprint", """SELECT anchor, pid, collaborators, within_works, across_works, inter_works, repeat_partners,
CAST(floor(100.0 * repeat_partners / collaborators + 0.5) AS BIGINT) AS repeat_pct,
CASE WHEN across_works * 1.0 / (within_works + across_works + inter_works) >= 0.45 THEN 'cross-unit connector'
  WHEN inter_works * 1.0 / (within_works + across_works + inter_works) >= 0.5 THEN 'primarily external'
  WHEN repeat_partners * 1.0 / collaborators >= 0.45 THEN 'repeat partnerships' ELSE 'centered on the unit' END AS profile
FROM (SELECT x.anchor, x.pid, COUNT(*) AS collaborators,
  CAST(SUM(CASE WHEN rel = 0 THEN works ELSE 0 END) AS BIGINT) AS within_works,
  CAST(SUM(CASE WHEN rel = 1 THEN works ELSE 0 END) AS BIGINT) AS across_works,
  CAST(SUM(CASE WHEN rel = 2 THEN works ELSE 0 END) AS BIGINT) AS inter_works,
  COUNT(CASE WHEN works > 1 THEN 1 END) AS repeat_partners
  FROM fx_arcs x JOIN fx_anchor m ON x.anchor = m.anchor AND x.pid = m.pid GROUP BY x.anchor, x.pid)""")
def _(t):
    return n.fingerprint(anchor_edges(t), members(t))


@register("fingerprint_institutions", """SELECT anchor, pid, inst, works, rnk FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY anchor, pid ORDER BY works DESC, inst) AS INT) AS rnk FROM (
    SELECT x.anchor, x.pid, p.inst, CAST(SUM(x.works) AS BIGINT) AS works FROM fx_arcs x
    JOIN fx_anchor m ON x.anchor = m.anchor AND x.pid = m.pid JOIN fx_person p ON x.other = p.pid
    WHERE x.rel = 2 GROUP BY x.anchor, x.pid, p.inst)) WHERE rnk <= 5""")
def _(t):
    return n.top_institutions(anchor_edges(t), members(t), t.person)


_TIES = """arc2 AS (
  SELECT x.* FROM fx_arcs x JOIN fx_anchor m ON x.anchor = m.anchor AND x.pid = m.pid
  LEFT JOIN fx_anchor o ON x.anchor = o.anchor AND x.other = o.pid WHERE o.pid IS NULL OR x.pid < x.other),
ties AS (
  SELECT x.anchor, m.anchor AS partner, x.rel, x.pid, x.other, x.works FROM arc2 x JOIN fx_anchor m ON m.pid = x.other WHERE x.rel <> 2
  UNION ALL SELECT x.anchor, p.inst, x.rel, x.pid, x.other, x.works FROM arc2 x JOIN fx_person p ON p.pid = x.other WHERE x.rel = 2),
best AS (SELECT anchor, partner, rel FROM (
  SELECT concat('U', anchor) AS anchor, inst AS partner, 2 AS rel, row_number() OVER (PARTITION BY anchor ORDER BY works DESC, inst) AS rn
  FROM fx_pinst) WHERE rn = 1
  UNION ALL SELECT anchor, partner, rel FROM (
  SELECT concat('U', anchor) AS anchor, concat('U', partner) AS partner, 1 AS rel,
    row_number() OVER (PARTITION BY anchor ORDER BY works DESC, partner) AS rn FROM fx_punit) WHERE rn = 1)
"""


@register("tie_detail", """SELECT anchor, partner, rel, pid, other, works FROM ties
WHERE (partner, anchor, rel) IN (SELECT (partner, anchor, rel) FROM best)""", ctes=_TIES)
def _(t):
    return best_ties(t)


def best_ties(t):
    """Person pairs behind each unit's strongest partner unit and institution."""
    u = lambda c: F.concat(F.lit("U"), F.col(c))
    inst = top_k(r.partner_institutions(t.member, t.affil, t.person), 1, [F.desc("works"), F.asc("inst")], ["anchor"])
    unit = top_k(r.partner_units(t.member, t.affil), 1, [F.desc("works"), F.asc("partner")], ["anchor"])
    best = inst.select(u("anchor").alias("anchor"), F.col("inst").alias("partner"), F.lit(2).alias("rel")).union(
        unit.select(u("anchor"), u("partner"), F.lit(1))
    )
    return n.tie_detail(anchor_edges(t), members(t), best, t.person)


@register("tie_work_titles", """SELECT x.anchor, x.partner, x.rel, x.rnk, x.wid, concat(p.pname, ' & ', q.pname) AS pair, w.title, w.pub_year, w.work_type FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY anchor, partner, rel ORDER BY works DESC, pid, other, wid) AS INT) AS rnk FROM (
    SELECT t.*, a.wid, row_number() OVER (PARTITION BY t.anchor, t.partner, t.rel, a.wid ORDER BY t.works DESC, t.pid, t.other) AS first_rn
    FROM ties t JOIN best b ON t.anchor = b.anchor AND t.partner = b.partner AND t.rel = b.rel
    JOIN fx_member a ON a.pid = t.pid JOIN fx_member o ON o.pid = t.other AND o.wid = a.wid) WHERE first_rn = 1) x
JOIN fx_person p ON x.pid = p.pid JOIN fx_person q ON x.other = q.pid JOIN fx_work w ON x.wid = w.wid WHERE x.rnk <= 150""", ctes=_TIES)
def _(t):
    # read for short and for long works
    return n.tie_work_titles(stored(best_ties(t), "ties"), t.member, t.person, t.work_all, 150)


@register("node_partners", """SELECT node, COUNT(*) AS partners, CAST(SUM(works) AS BIGINT) AS cross_links FROM (
  SELECT a AS node, works FROM fx_umatrix WHERE unit_kind = 'Department' AND level = 'department' AND a <> b
  UNION ALL SELECT b, works FROM fx_umatrix WHERE unit_kind = 'Department' AND level = 'department' AND a <> b) GROUP BY node""")
def _(t):
    return n.node_partners(r.matrix(t.member, t.affil, "Department").filter("a <> b"))


@register("edge_work_titles", """SELECT c.anchor, c.wid, c.other, c.rnk, w.title, w.pub_year, w.work_type FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY anchor ORDER BY works DESC, other, wid) AS INT) AS rnk FROM (
    SELECT x.anchor, a.wid, x.other, x.works,
      row_number() OVER (PARTITION BY x.anchor, a.wid ORDER BY x.works DESC, x.other) AS first_rn
    FROM fx_arcs x JOIN focus f ON x.anchor = f.anchor AND x.pid = f.pid
    JOIN fx_member a ON a.pid = x.pid JOIN fx_member b ON b.pid = x.other AND a.wid = b.wid) WHERE first_rn = 1) c
JOIN fx_work w ON c.wid = w.wid WHERE c.rnk <= 60""", ctes=_FOCUS)
def _(t):
    ae = anchor_edges(t, keep=True)
    near = n.both_ways(ae.select("anchor", "a", "b", "works", "rel")).join(strongest(t, ae), ["anchor", "pid"], "left_semi")
    return n.edge_work_titles(stored(near, "near"), t.member, t.work_all, 60)
