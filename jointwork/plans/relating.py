"""Queries on buckets, matrices, partners, anchors and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from jointwork.model import KINDS
from jointwork.operators import counts as c, extract as ex, relations as r, scopes as s
from jointwork.plans.registry import register


@register("anchor_buckets", """SELECT anchor, COUNT(DISTINCT CASE WHEN rel = 0 THEN wid END) AS within_works,
COUNT(DISTINCT CASE WHEN rel = 1 THEN wid END) AS across_works, COUNT(DISTINCT CASE WHEN rel = 2 THEN wid END) AS inter_works
FROM fx_amin GROUP BY anchor""")
def _(t):
    return r.anchor_buckets(t.member, t.affil)


def _matrix(name, kind, level):
    @register(name, f"SELECT a, b, works FROM fx_umatrix WHERE unit_kind = '{kind}' AND level = '{level}'")
    def _(t):
        return r.matrix(t.member, t.affil, kind, level)


for _kind in KINDS:
    _matrix(f"unit_matrix_{_kind.lower()}", _kind, "department")
_matrix("college_matrix", "Department", "college")
_matrix("college_matrix_program", "Program", "college")

_TYPED = """SELECT a, b,
COUNT(DISTINCT CASE WHEN work_type = 'Article' THEN wid END) AS n_articles,
COUNT(DISTINCT CASE WHEN work_type = 'Conference Proceeding' THEN wid END) AS n_confproc,
COUNT(DISTINCT CASE WHEN work_type = 'Book' THEN wid END) AS n_books,
COUNT(DISTINCT CASE WHEN work_type = 'Book Chapter' THEN wid END) AS n_chapters,
COUNT(DISTINCT CASE WHEN work_type = 'Federal Grant' THEN wid END) AS n_grants,
COUNT(DISTINCT CASE WHEN work_type = 'Patent' THEN wid END) AS n_patents,
COUNT(DISTINCT CASE WHEN work_type = 'Clinical Trial' THEN wid END) AS n_trials, COUNT(DISTINCT wid) AS works
FROM (SELECT m.wid, w.work_type, least(k.id, j.id) AS a, greatest(k.id, j.id) AS b
  FROM fx_member m JOIN fx_member n ON m.wid = n.wid AND m.pid <> n.pid JOIN fx_work w ON m.wid = w.wid
  JOIN fx_key k ON m.pid = k.pid JOIN fx_key j ON n.pid = j.pid AND k.unit_kind = j.unit_kind AND k.level = j.level
  WHERE k.level = 'department' AND k.unit_kind = 'Department') GROUP BY a, b"""


@register("matrix_by_type", _TYPED)
def _(t):
    return r.matrix(t.member, t.affil, "Department", "department", t.work_all, by_type=True)


@register("chord_flows", """SELECT a AS source, b AS target, works FROM fx_umatrix
WHERE unit_kind = 'Department' AND level = 'college'
UNION ALL SELECT b, a, works FROM fx_umatrix WHERE unit_kind = 'Department' AND level = 'college' AND a <> b""")
def _(t):
    return r.chord_flows(r.matrix(t.member, t.affil, "Department", "college"))


@register("partner_units", "SELECT anchor, partner, works, pairs FROM fx_punit")
def _(t):
    return r.partner_units(t.member, t.affil)


@register("partner_institutions", "SELECT anchor, inst, works, pairs FROM fx_pinst")
def _(t):
    return r.partner_institutions(t.member, t.affil, t.person)


@register("partner_summed", """SELECT p.anchor, CAST(SUM(p.works) AS BIGINT) AS summed_works, COUNT(*) AS partners,
MAX(d.n) AS distinct_works FROM fx_punit p
JOIN (SELECT anchor, COUNT(DISTINCT wid) AS n FROM fx_amin WHERE rel = 1 GROUP BY anchor) d ON p.anchor = d.anchor
GROUP BY p.anchor""")
def _(t):
    return r.partner_summed(r.partner_units(t.member, t.affil), r.anchor_buckets(t.member, t.affil))


@register("top_partners", """SELECT unit, partner, works, rnk FROM (
  SELECT unit, partner, works, CAST(row_number() OVER (PARTITION BY unit ORDER BY works DESC, partner) AS INT) AS rnk FROM (
    SELECT a AS unit, b AS partner, works FROM fx_umatrix WHERE unit_kind = 'Department' AND level = 'department' AND a <> b
    UNION ALL SELECT b, a, works FROM fx_umatrix WHERE unit_kind = 'Department' AND level = 'department' AND a <> b))
WHERE rnk <= 8""")
def _(t):
    return r.top_partners(r.matrix(t.member, t.affil, "Department"), 8)


@register("unit_partner_list", """SELECT anchor, name, rel, works, pairs, rnk FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY anchor ORDER BY works DESC, name, rel) AS INT) AS rnk FROM fx_entries)
WHERE rnk <= 50""")
def _(t):
    return r.unit_partner_list(r.unit_partner_entries(t.member, t.affil, t.person), "all", 50)


@register("unit_partner_list_across", """SELECT anchor, name, rel, works, pairs, rnk FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY anchor ORDER BY works DESC, name, rel) AS INT) AS rnk
  FROM fx_entries WHERE rel = 1) WHERE rnk <= 25""")
def _(t):
    return r.unit_partner_list(r.unit_partner_entries(t.member, t.affil, t.person), "across", 25)


def _graph(name, level, n):
    @register(name, f"""SELECT a, b, works FROM fx_umatrix m WHERE unit_kind = 'Department' AND level = '{level}' AND a <> b
AND a IN (SELECT id FROM keep) AND b IN (SELECT id FROM keep)""", ctes=f"""keep AS (
  SELECT id FROM (SELECT id, COUNT(DISTINCT wid) AS w FROM fx_pairs WHERE unit_kind = 'Department' AND level = '{level}'
  GROUP BY id) ORDER BY w DESC, id LIMIT {n})
""")
    def _(t):
        cells = c.work_cells(t.member, t.affil, ["Department"], [level])
        nodes = c.scope_rollup(cells).select("id", F.col("all_works").alias("works"))
        return r.unit_graph(nodes, r.matrix(t.member, t.affil, "Department", level), n)


def _graph_nodes(name, level, n):
    @register(name, f"""SELECT id, works, CAST(greatest(0, total - {n}) AS BIGINT) AS dropped FROM (
      SELECT id, works, COUNT(*) OVER () AS total, row_number() OVER (ORDER BY works DESC, id) AS rn FROM (
        SELECT k.id, COUNT(DISTINCT p.wid) AS works FROM (
          SELECT DISTINCT c.id FROM fx_cells c WHERE c.unit_kind = 'Department' AND c.level = '{level}') k
        LEFT JOIN fx_pairs p ON p.id = k.id AND p.unit_kind = 'Department' AND p.level = '{level}' GROUP BY k.id)) WHERE rn <= {n}""")
    def _(t):
        cells = c.work_cells(t.member, t.affil, ["Department"], [level])
        return r.graph_nodes(c.scope_rollup(cells).select("id", F.col("all_works").alias("works")), n)


_graph_nodes("unit_graph_nodes_department", "department", 10)
_graph_nodes("unit_graph_nodes_school", "college", 4)
_graph("unit_graph_department", "department", 10)
_graph("unit_graph_school", "college", 4)


@register("anchor_member_map", "SELECT anchor, pid FROM fx_anchor")
def _(t):
    return r.anchor_members(t.affil)


@register("person_anchor_map", """SELECT pid, COUNT(*) AS n_anchors, string_agg(anchor, ',' ORDER BY anchor) AS anchors
FROM fx_anchor GROUP BY pid""")
def _(t):
    return r.anchors_of_person(r.anchor_members(t.affil))


_NAMES = """names AS (
  SELECT raw, arg_min(key, pri * 1000000 + ord) AS key FROM (
    SELECT raw, pri, key, row_number() OVER (ORDER BY key) AS ord FROM (
      SELECT concat('U', unit_id) AS raw, 1 AS pri, concat('U', unit_id) AS key FROM fx_home
      UNION SELECT concat('C', college), 1, concat('C', college) FROM fx_home WHERE college IS NOT NULL
      UNION SELECT unit_label, 2, concat('U', unit_id) FROM fx_home
      UNION SELECT college, 2, concat('C', college) FROM fx_home WHERE college IS NOT NULL
      UNION SELECT CAST(unit_id AS STRING), 3, concat('U', unit_id) FROM fx_home)) GROUP BY raw)
"""


@register("resolve_anchor", """SELECT c.c_custkey AS req, c.raw, n.key AS anchor FROM (
  SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN concat('U', c_nationkey) WHEN 1 THEN concat('UNIT_', c_nationkey)
    WHEN 2 THEN CAST(c_nationkey AS STRING) ELSE concat('COLLEGE_', c_nationkey) END AS raw FROM customer) c
LEFT JOIN names n ON c.raw = n.raw""", ctes=_NAMES)
def _(t):
    k, nk = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    requests = t.read("customer").select(
        k.alias("req"),
        F.when(k % 4 == 0, F.concat(F.lit("U"), nk)).when(k % 4 == 1, F.concat(F.lit("UNIT_"), nk))
        .when(k % 4 == 2, nk).otherwise(F.concat(F.lit("COLLEGE_"), nk)).alias("raw"),
    )
    return r.resolve_anchor(requests, r.anchor_list(t.affil))


@register("preferred_anchor", """SELECT pid, anchor, CAST(pri AS INT) AS pri FROM (
  SELECT m.pid, m.anchor, p.pri, row_number() OVER (PARTITION BY m.pid ORDER BY p.pri, m.anchor) AS rn FROM fx_anchor m
  JOIN (SELECT DISTINCT x.anchor, CASE WHEN x.anchor = 'U12' THEN 1 WHEN u.unit_type = 'Program' THEN 2
          WHEN u.unit_type = 'Department' THEN 3 ELSE 4 END AS pri
        FROM fx_anchor x LEFT JOIN fx_unit u ON x.anchor = concat('U', u.anchor)) p ON m.anchor = p.anchor) WHERE rn = 1""")
def _(t):
    return r.preferred_anchor(r.anchor_members(t.affil), r.anchor_list(t.affil), "U12", "Program")


# ------------------------------------------------------------- filters


@register("scope_filter", """SELECT s.scope, COUNT(*) AS n_pairs, COUNT(DISTINCT m.wid) AS works FROM fx_minrel m
JOIN (VALUES ('within', 0), ('across', 1), ('intra', 0), ('intra', 1), ('inter', 2), ('all', 0), ('all', 1), ('all', 2))
  s(scope, rel) ON m.rel = s.rel GROUP BY s.scope""")
def _(t):
    from jointwork.model import SCOPES

    rel = c.person_min_rel(t.member, t.affil)
    parts = [
        s.scope_filter(rel, scope).agg(F.count(F.lit(1)).alias("n_pairs"), F.count_distinct("wid").alias("works"))
        .select(F.lit(scope).alias("scope"), "n_pairs", "works")
        for scope in SCOPES
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@register("author_cap", "SELECT wid, pid, n_people FROM fx_member WHERE n_people <= 4")
def _(t):
    return s.author_cap(t.member, 4).select("wid", "pid", "n_people")


@register("type_filter", """SELECT work_type, COUNT(*) AS works FROM fx_work
WHERE work_type IN ('Article', 'Patent') GROUP BY work_type""")
def _(t):
    return s.type_filter(t.work, ["Article", "Patent", "no such type"]).groupBy("work_type").agg(F.count(F.lit(1)).alias("works"))


@register("interdisc_work", "SELECT wid, n_authors, work_type FROM fx_meta WHERE interdisc = 1")
def _(t):
    return s.interdisc_works(c.work_meta(t.member, t.affil, t.work_all)).select("wid", "n_authors", "work_type")


@register("interdisc_row", """SELECT discipline, c_discipline, COUNT(*) AS n_rows, COUNT(DISTINCT wid) AS works
FROM fx_details WHERE discipline <> c_discipline GROUP BY discipline, c_discipline""")
def _(t):
    return s.interdisc_rows(details(t)).groupBy("discipline", "c_discipline").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("wid").alias("works")
    )


def details(t):
    return ex.both_sides_explode(ex.collab_pairs(t.member, affil=t.affil), t.affil)


@register("detail_filters", """SELECT d.wid, d.pid, d.unit_id, d.cpid, d.c_unit_id, w.pub_year, w.title FROM fx_details d
JOIN fx_work w ON d.wid = w.wid WHERE d.college = 'COLLEGE_1' AND d.unit_label = 'UNIT_1' AND w.pub_year IN (1997, 1998)
AND d.c_discipline IN ('DISC_1', 'DISC_4') AND lower(w.title) LIKE '%title 1%' AND lower(w.detail) LIKE '%urgent%'""")
def _(t):
    # Filters on the focal side and on works come before the pairs, those on partners after them.
    own = s.detail_filters(t.affil.filter("NOT is_ext"), "COLLEGE_1", "UNIT_1")
    works = s.detail_filters(t.work_all, years=[1997, 1998], title_contains="Title 1", detail_contains="URGENT")
    rows = ex.both_sides_explode(ex.pairs_of(t.member, own, works), t.affil, own).join(works, "wid")
    return s.detail_filters(rows, partner_disciplines=["DISC_1", "DISC_4"]).select("wid", "pid", "unit_id", "cpid", "c_unit_id", "pub_year", "title")


@register("country_filter", """SELECT unit_label, COUNT(DISTINCT wid) AS works FROM fx_intl
WHERE country IN ('NATION_1', 'NATION_7') AND partner_type = 'Non-Academic' AND is_confproc = 0 GROUP BY unit_label""")
def _(t):
    rows = s.qualifying_rows(t.intl, ["NATION_1", "NATION_7"], "Non-Academic", ["Article"])
    return rows.groupBy("unit_label").agg(F.count_distinct("wid").alias("works"))


@register("name_search", """SELECT pid, pname FROM fx_person WHERE lower(pname) LIKE '%#0000000%'
ORDER BY pname, pid LIMIT 10""")
def _(t):
    return s.name_search(t.person, " #0000000 ").select("pid", "pname")
