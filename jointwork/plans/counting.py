"""Queries on works and pairs per key and per person."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from jointwork.model import KINDS, LEVELS
from jointwork.operators import counts as c, extract as ex
from jointwork.plans.registry import register


@register("membership", "SELECT wid, pid, is_ext, n_people, n_internal FROM fx_member")
def _(t):
    return ex.membership(t.matches, t.person).select("wid", "pid", "is_ext", "n_people", "n_internal")


@register("ext_per_work", "SELECT wid, n_ext FROM fx_ext")
def _(t):
    return c.ext_per_work(t.member)


@register("internal_per_work",
          "SELECT wid, COUNT(DISTINCT pid) AS n_internal FROM fx_member WHERE NOT is_ext GROUP BY wid")
def _(t):
    return c.internal_per_work(t.member)


@register("work_type", """SELECT m.wid, MIN(w.work_type) AS work_type FROM fx_member m JOIN fx_work w ON m.wid = w.wid
GROUP BY m.wid""")
def _(t):
    return c.work_type(t.member.join(t.work_all, "wid"))


@register("work_meta", "SELECT * FROM fx_meta")
def _(t):
    return c.work_meta(t.member, t.affil, t.work_all)


@register("interdisc_flag", """SELECT m.wid, CASE WHEN COUNT(DISTINCT discipline) > 1 THEN 1 ELSE 0 END AS interdisc
FROM fx_member m JOIN fx_home a ON m.pid = a.pid GROUP BY m.wid""")
def _(t):
    return c.interdisciplinary(t.member, t.affil)


def _unit_pairs(kind, level):
    @register(f"unit_pairs_{kind.lower()}_{level}", f"""SELECT unit_kind, level, id, category, wid, pairs FROM fx_pairs
WHERE unit_kind = '{kind}' AND level = '{level}'""")
    def _(t):
        return c.unit_pairs(t.member, t.affil, kind, level)


for _kind in KINDS:
    for _level in ("department", "college"):
        _unit_pairs(_kind, _level)


@register("unit_pairs_college_kind_total", """SELECT c.id, CAST(SUM(c.m * (t.total - c.m)) AS BIGINT) AS across_pairs
FROM fx_cells c JOIN (
  SELECT m.wid, COUNT(DISTINCT m.pid) AS total FROM fx_member m JOIN fx_home a ON m.pid = a.pid
  JOIN fx_kind k ON a.unit_type = k.unit_type WHERE k.unit_kind = 'Department' GROUP BY m.wid) t ON c.wid = t.wid
WHERE c.unit_kind = 'Department' AND c.level = 'college' GROUP BY c.id""")
def _(t):
    cells = c.work_cells(t.member, t.affil, ["Department"], ["college"], total_scope="kind")
    return c.scope_rollup(cells).select("id", F.col("across_collabs").alias("across_pairs"))


@register("institution_pairs",
          "SELECT unit_kind, level, id, category, wid, pairs FROM fx_pairs WHERE level = 'institution'")
def _(t):
    return c.institution_pairs(t.member, t.affil)


@register("entity_meta", """SELECT unit_kind, level, k.id, MIN(k.label) AS label, MIN(a.college) AS college
FROM fx_key k JOIN fx_home a ON k.pid = a.pid AND (
  (k.level = 'department' AND CAST(a.unit_id AS STRING) = k.id) OR (k.level = 'college' AND a.college = k.id)
  OR (k.level = 'institution' AND a.inst = k.id))
GROUP BY unit_kind, level, k.id""")
def _(t):
    return entity_labels(t)


def entity_labels(t):
    parts = [c.entity_meta(t.affil, k, v) for k in KINDS for v in LEVELS]
    return reduce(lambda a, b: a.union(b), parts)


@register("person_min_rel", "SELECT pid, wid, cpid, rel FROM fx_minrel")
def _(t):
    return c.person_min_rel(t.member, t.affil)


def _person_pairs(kind):
    @register(f"person_pairs_{kind.lower()}", f"""SELECT '{kind}' AS unit_kind, pid AS id,
CASE rel WHEN 0 THEN 'within' WHEN 1 THEN 'across' ELSE 'inter' END AS category, wid, COUNT(DISTINCT cpid) AS pairs
FROM fx_minrel WHERE pid IN (SELECT a.pid FROM fx_home a JOIN fx_kind k ON a.unit_type = k.unit_type
  WHERE k.unit_kind = '{kind}') GROUP BY pid, rel, wid""")
    def _(t):
        return c.person_pairs(c.person_work_counts(t.member, t.affil), t.affil, kind)

    @register(f"person_meta_{kind.lower()}", f"""SELECT '{kind}' AS unit_kind, a.pid AS id, MIN(p.pname) AS label,
MIN(p.rank) AS rank, string_agg(DISTINCT a.discipline, '|' ORDER BY a.discipline) AS disc,
COALESCE(string_agg(DISTINCT a.college, '|' ORDER BY a.college), '') AS college,
string_agg(DISTINCT a.unit_label, '|' ORDER BY a.unit_label) AS units
FROM fx_home a JOIN fx_kind k ON a.unit_type = k.unit_type JOIN fx_person p ON a.pid = p.pid
WHERE k.unit_kind = '{kind}' GROUP BY a.pid""")
    def _(t):
        return c.person_meta(t.person, t.affil, kind)


for _kind in KINDS:
    _person_pairs(_kind)


@register("person_disc", """SELECT DISTINCT k.unit_kind, a.pid, a.discipline FROM fx_home a
JOIN fx_kind k ON a.unit_type = k.unit_type WHERE a.discipline IS NOT NULL""")
def _(t):
    from jointwork.model import kinds_of

    return (
        t.affil.filter("NOT is_ext AND discipline IS NOT NULL")
        .select(F.explode(kinds_of(F.col("unit_type"))).alias("unit_kind"), "pid", "discipline")
        .distinct()
    )


ROLLUP_SQL = """SELECT c.unit_kind, c.level, c.id, l.label, COUNT(CASE WHEN m >= 2 THEN 1 END) AS within_works,
COUNT(CASE WHEN total > m THEN 1 END) AS across_works, COUNT(CASE WHEN n_ext > 0 THEN 1 END) AS inter_works,
COUNT(CASE WHEN m >= 2 OR total > m THEN 1 END) AS intra_works,
COUNT(CASE WHEN m >= 2 OR total > m OR n_ext > 0 THEN 1 END) AS all_works,
CAST(SUM(m * (m - 1) // 2) AS BIGINT) AS within_collabs, CAST(SUM(m * (total - m)) AS BIGINT) AS across_collabs,
CAST(SUM(m * n_ext) AS BIGINT) AS inter_collabs
FROM fx_cells c JOIN (SELECT unit_kind, level, id, MIN(label) AS label FROM fx_key GROUP BY unit_kind, level, id) l
ON c.unit_kind = l.unit_kind AND c.level = l.level AND c.id = l.id
WHERE {cond} GROUP BY c.unit_kind, c.level, c.id, l.label"""


def rollup(t, kinds=KINDS, levels=LEVELS):
    return c.scope_rollup(c.work_cells(t.member, t.affil, kinds, levels), entity_labels(t))


@register("scope_rollup", ROLLUP_SQL.format(cond="c.unit_kind = 'Department' AND c.level = 'department'"))
def _(t):
    return rollup(t, ["Department"], ["department"])


@register("institution_rollup", ROLLUP_SQL.format(cond="c.level = 'institution'"))
def _(t):
    return rollup(t, KINDS, ["institution"])


@register("rollup_levels", ROLLUP_SQL.format(cond="TRUE"))
def _(t):
    return rollup(t)


@register("set_rollup", """SELECT unit_kind, level, id,
COUNT(DISTINCT CASE WHEN category = 'within' THEN wid END) AS within_set,
COUNT(DISTINCT CASE WHEN category = 'across' THEN wid END) AS across_set,
COUNT(DISTINCT CASE WHEN category = 'inter' THEN wid END) AS inter_set,
COUNT(DISTINCT CASE WHEN category <> 'inter' THEN wid END) AS intra_set,
COUNT(DISTINCT wid) AS all_set FROM fx_pairs GROUP BY unit_kind, level, id""")
def _(t):
    return c.set_rollup(c.work_cells(t.member, t.affil))


@register("anchor_works_per_person", """SELECT pid, COUNT(DISTINCT wid) AS works FROM fx_minrel
WHERE rel IN (0, 1) AND wid IN (SELECT wid FROM fx_work WHERE work_type IN ('Article', 'Book')) GROUP BY pid""")
def _(t):
    wc = c.person_work_counts(t.member, t.affil)
    return c.works_per_person(wc, t.work_all, "intra", ["Article", "Book"])


@register("multi_affil_people", """SELECT a.unit_id, a.pid, b.n_units, b.units FROM (
  SELECT DISTINCT unit_id, pid FROM fx_home WHERE unit_type IN ('Department', 'Medical', 'Clinical')) a
JOIN (SELECT pid, COUNT(DISTINCT unit_id) AS n_units,
        array_to_string(list_sort(list_distinct(list(unit_id))), ',') AS units
      FROM fx_home WHERE unit_type IN ('Department', 'Medical', 'Clinical')
      GROUP BY pid HAVING COUNT(DISTINCT unit_id) > 1) b ON a.pid = b.pid""")
def _(t):
    return c.multi_affil_people(t.affil)


@register("within_defs_compare", """SELECT COALESCE(a.id, b.id) AS id, COUNT(a.wid) AS works_a, COUNT(b.wid) AS works_b,
COUNT(CASE WHEN b.wid IS NULL THEN 1 END) AS a_only, COUNT(CASE WHEN a.wid IS NULL THEN 1 END) AS b_only
FROM (SELECT id, wid FROM fx_cells WHERE unit_kind = 'Department' AND level = 'department' AND m >= 2) a
FULL JOIN (SELECT DISTINCT CAST(unit_id AS STRING) AS id, wid FROM fx_details
  WHERE rel = 0 AND unit_type IN ('Department', 'Medical', 'Clinical')) b ON a.id = b.id AND a.wid = b.wid
GROUP BY COALESCE(a.id, b.id)""")
def _(t):
    cells = c.work_cells(t.member, t.affil, ["Department"], ["department"])
    return c.within_defs_compare(cells, c.person_min_rel(t.member, t.affil), t.affil, "Department")


@register("dedup_nodupkey", """SELECT CAST(unit_id AS STRING) AS unit_id, rel, COUNT(*) AS n_rows FROM (
  SELECT DISTINCT unit_id, rel, pid, cpid, wid FROM fx_details
  WHERE unit_type IN ('Department', 'Medical', 'Clinical')) GROUP BY unit_id, rel""")
def _(t):
    from jointwork.operators.reports import detail_keys

    return detail_keys(t.member, t.affil, "Department").groupBy("unit_id", "rel").agg(F.count(F.lit(1)).alias("n_rows"))


@register("dup_factor", """SELECT unit_id, SUM(n) AS n_rows, COUNT(*) AS n_keys, ROUND(AVG(n), 4) AS avg_dup, MAX(n) AS max_dup
FROM (SELECT unit_id, pid, wid, inst_id, COUNT(*) AS n FROM (
  SELECT i.unit_id, i.pid, i.wid, i.inst_id FROM fx_intl i JOIN lineitem l ON i.wid = l.l_orderkey AND i.pid = l.l_suppkey)
  GROUP BY unit_id, pid, wid, inst_id) GROUP BY unit_id""".replace("SUM(n) AS", "CAST(SUM(n) AS BIGINT) AS"))
def _(t):
    from jointwork.operators.trends import dup_factor

    rows = t.intl.join(t.matches, ["wid", "pid"])
    return dup_factor(rows, ["pid", "wid", "inst_id"], "unit_id")
