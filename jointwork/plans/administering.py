"""Administrator metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from jointwork.functions.expressions import split_pipe
from jointwork.operators import admin as ad, counts as c, relations as r
from jointwork.operators.skew import cut_lineage
from jointwork.plans.registry import register

BASE = """rost AS (
  SELECT dept, pid, MIN(CASE WHEN trim(rank) = 'Professor' THEN 'Professor' WHEN trim(rank) LIKE 'Associate%' THEN 'Associate Professor'
    WHEN trim(rank) LIKE 'Assistant%' THEN 'Assistant Professor' ELSE 'Other ranks' END) AS rank FROM fx_roster GROUP BY dept, pid),
rcoll AS (SELECT dept, MIN(college) AS college FROM fx_roster GROUP BY dept),
act AS (SELECT DISTINCT a.unit_label AS dept, a.pid FROM fx_home a JOIN fx_member m ON a.pid = m.pid
  WHERE a.unit_type IN ('Department', 'Medical', 'Clinical')),
ptot AS (SELECT pid, COUNT(CASE WHEN across > 0 THEN 1 END) AS n_across, COUNT(CASE WHEN inter > 0 THEN 1 END) AS n_inter
  FROM fx_ppw WHERE pid IN (SELECT pid FROM act) GROUP BY pid),
dlab AS (SELECT CAST(unit_id AS STRING) AS id, MIN(unit_label) AS dept, MIN(college) AS college FROM fx_home
  WHERE unit_type IN ('Department', 'Medical', 'Clinical') GROUP BY unit_id),
dwork AS (
  SELECT l.dept, l.college, COUNT(CASE WHEN m >= 2 THEN 1 END) AS within, COUNT(CASE WHEN total > m THEN 1 END) AS across,
    COUNT(CASE WHEN n_ext > 0 THEN 1 END) AS inter, COUNT(CASE WHEN m >= 2 OR total > m OR n_ext > 0 THEN 1 END) AS alls,
    COUNT(CASE WHEN (m >= 2 OR total > m OR n_ext > 0) AND f.interdisc = 1 THEN 1 END) AS idisc
  FROM fx_cells c JOIN dlab l ON c.id = l.id JOIN fx_meta f ON c.wid = f.wid
  WHERE c.unit_kind = 'Department' AND c.level = 'department' GROUP BY l.dept, l.college),
dmet AS (
  SELECT COALESCE(w.dept, f.dept) AS dept, CASE WHEN w.dept IS NULL THEN f.college ELSE w.college END AS college, f.faculty,
    COALESCE(a.n, 0) AS active, CAST((COALESCE(a.n, 0) * 2000 + f.faculty) // (2 * f.faculty) AS BIGINT) / 10.0 AS pct_active,
    COALESCE(w.within, 0) AS within, COALESCE(w.across, 0) AS across, COALESCE(w.inter, 0) AS inter,
    CAST((COALESCE(w.across, 0) * 200 + COALESCE(f.faculty, a.n)) // (2 * COALESCE(f.faculty, a.n)) AS BIGINT) / 100.0 AS across_per_faculty,
    CAST((COALESCE(w.inter, 0) * 200 + COALESCE(f.faculty, a.n)) // (2 * COALESCE(f.faculty, a.n)) AS BIGINT) / 100.0 AS inter_per_faculty,
    COALESCE(CASE WHEN w.alls > 0 THEN CAST((w.idisc * 2000 + w.alls) // (2 * w.alls) AS BIGINT) / 10.0 END, 0.0) AS interdisc_pct,
    w.dept IS NULL AS zero_collab
  FROM dwork w LEFT JOIN (SELECT dept, COUNT(DISTINCT pid) AS n FROM act GROUP BY dept) a ON w.dept = a.dept
  FULL JOIN (SELECT r.dept, COUNT(DISTINCT r.pid) AS faculty, MIN(q.college) AS college FROM rost r JOIN rcoll q ON r.dept = q.dept
    GROUP BY r.dept) f ON w.dept = f.dept)
"""


def roster(t):
    return ad.roster_load(t.roster)


def active(t):
    return ad.active_dept_people(t.affil, t.member)


def totals(t, act=None):
    return ad.person_totals(c.person_work_counts(t.member, t.affil), (act or active(t)).select("pid").distinct())


def cells(t):
    return c.work_cells(t.member, t.affil, ["Department"], ["department"])


def metrics(t):
    flags = c.interdisciplinary(t.member, t.affil)
    return ad.dept_metrics(cells(t), c.entity_meta(t.affil, "Department", "department"), roster(t), active(t), flags)


@register("roster_load", "SELECT r.dept, r.pid, r.rank, q.college FROM rost r LEFT JOIN rcoll q ON r.dept = q.dept", ctes=BASE)
def _(t):
    return roster(t)


@register("dept_metrics", "SELECT * FROM dmet", ctes=BASE)
def _(t):
    return metrics(t)


@register("roster_only_depts", """SELECT dept, COUNT(DISTINCT pid) AS faculty, CAST(0 AS BIGINT) AS works FROM rost
WHERE dept NOT IN (SELECT dept FROM act) GROUP BY dept""", ctes=BASE)
def _(t):
    return ad.roster_only_depts(roster(t), active(t))


@register("rank_engagement", """SELECT r.dept, r.rank, COUNT(*) AS faculty,
CAST((COUNT(a.pid) * 2000 + COUNT(*)) // (2 * COUNT(*)) AS BIGINT) / 10.0 AS pct_any,
CAST((COUNT(CASE WHEN a.pid IS NOT NULL AND p.n_across > 0 THEN 1 END) * 2000 + COUNT(*)) // (2 * COUNT(*)) AS BIGINT) / 10.0 AS pct_across
FROM rost r LEFT JOIN act a ON r.dept = a.dept AND r.pid = a.pid LEFT JOIN ptot p ON r.pid = p.pid GROUP BY r.dept, r.rank""", ctes=BASE)
def _(t):
    act = active(t)
    return ad.rank_engagement(roster(t), act, totals(t, act))


@register("rank_lens", """SELECT rank, COUNT(*) AS n, CAST((COUNT(n_across) * 2000 + COUNT(*)) // (2 * COUNT(*)) AS BIGINT) / 10.0 AS pct_active,
CAST((COUNT(CASE WHEN n_across > 0 THEN 1 END) * 2000 + COUNT(*)) // (2 * COUNT(*)) AS BIGINT) / 10.0 AS pct_across,
median(COALESCE(n_across, 0)) AS med_across,
CAST((COUNT(CASE WHEN n_inter > 0 THEN 1 END) * 2000 + COUNT(*)) // (2 * COUNT(*)) AS BIGINT) / 10.0 AS pct_inter,
median(COALESCE(n_inter, 0)) AS med_inter
FROM (SELECT pid, MIN(rank) AS rank FROM rost GROUP BY pid) r LEFT JOIN ptot p ON r.pid = p.pid GROUP BY rank""", ctes=BASE)
def _(t):
    return ad.rank_lens(roster(t), totals(t))


@register("retention", """SELECT q.dept, q.pid, q.across, q.inter, q.unique_works, q.rnk, p.pname AS name, COALESCE(r.rank,
  CASE WHEN p.rank = 'Professor' THEN 'Professor' WHEN p.rank LIKE 'Associate%' THEN 'Associate Professor'
    WHEN p.rank LIKE 'Assistant%' THEN 'Assistant Professor' ELSE 'Other ranks' END) AS rank FROM (
  SELECT a.dept, a.pid, p.n_across AS across, p.n_inter AS inter, COALESCE(u.n, 0) AS unique_works,
    CAST(row_number() OVER (PARTITION BY a.dept ORDER BY COALESCE(u.n, 0) DESC, p.n_across DESC, a.pid) AS INT) AS rnk
  FROM act a JOIN ptot p ON a.pid = p.pid LEFT JOIN (
    SELECT dept, pid, COUNT(*) AS n FROM (
      SELECT a.dept, w.pid, w.wid, COUNT(*) OVER (PARTITION BY a.dept, w.wid) AS cover FROM fx_ppw w JOIN act a ON w.pid = a.pid
      WHERE w.across > 0) WHERE cover = 1 GROUP BY dept, pid) u ON a.dept = u.dept AND a.pid = u.pid) q
LEFT JOIN fx_person p ON q.pid = p.pid LEFT JOIN (SELECT pid, MIN(rank) AS rank FROM rost GROUP BY pid) r ON q.pid = r.pid WHERE rnk <= 8""", ctes=BASE)
def _(t):
    act = active(t)
    wc = cut_lineage(c.person_work_counts(t.member, t.affil))
    return ad.retention(wc, act, ad.person_totals(wc, act.select("pid").distinct()), t.person, roster(t))


VEC = BASE.rstrip() + """, vec AS (SELECT a.dept, d.discipline, COUNT(*) AS n FROM act a JOIN (
  SELECT DISTINCT pid, discipline FROM fx_home WHERE unit_type IN ('Department', 'Medical', 'Clinical')) d ON a.pid = d.pid
  GROUP BY a.dept, d.discipline)
"""


def vectors(t, act):
    return ad.discipline_vector(t.affil, act)


@register("discipline_vector", "SELECT dept, discipline, n FROM vec", ctes=VEC)
def _(t):
    return vectors(t, active(t))


@register("whitespace_pairs", """SELECT s.a, s.b, ca.college AS college_a, cb.college AS college_b, s.sa AS size_a, s.sb AS size_b, ROUND(s.sim, 3) AS sim, s.actual, s.score, x.shared_disc
FROM best s JOIN (SELECT a, b, string_agg(discipline, ',' ORDER BY low DESC, discipline) AS shared_disc FROM (
  SELECT m.a, m.b, m.discipline, least(m.na, m.nb) AS low,
    row_number() OVER (PARTITION BY m.a, m.b ORDER BY least(m.na, m.nb) DESC, m.discipline) AS rn FROM met m) WHERE rn <= 5
  GROUP BY a, b) x ON s.a = x.a AND s.b = x.b LEFT JOIN dmet ca ON s.a = ca.dept LEFT JOIN dmet cb ON s.b = cb.dept""", ctes=VEC.rstrip() + """,
sizes AS (SELECT dept, COALESCE(faculty, active) AS size FROM dmet WHERE COALESCE(faculty, active) >= 8),
nrm AS (SELECT v.dept, sqrt(SUM(n * n)) AS norm FROM vec v JOIN sizes s ON v.dept = s.dept GROUP BY v.dept),
met AS (SELECT x.dept AS a, y.dept AS b, x.discipline, x.n AS na, y.n AS nb FROM vec x JOIN vec y ON x.discipline = y.discipline
  AND x.dept < y.dept WHERE x.dept IN (SELECT dept FROM sizes) AND y.dept IN (SELECT dept FROM sizes)),
umat AS (SELECT least(p.dept, q.dept) AS a, greatest(p.dept, q.dept) AS b, m.works FROM fx_umatrix m JOIN dlab p ON m.a = p.id
  JOIN dlab q ON m.b = q.id WHERE m.unit_kind = 'Department' AND m.level = 'department' AND m.a <> m.b),
sims AS (SELECT a, b, SUM(na * nb) / (MAX(p.norm) * MAX(q.norm)) AS sim FROM met JOIN nrm p ON met.a = p.dept JOIN nrm q ON met.b = q.dept
  GROUP BY a, b),
best AS (SELECT s.a, s.b, x.size AS sa, y.size AS sb, s.sim, COALESCE(u.works, 0) AS actual,
    ROUND(s.sim / (1 + COALESCE(u.works, 0) / sqrt(x.size * y.size)), 4) AS score
  FROM sims s JOIN sizes x ON s.a = x.dept JOIN sizes y ON s.b = y.dept LEFT JOIN umat u ON s.a = u.a AND s.b = u.b
  WHERE s.sim >= 0.04 ORDER BY score DESC, s.a, s.b LIMIT 30)
""")
def _(t):
    act = active(t)
    # departments times disciplines: small, and read several times below
    sizes, vec = cut_lineage(ad.dept_sizes(roster(t), act)), cut_lineage(vectors(t, act))
    labels = c.entity_meta(t.affil, "Department", "department").select("id", "label")
    m = r.matrix(t.member, t.affil, "Department").filter("a <> b")
    named = (
        m.join(labels.select(F.col("id").alias("a"), F.col("label").alias("la")), "a")
        .join(labels.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b")
        .select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b"), "works")
    )
    return ad.whitespace_pairs(vec, sizes, cut_lineage(named), metrics(t).select("dept", "college")).drop("rnk")


@register("exec_summary", """SELECT (SELECT COUNT(*) FROM fx_uni) AS universe, (SELECT COUNT(DISTINCT pid) FROM act) AS scholars,
(SELECT COUNT(DISTINCT pid) FROM rost) AS faculty_total,
CAST(((SELECT COUNT(DISTINCT pid) FROM act) * 2000 + (SELECT COUNT(DISTINCT pid) FROM rost)) // (2 * (SELECT COUNT(DISTINCT pid) FROM rost)) AS BIGINT) / 10.0 AS pct_faculty_active,
(SELECT COUNT(*) FROM fx_uni WHERE n_internal >= 2) AS internal_works, (SELECT COUNT(*) FROM fx_uni WHERE n_people > n_internal) AS external_works,
(SELECT COUNT(DISTINCT wid) FROM fx_pairs WHERE unit_kind = 'Department' AND level = 'department' AND category = 'across') AS cross_unit_works,
CAST(((SELECT COUNT(*) FROM fx_meta WHERE interdisc = 1) * 2000 + (SELECT COUNT(*) FROM fx_uni)) // (2 * (SELECT COUNT(*) FROM fx_uni)) AS BIGINT) / 10.0 AS interdisc_pct,
(SELECT COUNT(DISTINCT dept) FROM dmet) AS dept_count""",
          ctes=BASE)
def _(t):
    units = c.entity_meta(t.affil, "Department", "department")
    return ad.exec_summary(t.member, roster(t), c.interdisciplinary(t.member, t.affil), cells(t), active(t), units)


@register("exec_connected", """SELECT 'top' AS list, CAST(row_number() OVER (ORDER BY rate DESC, dept) AS INT) AS rnk, dept, rate, faculty
FROM (SELECT dept, COALESCE(across_per_faculty, 0.0) AS rate, faculty FROM dmet WHERE COALESCE(faculty, 0) >= 10 ORDER BY rate DESC, dept LIMIT 5)
UNION ALL SELECT 'least', CAST(row_number() OVER (ORDER BY rate, dept) AS INT), dept, rate, faculty
FROM (SELECT dept, COALESCE(across_per_faculty, 0.0) AS rate, faculty FROM dmet WHERE COALESCE(faculty, 0) >= 10 ORDER BY rate, dept LIMIT 5)""",
          ctes=BASE)
def _(t):
    return ad.most_and_least_connected(metrics(t))


@register("type_mix", "SELECT work_type, COUNT(*) AS works FROM fx_work GROUP BY work_type")
def _(t):
    return ad.type_mix(t.work)


@register("split_pipe", """SELECT DISTINCT a.pid, a.unit_label AS unit FROM fx_home a
WHERE a.unit_type IN ('Department', 'Medical', 'Clinical')""")
def _(t):
    meta = c.person_meta(t.person, t.affil, "Department", sep=" | ")
    return meta.select(F.col("id").alias("pid"), F.explode(split_pipe(F.col("units"))).alias("unit"))
