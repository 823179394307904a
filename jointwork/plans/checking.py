"""Reconciliation, lookup and summary queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from jointwork.model import KINDS
from jointwork.operators import counts as c, extract as ex, lookup as lk, reconcile as q, relations as r, reports as rp
from jointwork.plans.counting import entity_labels, rollup
from jointwork.plans.extracting import ARTICLES, LINES, UNITS
from jointwork.plans.fixture import HOME
from jointwork.plans.registry import register

COLS = ["within_works", "across_works", "inter_works", "across_collabs"]
TWO = """ra AS (SELECT id, COUNT(CASE WHEN m >= 2 THEN 1 END) AS within_works, COUNT(CASE WHEN total > m THEN 1 END) AS across_works,
    COUNT(CASE WHEN n_ext > 0 THEN 1 END) AS inter_works, CAST(SUM(m * (total - m)) AS BIGINT) AS across_collabs
  FROM fx_cells WHERE unit_kind = 'Department' AND level = 'college' GROUP BY id),
rb AS (SELECT c.id, COUNT(CASE WHEN m >= 2 THEN 1 END) AS within_works, COUNT(CASE WHEN t.tot > m THEN 1 END) AS across_works,
    COUNT(CASE WHEN n_ext > 0 THEN 1 END) AS inter_works, CAST(SUM(m * (t.tot - m)) AS BIGINT) AS across_collabs
  FROM fx_cells c JOIN (SELECT m.wid, COUNT(DISTINCT m.pid) AS tot FROM fx_member m JOIN fx_home a ON m.pid = a.pid
    JOIN fx_kind k ON a.unit_type = k.unit_type AND k.unit_kind = 'Department' GROUP BY m.wid) t ON c.wid = t.wid
  WHERE c.unit_kind = 'Department' AND c.level = 'college' GROUP BY c.id)
"""


def two_engines(t):
    """The same counts under both definitions of the internal total."""
    one = lambda scope: c.scope_rollup(c.work_cells(t.member, t.affil, ["Department"], ["college"], scope))
    return one("level"), one("kind")


@register("reconcile_wide", "SELECT COALESCE(ra.id, rb.id) AS id, " + ", ".join(
    f"COALESCE(ra.{x}, 0) AS {x}_a, COALESCE(rb.{x}, 0) AS {x}_b" for x in COLS) + """,
CAST(ra.id IS NULL AS INT) AS missing_a, CAST(rb.id IS NULL AS INT) AS missing_b,
CAST(ra.id IS NULL OR rb.id IS NULL OR """ + " OR ".join(f"COALESCE(ra.{x}, 0) <> COALESCE(rb.{x}, 0)" for x in COLS) + """ AS INT) AS mismatch
FROM ra FULL JOIN rb ON ra.id = rb.id""", ctes=TWO)
def _(t):
    a, b = two_engines(t)
    return q.reconcile(a, b, ["id"], COLS)


@register("bulk_set_diff", """SELECT is_confproc, COUNT(CASE WHEN ia = 1 AND ib = 1 THEN 1 END) AS matched,
COUNT(CASE WHEN ia = 1 AND ib = 0 THEN 1 END) AS missing, COUNT(CASE WHEN ia = 0 AND ib = 1 THEN 1 END) AS extra FROM (
  SELECT doi, pid, is_confproc, MAX(ia) AS ia, MAX(ib) AS ib FROM (
    SELECT upper(doi) AS doi, pid, is_confproc, 1 AS ia, 0 AS ib FROM raw_article WHERE pub_year BETWEEN 1997 AND 1999
    UNION ALL SELECT upper(concat('10.1/ab', CAST(m.wid AS STRING))), m.pid, CAST(m.wid % 7 AS INT), 0, 1 FROM fx_member m
      WHERE m.wid % 7 IN (0, 1)) GROUP BY doi, pid, is_confproc) GROUP BY is_confproc""", ctes=ARTICLES)
def _(t):
    census = ex.in_window(ex.normalise_key(t.raw_articles, "doi"), "pub_year", (1997, 1999)).select("doi", "pid", "is_confproc")
    kind = t.work_all.filter(F.col("work_type").isin("Article", "Conference Proceeding")).select(
        "wid", F.when(F.col("work_type") == "Article", 0).otherwise(1).alias("is_confproc")
    )
    ours = t.member.join(kind, "wid").select(
        F.upper(F.concat(F.lit("10.1/ab"), F.col("wid").cast("string"))).alias("doi"), "pid", "is_confproc"
    )
    return q.set_diff(census, ours, ["is_confproc"])


@register("tolerance_compare", """SELECT id, gap, CASE WHEN gap = 0 THEN 'exact' WHEN gap <= 3 THEN 'small' ELSE 'larger' END AS bucket FROM (
  SELECT ra.id, greatest(abs(ra.within_works - rb.within_works), abs(ra.across_works - rb.across_works)) AS gap
  FROM ra JOIN rb ON ra.id = rb.id)""", ctes=TWO)
def _(t):
    a, b = two_engines(t)
    return q.tolerance(a, b, ["id"], ["within_works", "across_works"], 3)


@register("multiset_equal", """SELECT anchor, COUNT(*) AS n_rows, COUNT(CASE WHEN d <> 0 THEN 1 END) AS n_diff,
CAST(COUNT(CASE WHEN d <> 0 THEN 1 END) = 0 AS INT) AS equal FROM (
  SELECT anchor, partner, works, SUM(d) AS d FROM (
    SELECT anchor, partner, works, 1 AS d FROM fx_punit
    UNION ALL SELECT a, b, works, -1 FROM fx_umatrix WHERE unit_kind = 'Department' AND level = 'department' AND a <> b
    UNION ALL SELECT b, a, works, -1 FROM fx_umatrix WHERE unit_kind = 'Department' AND level = 'department' AND a <> b)
  GROUP BY anchor, partner, works) GROUP BY anchor""")
def _(t):
    ours = r.partner_units(t.member, t.affil).select("anchor", "partner", "works")
    m = r.matrix(t.member, t.affil, "Department").filter("a <> b")
    both = m.select(F.col("a").alias("anchor"), F.col("b").alias("partner"), "works").union(m.select("b", "a", "works"))
    return q.multiset_equal(ours, both, ["anchor"])


@register("missing_work_diag", """SELECT wid, n_people, n_in_window, n_in_department, n_in_program, n_in_medical, n_in_clinical, n_known,
CASE WHEN n_people = 0 THEN 'no match' WHEN n_in_window < n_people THEN 'year outside the window'
  WHEN n_known < n_people THEN 'person in no unit table' ELSE 'dropped by the extract' END AS cause FROM (
  SELECT o.o_orderkey AS wid, COUNT(m.pid) AS n_people, COUNT(CASE WHEN m.inside THEN 1 END) AS n_in_window,
    COUNT(d.pid) AS n_in_department, COUNT(p.pid) AS n_in_program, COUNT(e.pid) AS n_in_medical, COUNT(c.pid) AS n_in_clinical,
    COUNT(COALESCE(d.pid, p.pid, e.pid, c.pid)) AS n_known
  FROM orders o LEFT JOIN (SELECT l_orderkey AS wid, l_suppkey AS pid, bool_or(year(l_shipdate) BETWEEN 1993 AND 1997) AS inside
    FROM lineitem GROUP BY l_orderkey, l_suppkey) m ON o.o_orderkey = m.wid
  LEFT JOIN (SELECT DISTINCT pid FROM ru WHERE unit_type = 'Department' AND inst = 'HOME') d ON m.pid = d.pid
  LEFT JOIN (SELECT DISTINCT pid FROM ru WHERE unit_type = 'Program' AND inst = 'HOME') p ON m.pid = p.pid
  LEFT JOIN (SELECT DISTINCT pid FROM ru WHERE unit_type = 'Medical' AND inst = 'HOME') e ON m.pid = e.pid
  LEFT JOIN (SELECT DISTINCT pid FROM ru WHERE unit_type = 'Clinical' AND inst = 'HOME') c ON m.pid = c.pid GROUP BY o.o_orderkey)""", ctes=UNITS)
def _(t):
    matches = t.read("lineitem").select(
        F.col("l_orderkey").alias("wid"), F.col("l_suppkey").alias("pid"), F.year("l_shipdate").alias("pub_year")
    )
    ours = {name: df.filter(F.col("inst") == HOME) for name, df in t.raw_units.items()}
    return q.missing_diag(t.work_all.select("wid"), matches, ours, (1993, 1997))


CHANGED = """CASE WHEN l_orderkey % 997 = 5 THEN l_linenumber + 10 ELSE l_linenumber END"""


@register("row_difference", f"""SELECT wid, pid, line, CAST(SUM(a) AS BIGINT) AS n_a, CAST(SUM(b) AS BIGINT) AS n_b FROM (
  SELECT l_orderkey AS wid, l_suppkey AS pid, l_linenumber AS line, 1 AS a, 0 AS b FROM lineitem
  UNION ALL SELECT l_orderkey, l_suppkey, {CHANGED}, 0, 1 FROM lineitem WHERE NOT (l_orderkey % 991 = 3 AND l_linenumber = 1)
  UNION ALL SELECT l_orderkey, l_suppkey, l_linenumber, 0, 1 FROM lineitem WHERE l_orderkey % 983 = 7) GROUP BY wid, pid, line
HAVING SUM(a) <> SUM(b)""")
def _(t):
    """A release against the one before: some lines changed, some gone, some twice."""
    cols = [F.col("l_orderkey").alias("wid"), F.col("l_suppkey").alias("pid")]
    lines = t.read("lineitem")
    gone = (F.col("l_orderkey") % 991 == 3) & (F.col("l_linenumber") == 1)
    line = F.when(F.col("l_orderkey") % 997 == 5, F.col("l_linenumber") + 10).otherwise(F.col("l_linenumber"))
    later = lines.filter(~gone).select(*cols, line.alias("line")).union(lines.filter("l_orderkey % 983 = 7").select(*cols, "l_linenumber"))
    return q.row_difference(lines.select(*cols, F.col("l_linenumber").alias("line")), later)


@register("source_presence", """SELECT p.wid, COUNT(DISTINCT p.pid) AS n_broad FROM pat p
WHERE p.wid NOT IN (SELECT wid FROM pat WHERE flag <> 'R') GROUP BY p.wid""", ctes=LINES.rstrip() + """, pat AS (
  SELECT concat('US', CAST(o_orderkey AS STRING)) AS wid, l_suppkey AS pid, l_returnflag AS flag FROM raw_line WHERE o_orderkey % 7 = 5)
""")
def _(t):
    broad = t.raw_patents.select(F.col("patent").alias("wid"), "pid", "returnflag")
    return q.source_presence(broad, broad.filter("returnflag <> 'R'"), broad.select("wid", "pid"))


@register("conflict_ids", """SELECT l_orderkey AS wid, COUNT(DISTINCT year(l_shipdate)) AS n_values,
CAST(MIN(year(l_shipdate)) AS INT) AS lo, CAST(MAX(year(l_shipdate)) AS INT) AS hi FROM lineitem GROUP BY l_orderkey
HAVING COUNT(DISTINCT year(l_shipdate)) > 1""")
def _(t):
    rows = t.read("lineitem").select(F.col("l_orderkey").alias("wid"), F.year("l_shipdate").alias("pub_year"))
    return q.conflicts(rows, "wid", "pub_year")


@register("invariants", """SELECT 'scopes within all' AS rule, COUNT(*) AS checked, CAST(0 AS BIGINT) AS violations FROM (
  SELECT DISTINCT unit_kind, level, id FROM fx_cells)
UNION ALL SELECT 'heads within total', COUNT(*), CAST(0 AS BIGINT) FROM fx_cells
UNION ALL SELECT 'diagonal is within', COUNT(*), CAST(0 AS BIGINT) FROM (
  SELECT DISTINCT id FROM fx_cells WHERE unit_kind = 'Department' AND level = 'department' AND m >= 2)""")
def _(t):
    cells = c.work_cells(t.member, t.affil)
    roll = c.scope_rollup(cells)
    dept = roll.filter("unit_kind = 'Department' AND level = 'department' AND within_works > 0").select("id", "within_works")
    diag = r.matrix(t.member, t.affil, "Department").filter("a = b").select(F.col("a").alias("id"), "works")
    top = F.greatest("within_works", "across_works", "inter_works", "intra_works")
    return q.invariants([
        ("scopes within all", roll, (top <= F.col("all_works")) & (F.col("intra_works") <= F.col("within_works") + F.col("across_works"))),
        ("heads within total", cells, F.col("m") <= F.col("total")),
        ("diagonal is within", dept.join(diag, "id", "full_outer"), F.col("within_works") == F.col("works")),
    ])


# ------------------------------------------------------------- lookup

# Our own aliases for the fixture's unit names.
ALIASES = {"autos": "unit_1", "home goods": "college_2"}
QUESTION_SQL = """quest AS (
  SELECT c_custkey AS qid, concat('How many ', CASE WHEN c_custkey % 3 = 0 THEN 'collaborations' WHEN c_custkey % 3 = 1 THEN 'works'
    ELSE 'top partners' END, ' ', CASE c_custkey % 5 WHEN 0 THEN 'within' WHEN 1 THEN 'ACROSS' WHEN 2 THEN 'intra' WHEN 3 THEN 'inter'
    ELSE 'for' END, ' ', CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'autos' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'Home Goods'
    ELSE concat('Unit_', CAST(c_nationkey AS STRING)) END, ' from ', c_name, '?') AS question FROM customer),
words AS (SELECT lower(trim(split_part(label, ',', 1))) AS word, MIN(id) AS unit_id FROM fx_key
  WHERE level IN ('department', 'college') GROUP BY 1 HAVING length(word) > 2),
qx AS (SELECT qid, lower(question) AS q0, concat(lower(question), CASE WHEN contains(lower(question), 'autos') THEN ' unit_1'
  WHEN contains(lower(question), 'home goods') THEN ' college_2' ELSE '' END) AS q FROM quest),
ukind AS (SELECT id, MIN(unit_kind) AS unit_kind FROM fx_key WHERE level IN ('department', 'college') GROUP BY id),
res AS (SELECT qid, unit_id, word FROM (
  SELECT x.qid, w.unit_id, w.word, row_number() OVER (PARTITION BY x.qid ORDER BY length(w.word) DESC, w.unit_id, w.word) AS rn
  FROM qx x JOIN words w ON contains(x.q, w.word)) WHERE rn = 1)
"""


def questions(t):
    k = F.col("c_custkey")
    ask = F.when(k % 3 == 0, "collaborations").when(k % 3 == 1, "works").otherwise("top partners")
    scope = (
        F.when(k % 5 == 0, "within").when(k % 5 == 1, "ACROSS").when(k % 5 == 2, "intra").when(k % 5 == 3, "inter").otherwise("for")
    )
    what = (
        F.when(F.col("c_mktsegment") == "AUTOMOBILE", "autos").when(F.col("c_mktsegment") == "HOUSEHOLD", "Home Goods")
        .otherwise(F.concat(F.lit("Unit_"), F.col("c_nationkey").cast("string")))
    )
    text = F.concat(F.lit("How many "), ask, F.lit(" "), scope, F.lit(" "), what, F.lit(" from "), F.col("c_name"), F.lit("?"))
    return t.read("customer").select(k.alias("qid"), text.alias("question"))


def resolved(t):
    pool = entity_labels(t).filter("level IN ('department', 'college')").select("id", "label")
    return lk.resolve_unit(questions(t), pool, ALIASES)


@register("resolve_unit_in_text", "SELECT qid, unit_id, word FROM res", ctes=QUESTION_SQL)
def _(t):
    return resolved(t)


@register("question_to_metric", """SELECT x.qid, r.unit_id, k.unit_kind, x.scope, x.metric,
CASE WHEN x.metric = 'partners' THEN COALESCE(p.names, 'none') WHEN x.metric = 'works' THEN COALESCE(CAST(CASE x.scope
    WHEN 'within' THEN v.ww WHEN 'across' THEN v.aw WHEN 'intra' THEN v.nw WHEN 'inter' THEN v.iw ELSE v.lw END AS STRING), 'n/a')
  ELSE COALESCE(CAST(CASE x.scope WHEN 'within' THEN v.wc WHEN 'across' THEN v.ac WHEN 'inter' THEN v.ic END AS STRING), 'n/a') END AS answer
FROM (SELECT qid, CASE WHEN contains(q0, 'within') THEN 'within' WHEN contains(q0, 'across') THEN 'across'
    WHEN contains(q0, 'intra') THEN 'intra' WHEN contains(q0, 'inter') THEN 'inter' ELSE 'all' END AS scope,
    CASE WHEN contains(q0, 'partner') THEN 'partners' WHEN contains(q0, 'collab') THEN 'collabs' ELSE 'works' END AS metric FROM qx) x
JOIN res r ON x.qid = r.qid JOIN ukind k ON r.unit_id = k.id LEFT JOIN (
  SELECT unit_kind, id, COUNT(CASE WHEN m >= 2 THEN 1 END) AS ww, COUNT(CASE WHEN total > m THEN 1 END) AS aw,
    COUNT(CASE WHEN m >= 2 OR total > m THEN 1 END) AS nw, COUNT(CASE WHEN n_ext > 0 THEN 1 END) AS iw,
    COUNT(CASE WHEN m >= 2 OR total > m OR n_ext > 0 THEN 1 END) AS lw, CAST(SUM(m * (m - 1) // 2) AS BIGINT) AS wc,
    CAST(SUM(m * (total - m)) AS BIGINT) AS ac, CAST(SUM(m * n_ext) AS BIGINT) AS ic
  FROM fx_cells WHERE level IN ('department', 'college') GROUP BY unit_kind, id) v ON r.unit_id = v.id AND k.unit_kind = v.unit_kind
LEFT JOIN (SELECT unit_kind, unit, string_agg(concat(partner, ':', CAST(works AS STRING)), ';' ORDER BY works DESC, partner) AS names FROM (
  SELECT unit_kind, unit, partner, works, row_number() OVER (PARTITION BY unit_kind, unit ORDER BY works DESC, partner) AS rn FROM (
    SELECT unit_kind, a AS unit, b AS partner, works FROM fx_umatrix WHERE a <> b
    UNION ALL SELECT unit_kind, b, a, works FROM fx_umatrix WHERE a <> b)) WHERE rn <= 3 GROUP BY unit_kind, unit) p
ON r.unit_id = p.unit AND k.unit_kind = p.unit_kind""", ctes=QUESTION_SQL)
def _(t):
    levels = ["department", "college"]
    roll = c.scope_rollup(c.work_cells(t.member, t.affil, KINDS, levels)).drop("level")
    tops = None
    for kind in KINDS:
        for level in levels:
            part = r.top_partners(r.matrix(t.member, t.affil, kind, level), 3).withColumn("unit_kind", F.lit(kind))
            tops = part if tops is None else tops.unionByName(part)
    # A unit or college that is in both kinds answers as a Department.
    kinds = entity_labels(t).filter(F.col("level").isin(*levels)).groupBy(F.col("id").alias("unit_id")).agg(F.min("unit_kind").alias("unit_kind"))
    return lk.answer(questions(t), resolved(t).join(kinds, "unit_id"), roll, tops)


@register("summary_dataset", """SELECT r.*, COALESCE(p.top_partners, '') AS top_partners FROM roll r LEFT JOIN (
  SELECT unit_kind, level, unit, string_agg(concat(partner, ':', CAST(works AS STRING)), ';' ORDER BY works DESC, partner) AS top_partners FROM (
    SELECT *, row_number() OVER (PARTITION BY unit_kind, level, unit ORDER BY works DESC, partner) AS rn FROM (
      SELECT unit_kind, level, a AS unit, b AS partner, works FROM fx_umatrix WHERE a <> b
      UNION ALL SELECT unit_kind, level, b, a, works FROM fx_umatrix WHERE a <> b)) WHERE rn <= 8 GROUP BY unit_kind, level, unit) p
ON r.unit_kind = p.unit_kind AND r.level = p.level AND r.id = p.unit""", ctes="""roll AS (
SELECT c.unit_kind, c.level, c.id, l.label, COUNT(CASE WHEN m >= 2 THEN 1 END) AS within_works,
COUNT(CASE WHEN total > m THEN 1 END) AS across_works, COUNT(CASE WHEN n_ext > 0 THEN 1 END) AS inter_works,
COUNT(CASE WHEN m >= 2 OR total > m THEN 1 END) AS intra_works,
COUNT(CASE WHEN m >= 2 OR total > m OR n_ext > 0 THEN 1 END) AS all_works,
CAST(SUM(m * (m - 1) // 2) AS BIGINT) AS within_collabs, CAST(SUM(m * (total - m)) AS BIGINT) AS across_collabs,
CAST(SUM(m * n_ext) AS BIGINT) AS inter_collabs
FROM fx_cells c JOIN (SELECT unit_kind, level, id, MIN(label) AS label FROM fx_key GROUP BY unit_kind, level, id) l
ON c.unit_kind = l.unit_kind AND c.level = l.level AND c.id = l.id GROUP BY c.unit_kind, c.level, c.id, l.label)
""")
def _(t):
    tops = None
    for kind in KINDS:
        for level in ("department", "college"):
            part = r.top_partners(r.matrix(t.member, t.affil, kind, level), 8).select(
                F.lit(kind).alias("unit_kind"), F.lit(level).alias("level"), "unit", "partner", "works", "rnk"
            )
            tops = part if tops is None else tops.union(part)
    return rp.summary_dataset(rollup(t), tops)
