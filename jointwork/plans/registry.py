"""Registry of named queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jointwork.plans.fixture import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PRELUDE = """WITH RECURSIVE fx_person AS (
  SELECT s_suppkey AS pid, s_name AS pname, CAST(s_nationkey AS BIGINT) AS nk, s_suppkey % 4 = 3 AS is_ext,
         CASE WHEN s_suppkey % 4 = 3 THEN concat('INST_', CAST(s_suppkey % 24 AS STRING)) ELSE 'HOME' END AS inst,
         CASE WHEN s_suppkey % 5 <= 1 THEN 'Professor' WHEN s_suppkey % 5 = 2 THEN 'Associate Professor'
              WHEN s_suppkey % 5 = 3 THEN 'Assistant Professor' ELSE 'Other' END AS rank
  FROM supplier),
fx_aff0 AS (
  SELECT pid, is_ext, inst, 'Department' AS unit_type, nk AS u0 FROM fx_person
  UNION SELECT pid, is_ext, inst, 'Department', (nk + 7) % 25 FROM fx_person WHERE pid % 5 = 0
  UNION SELECT pid, is_ext, inst, 'Program', 100 + nk % 10 FROM fx_person
  UNION SELECT pid, is_ext, inst, 'Medical', 200 + pid % 2 FROM fx_person WHERE pid % 17 = 0),
fx_affil AS (
  SELECT pid, is_ext, inst, unit_type,
         CASE WHEN is_ext THEN u0 + 1000 * (1 + pid % 24) ELSE u0 END AS unit_id,
         concat('UNIT_', CAST(u0 AS STRING)) AS unit_label,
         CASE WHEN u0 % 10 = 9 THEN NULL ELSE concat('COLLEGE_', CAST(u0 % 5 AS STRING)) END AS college,
         concat('DISC_', CAST(u0 % 9 AS STRING)) AS discipline,
         concat('FIELD_', CAST(u0 % 3 AS STRING)) AS broad_field
  FROM fx_aff0),
fx_home AS (SELECT * FROM fx_affil WHERE NOT is_ext),
fx_member_all AS (SELECT DISTINCT l_orderkey AS wid, l_suppkey AS pid FROM lineitem),
fx_uni AS (
  SELECT m.wid, COUNT(*) AS n_people, CAST(SUM(CASE WHEN p.is_ext THEN 0 ELSE 1 END) AS BIGINT) AS n_internal
  FROM fx_member_all m JOIN fx_person p ON m.pid = p.pid
  GROUP BY m.wid HAVING COUNT(*) >= 2 AND SUM(CASE WHEN p.is_ext THEN 0 ELSE 1 END) >= 1),
fx_member AS (
  SELECT m.wid, m.pid, p.is_ext, u.n_people, u.n_internal FROM fx_member_all m
  JOIN fx_uni u ON m.wid = u.wid JOIN fx_person p ON m.pid = p.pid),
fx_work_all AS (
  SELECT o_orderkey AS wid,
         CASE o_orderkey % 7 WHEN 0 THEN 'Article' WHEN 1 THEN 'Conference Proceeding' WHEN 2 THEN 'Book'
           WHEN 3 THEN 'Book Chapter' WHEN 4 THEN 'Federal Grant' WHEN 5 THEN 'Patent' ELSE 'Clinical Trial' END AS work_type,
         CAST(year(o_orderdate) AS INT) AS pub_year,
         concat('Title ', CAST(o_orderkey AS STRING)) AS title, o_orderpriority AS detail
  FROM orders),
fx_work AS (SELECT w.* FROM fx_work_all w JOIN fx_uni u ON w.wid = u.wid),
fx_kind AS (
  SELECT * FROM (VALUES ('Department', 'Department'), ('Department', 'Medical'), ('Department', 'Clinical'),
    ('Program', 'Program'), ('Program', 'Medical'), ('Program', 'Clinical')) v(unit_kind, unit_type)),
fx_kinds AS (SELECT * FROM (VALUES ('Department'), ('Program')) v(unit_kind)),
fx_roster AS (
  SELECT CAST(a.pid AS BIGINT) AS pid, unit_label AS dept, college, rank
  FROM fx_home a JOIN fx_person p ON a.pid = p.pid WHERE unit_type = 'Department'
  UNION SELECT CAST(1000000 + c_custkey AS BIGINT),
    CASE WHEN c_custkey % 50 = 0 THEN 'UNIT_ZERO' ELSE concat('UNIT_', CAST(c_nationkey AS STRING)) END, NULL,
    CASE c_custkey % 4 WHEN 0 THEN 'Professor' WHEN 1 THEN 'Associate Professor, tenured'
      WHEN 2 THEN 'Assistant Professor' ELSE 'Lecturer' END
  FROM customer),
fx_intl AS (
  SELECT m.wid, m.pid, a.unit_type, a.unit_id, a.unit_label, a.college, c.c_custkey AS inst_id, n.n_name AS country,
         CASE WHEN c.c_mktsegment = 'HOUSEHOLD' THEN 'Academic' ELSE 'Non-Academic' END AS partner_type, c.c_mktsegment AS sector,
         CAST(year(o.o_orderdate) AS INT) AS pub_year, CAST(o.o_orderkey % 2 AS INT) AS is_confproc
  FROM fx_member_all m JOIN fx_home a ON m.pid = a.pid JOIN orders o ON m.wid = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey),
fx_details AS (
  SELECT a.wid, f.pid, f.unit_type, f.unit_id, f.unit_label, f.college, f.discipline, f.broad_field,
         b.pid AS cpid, g.is_ext AS c_is_ext, g.inst AS c_inst, g.unit_type AS c_unit_type, g.unit_id AS c_unit_id,
         g.unit_label AS c_unit_label, g.college AS c_college, g.discipline AS c_discipline, g.broad_field AS c_broad_field,
         CASE WHEN g.is_ext THEN 2 WHEN f.unit_id = g.unit_id THEN 0 ELSE 1 END AS rel
  FROM fx_member a JOIN fx_member b ON a.wid = b.wid AND a.pid <> b.pid
  JOIN fx_home f ON a.pid = f.pid JOIN fx_affil g ON b.pid = g.pid),
fx_minrel AS (SELECT pid, wid, cpid, MIN(rel) AS rel FROM fx_details GROUP BY pid, wid, cpid),
fx_ppw AS (
  SELECT pid, wid, COUNT(CASE WHEN rel = 0 THEN 1 END) AS within, COUNT(CASE WHEN rel = 1 THEN 1 END) AS across,
         COUNT(CASE WHEN rel = 2 THEN 1 END) AS inter FROM fx_minrel GROUP BY pid, wid),
fx_key AS (
  SELECT k.unit_kind, 'department' AS level, a.pid, CAST(a.unit_id AS STRING) AS id, a.unit_label AS label
  FROM fx_home a JOIN fx_kind k ON a.unit_type = k.unit_type
  UNION SELECT k.unit_kind, 'college', a.pid, a.college, a.college
  FROM fx_home a JOIN fx_kind k ON a.unit_type = k.unit_type WHERE a.college IS NOT NULL
  UNION SELECT k.unit_kind, 'institution', a.pid, a.inst, a.inst FROM fx_home a CROSS JOIN fx_kinds k),
fx_ext AS (SELECT wid, COUNT(DISTINCT pid) AS n_ext FROM fx_member WHERE is_ext GROUP BY wid),
fx_tot AS (
  SELECT k.unit_kind, k.level, m.wid, COUNT(DISTINCT m.pid) AS total
  FROM fx_member m JOIN fx_key k ON m.pid = k.pid GROUP BY k.unit_kind, k.level, m.wid),
fx_cells AS (
  SELECT c.wid, c.unit_kind, c.level, c.id, c.m, t.total, COALESCE(e.n_ext, 0) AS n_ext
  FROM (SELECT m.wid, k.unit_kind, k.level, k.id, COUNT(DISTINCT m.pid) AS m
        FROM fx_member m JOIN fx_key k ON m.pid = k.pid GROUP BY m.wid, k.unit_kind, k.level, k.id) c
  JOIN fx_tot t ON c.wid = t.wid AND c.unit_kind = t.unit_kind AND c.level = t.level
  LEFT JOIN fx_ext e ON c.wid = e.wid),
fx_pairs AS (
  SELECT unit_kind, level, id, 'within' AS category, wid, CAST(m * (m - 1) // 2 AS BIGINT) AS pairs FROM fx_cells WHERE m >= 2
  UNION ALL SELECT unit_kind, level, id, 'across', wid, CAST(m * (total - m) AS BIGINT) FROM fx_cells WHERE total > m
  UNION ALL SELECT unit_kind, level, id, 'inter', wid, CAST(m * n_ext AS BIGINT) FROM fx_cells WHERE n_ext > 0),
fx_meta AS (
  SELECT m.wid, w.work_type, COUNT(DISTINCT m.pid) AS n_authors,
         CASE WHEN COUNT(DISTINCT a.discipline) > 1 THEN 1 ELSE 0 END AS interdisc, w.pub_year, w.title, w.detail
  FROM fx_member m JOIN fx_work w ON m.wid = w.wid LEFT JOIN fx_home a ON m.pid = a.pid
  GROUP BY m.wid, w.work_type, w.pub_year, w.title, w.detail),
fx_anchor AS (
  SELECT DISTINCT concat('U', CAST(unit_id AS STRING)) AS anchor, pid FROM fx_home
  UNION SELECT DISTINCT concat('C', college), pid FROM fx_home WHERE college IS NOT NULL),
fx_edges AS MATERIALIZED (
  SELECT a.pid AS a, b.pid AS b, COUNT(DISTINCT a.wid) AS works,
         COUNT(CASE WHEN w.work_type = 'Article' THEN 1 END) AS n_articles,
         COUNT(CASE WHEN w.work_type = 'Conference Proceeding' THEN 1 END) AS n_confproc,
         COUNT(CASE WHEN w.work_type = 'Book' THEN 1 END) AS n_books,
         COUNT(CASE WHEN w.work_type = 'Book Chapter' THEN 1 END) AS n_chapters,
         COUNT(CASE WHEN w.work_type = 'Federal Grant' THEN 1 END) AS n_grants,
         COUNT(CASE WHEN w.work_type = 'Patent' THEN 1 END) AS n_patents,
         COUNT(CASE WHEN w.work_type = 'Clinical Trial' THEN 1 END) AS n_trials
  FROM fx_member a JOIN fx_member b ON a.wid = b.wid AND a.pid < b.pid AND NOT (a.is_ext AND b.is_ext)
  JOIN fx_work w ON a.wid = w.wid GROUP BY a.pid, b.pid),
fx_aends AS (
  SELECT m.anchor, e.a, e.b, e.works FROM fx_edges e JOIN fx_anchor m ON m.pid = e.a
  UNION SELECT m.anchor, e.a, e.b, e.works FROM fx_edges e JOIN fx_anchor m ON m.pid = e.b),
fx_aedges AS MATERIALIZED (
  SELECT e.anchor, e.a, e.b, e.works,
         CASE WHEN ma.pid IS NOT NULL AND mb.pid IS NOT NULL THEN 0
              WHEN (ma.pid IS NULL AND pa.is_ext) OR (mb.pid IS NULL AND pb.is_ext) THEN 2 ELSE 1 END AS rel
  FROM fx_aends e
  LEFT JOIN fx_anchor ma ON ma.anchor = e.anchor AND ma.pid = e.a
  LEFT JOIN fx_anchor mb ON mb.anchor = e.anchor AND mb.pid = e.b
  JOIN fx_person pa ON pa.pid = e.a JOIN fx_person pb ON pb.pid = e.b),
fx_arcs AS MATERIALIZED (
  SELECT anchor, a AS pid, b AS other, works, rel FROM fx_aedges
  UNION ALL SELECT anchor, b, a, works, rel FROM fx_aedges),
fx_umatrix AS (
  SELECT unit_kind, level, a, b, COUNT(DISTINCT wid) AS works FROM (
    SELECT k.unit_kind, k.level, m.wid, least(k.id, j.id) AS a, greatest(k.id, j.id) AS b
    FROM fx_member m JOIN fx_member n ON m.wid = n.wid AND m.pid <> n.pid
    JOIN fx_key k ON m.pid = k.pid JOIN fx_key j ON n.pid = j.pid AND k.unit_kind = j.unit_kind AND k.level = j.level
    WHERE k.level <> 'institution') GROUP BY unit_kind, level, a, b),
fx_unit AS (
  SELECT CAST(unit_id AS STRING) AS anchor, MIN(unit_type) AS unit_type, MIN(unit_label) AS label FROM fx_home GROUP BY unit_id),
fx_amin AS (
  SELECT CAST(unit_id AS STRING) AS anchor, wid, pid, cpid, MIN(rel) AS rel FROM fx_details GROUP BY unit_id, wid, pid, cpid),
fx_punit AS (
  SELECT d.anchor, CAST(g.unit_id AS STRING) AS partner, COUNT(DISTINCT d.wid) AS works,
         COUNT(DISTINCT concat(d.wid, '|', d.pid, '|', d.cpid)) AS pairs
  FROM fx_amin d JOIN fx_unit u ON d.anchor = u.anchor JOIN fx_home g ON d.cpid = g.pid AND g.unit_type = u.unit_type
  WHERE d.rel = 1 GROUP BY d.anchor, g.unit_id),
fx_pinst AS (
  SELECT d.anchor, p.inst, COUNT(DISTINCT d.wid) AS works, COUNT(*) AS pairs
  FROM fx_amin d JOIN fx_person p ON d.cpid = p.pid WHERE d.rel = 2 GROUP BY d.anchor, p.inst),
fx_entries AS (
  SELECT d.anchor, u.label AS name, 0 AS rel, COUNT(DISTINCT d.wid) AS works, COUNT(*) // 2 AS pairs
  FROM fx_amin d JOIN fx_unit u ON d.anchor = u.anchor WHERE d.rel = 0 GROUP BY d.anchor, u.label
  UNION ALL SELECT p.anchor, u.label, 1, p.works, p.pairs FROM fx_punit p JOIN fx_unit u ON p.partner = u.anchor
  UNION ALL SELECT anchor, inst, 2, works, pairs FROM fx_pinst)
"""


def register(name: str, sql: str | None = None, ctes: str = ""):
    """Add a query.  ``sql`` is the tail after the shared CTEs."""

    def add(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = PRELUDE + (", " + ctes if ctes else "") + sql
        return fn

    return add
