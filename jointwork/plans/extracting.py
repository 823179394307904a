"""Queries of the extract stage on raw match and unit tables."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from jointwork.functions.expressions import rank_label
from jointwork.operators import extract as ex
from jointwork.plans.fixture import HOME
from jointwork.plans.registry import register
from jointwork.sources.writers import stored

LINES = "raw_line AS (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey)\n"
ARTICLES = LINES.rstrip() + """, raw_article AS (
  SELECT l_suppkey AS pid, concat(CASE WHEN l_linenumber % 2 = 0 THEN '10.1/ab' ELSE '10.1/AB' END, CAST(o_orderkey AS STRING)) AS doi,
    o_custkey % 50 AS journal_id, CAST(year(o_orderdate) AS INT) AS pub_year, CAST(o_orderkey % 7 AS INT) AS is_confproc
  FROM raw_line WHERE o_orderkey % 7 IN (0, 1))
"""
UNITS = """ru0 AS (
  SELECT CASE WHEN s_suppkey % 4 = 3 THEN concat('INST_', CAST(s_suppkey % 24 AS STRING)) ELSE 'HOME' END AS inst,
    CAST(s_nationkey AS BIGINT) AS nk, CAST(s_nationkey + 450 AS INT) AS group_id,
    CASE WHEN s_nationkey = 24 THEN '' ELSE concat('Group ', CAST(s_nationkey AS STRING)) END AS discipline,
    s_suppkey AS pid, s_name AS pname, CAST(s_suppkey % 5 AS INT) AS rank_code FROM supplier),
ru1 AS (
  SELECT *, nk AS unit_id, 'Department' AS unit_type FROM ru0
  UNION SELECT *, (nk + 7) % 25, 'Department' FROM ru0 WHERE pid % 5 = 0
  UNION SELECT *, 100 + nk % 10, 'Program' FROM ru0
  UNION SELECT *, 200 + pid % 2, 'Medical' FROM ru0 WHERE pid % 17 = 0
  UNION SELECT *, 300 + pid % 2, 'Clinical' FROM ru0 WHERE pid % 19 = 0),
ru AS (SELECT DISTINCT inst, unit_id, concat('UNIT_', CAST(unit_id AS STRING)) AS unit_label, group_id, discipline, pid, pname,
  rank_code, unit_type FROM ru1),
rd AS (SELECT DISTINCT inst, unit_id, group_id FROM ru WHERE unit_type = 'Department'),
rcol AS (
  SELECT inst, unit_id, group_id, concat('COLLEGE_', CAST(unit_id % 5 AS STRING)) AS college FROM rd WHERE unit_id < 10
  UNION SELECT inst, unit_id, group_id, concat('COLLEGE_', CAST(unit_id % 5 AS STRING)) FROM rd WHERE unit_id BETWEEN 8 AND 15
  UNION SELECT inst, unit_id, group_id, concat('COLLEGE_', CAST(unit_id % 5 AS STRING)) FROM rd WHERE unit_id > 15 AND unit_id < 24),
rtax AS (SELECT DISTINCT r.inst, r.group_id, concat('FIELD_', CAST(n_regionkey AS STRING)) AS broad_field
  FROM rd r JOIN nation ON r.group_id = n_nationkey + 450 WHERE n_regionkey <> 3),
rreg AS (SELECT DISTINCT r.inst, r.unit_id, r.unit_id + 5000 AS registry_id FROM rd r JOIN nation ON r.unit_id = n_nationkey
  WHERE n_regionkey <> 4)
"""


@register("affil_union", "SELECT * FROM ru", ctes=UNITS)
def _(t):
    return ex.affil_union(t.raw_units)


@register("college_union_corr", "SELECT * FROM rcol", ctes=UNITS)
def _(t):
    return ex.college_union(t.raw_college_tables, ["inst", "unit_id", "group_id", "college"])


def enriched(t):
    colleges = ex.college_union(t.raw_college_tables, ["inst", "unit_id", "group_id", "college"])
    return ex.affil_enrich(ex.affil_union(t.raw_units), t.raw_taxonomy, t.raw_registry, colleges)


@register("affil_enrich", """SELECT ru.*, rtax.broad_field, rreg.registry_id, rcol.college FROM ru
LEFT JOIN rtax ON ru.inst = rtax.inst AND ru.group_id = rtax.group_id
LEFT JOIN rreg ON ru.inst = rreg.inst AND ru.unit_id = rreg.unit_id
LEFT JOIN rcol ON ru.inst = rcol.inst AND ru.unit_id = rcol.unit_id AND ru.group_id = rcol.group_id""", ctes=UNITS)
def _(t):
    return enriched(t)


@register("state_join", """SELECT ru.*, s.state FROM ru LEFT JOIN (
  SELECT inst, concat('ST_', CAST(MIN(pid) % 10 AS STRING)) AS state FROM fx_person WHERE inst <> 'INST_3' GROUP BY inst) s
ON ru.inst = s.inst""", ctes=UNITS)
def _(t):
    return ex.state_join(ex.affil_union(t.raw_units), t.raw_institutions)


@register("merge_disciplines", """SELECT DISTINCT inst, unit_id, unit_label, pid, pname, rank_code, unit_type,
CAST(CASE group_id WHEN 454 THEN 11 WHEN 455 THEN 15 WHEN 456 THEN 16 WHEN 457 THEN 17 WHEN 458 THEN 43 WHEN 459 THEN 106
  WHEN 460 THEN 111 WHEN 461 THEN 156 ELSE group_id END AS INT) AS group_id,
CASE WHEN group_id IN (11, 454) THEN 'Anthropology' WHEN group_id IN (15, 455) THEN 'Architecture'
  WHEN group_id IN (16, 456) THEN 'Architecture, Design, Planning, various'
  WHEN group_id IN (17, 457) THEN 'Area and Ethnic Studies, various'
  WHEN group_id IN (43, 458) THEN 'Communication and Communication Studies' WHEN group_id IN (106, 459) THEN 'Linguistics'
  WHEN group_id IN (111, 460) THEN 'Mass Communications/Media Studies' WHEN group_id IN (156, 461) THEN 'Sociology'
  ELSE discipline END AS discipline FROM ru WHERE discipline <> ''""", ctes=UNITS)
def _(t):
    return ex.merge_disciplines(ex.affil_union(t.raw_units))


@register("focal_filter", "SELECT * FROM ru WHERE inst = 'HOME'", ctes=UNITS)
def _(t):
    return ex.focal_only(ex.affil_union(t.raw_units), HOME)


@register("rank_label", """SELECT DISTINCT pid, CASE rank_code WHEN 1 THEN 'Professor' WHEN 2 THEN 'Associate Professor'
WHEN 3 THEN 'Assistant Professor' ELSE 'Other' END AS rank FROM ru""", ctes=UNITS)
def _(t):
    return ex.affil_union(t.raw_units).select("pid", rank_label(F.col("rank_code")).alias("rank")).distinct()


ARTICLE_WINDOW = (1997, 1999)
BOOK_WINDOW = (1996, 2000)
GRANT_WINDOW = (1998, 1999)


@register("key_normalise_upper", "SELECT DISTINCT pid, upper(doi) AS doi FROM raw_article", ctes=ARTICLES)
def _(t):
    return ex.normalise_key(t.raw_articles, "doi").select("pid", "doi").distinct()


@register("window_filter_years", """SELECT DISTINCT pid, upper(doi) AS doi, pub_year FROM raw_article
WHERE pub_year BETWEEN 1997 AND 1999""", ctes=ARTICLES)
def _(t):
    return ex.in_window(ex.normalise_key(t.raw_articles, "doi"), "pub_year", ARTICLE_WINDOW).select("pid", "doi", "pub_year").distinct()


@register("split_confproc", """SELECT work_type, COUNT(*) AS n_rows, COUNT(DISTINCT doi) AS works FROM (
  SELECT CASE WHEN is_confproc = 1 THEN 'Conference Proceeding' ELSE 'Article' END AS work_type, upper(doi) AS doi FROM raw_article)
GROUP BY work_type""", ctes=ARTICLES)
def _(t):
    return ex.split_by_flag(ex.normalise_key(t.raw_articles, "doi")).groupBy("work_type").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("doi").alias("works")
    )


@register("title_lookup", """SELECT DISTINCT a.wid, a.journal_id, c.c_name AS journal, concat('Title ', CAST(o.o_orderkey AS STRING)) AS title
FROM (SELECT DISTINCT upper(doi) AS wid, journal_id FROM raw_article) a
LEFT JOIN customer c ON a.journal_id = c.c_custkey LEFT JOIN orders o ON a.wid = concat('10.1/AB', CAST(o.o_orderkey AS STRING))""",
          ctes=ARTICLES)
def _(t):
    works = ex.normalise_key(t.raw_articles, "doi").select(F.col("doi").alias("wid"), "journal_id").distinct()
    journals = t.read("customer").select(F.col("c_custkey").alias("journal_id"), F.col("c_name").alias("journal"))
    titles = t.read("orders").select(
        F.concat(F.lit("10.1/AB"), F.col("o_orderkey").cast("string")).alias("wid"),
        F.concat(F.lit("Title "), F.col("o_orderkey").cast("string")).alias("title"),
    )
    return ex.title_lookup(works, journals, titles)


BOOKS = LINES.rstrip() + """, raw_book AS (
  SELECT l_suppkey AS pid, concat('978-', CAST(o_orderkey AS STRING)) AS isbn, o_orderpriority AS publisher,
    CAST(year(o_orderdate) AS INT) AS pub_year, concat('Book ', CAST(o_orderkey AS STRING)) AS title,
    CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 0 END AS is_chapter,
    CASE WHEN l_discount >= 0.09 THEN 1 ELSE 0 END AS is_duplicate, CASE WHEN l_tax >= 0.08 THEN 1 ELSE 0 END AS is_excluded
  FROM raw_line WHERE o_orderkey % 7 = 2)
"""


@register("exclude_flags", """SELECT pid, isbn, pub_year FROM raw_book WHERE (is_chapter IS NULL OR is_chapter = 0)
AND is_duplicate = 0 AND is_excluded = 0""", ctes=BOOKS)
def _(t):
    return ex.counted_books(t.raw_books).select("pid", "isbn", "pub_year")


GRANTS = LINES.rstrip() + """, raw_grant AS (
  SELECT l_suppkey AS pid, concat('G', CAST(o_orderkey AS STRING)) AS grant_id,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 'ERC' ELSE o_orderpriority END AS agency,
    CASE WHEN l_returnflag = 'R' THEN 'CA' ELSE 'US' END AS country, l_extendedprice AS dollars,
    CASE WHEN l_tax < 0.07 THEN 1 ELSE 0 END AS is_research,
    CASE WHEN l_linenumber <> 7 THEN o_orderdate END AS start_date,
    CASE WHEN l_linenumber NOT IN (2, 5) THEN l_shipdate END AS end_date,
    concat('Grant ', CAST(o_orderkey AS STRING)) AS grant_name
  FROM raw_line WHERE o_orderkey % 7 = 4),
live_grant AS (
  SELECT DISTINCT pid, grant_id, agency, grant_name, CAST(year(start_date) AS INT) AS pub_year FROM raw_grant
  WHERE agency NOT IN ('ACS','AHA','AHRC','BBSRC','EPSRC','ERC','ESRC','MRC','NERC','STFC','Wellcome') AND country = 'US'
    AND dollars >= 10 AND is_research = 1
    AND (start_date IS NULL OR (end_date IS NOT NULL AND NOT (year(start_date) > 1999 OR year(end_date) < 1998))
      OR (end_date IS NULL AND year(start_date) BETWEEN 1998 AND 1999)))
"""


def live_grants(t):
    return ex.active_grants(t.raw_grants, GRANT_WINDOW)


@register("grant_active_overlap", "SELECT pid, grant_id, agency, grant_name, pub_year FROM live_grant", ctes=GRANTS)
def _(t):
    return live_grants(t).select("pid", "grant_id", "agency", "grant_name", ex.start_year(F.col("start_date")).alias("pub_year"))


@register("grant_trial_start_year", """SELECT DISTINCT concat('NCT', CAST(o_orderkey AS STRING)) AS wid,
CAST(year(o_orderdate) AS INT) AS pub_year FROM raw_line WHERE o_orderkey % 7 = 6
UNION SELECT grant_id, pub_year FROM live_grant""", ctes=GRANTS)
def _(t):
    trials = t.raw_trials.select(F.col("nct_id").alias("wid"), ex.start_year(F.col("start_date")).alias("pub_year"))
    grants = live_grants(t).select(F.col("grant_id").alias("wid"), ex.start_year(F.col("start_date")).alias("pub_year"))
    return trials.union(grants).distinct()


@register("collab_selfjoin", """SELECT a.wid, a.pid, b.pid AS cpid FROM fx_member a
JOIN fx_member b ON a.wid = b.wid AND a.pid <> b.pid WHERE NOT a.is_ext""")
def _(t):
    return ex.collab_pairs(t.member)


@register("both_sides_explode", """SELECT wid, pid, unit_id, cpid, c_unit_id, rel FROM fx_details""")
def _(t):
    return ex.both_sides_explode(ex.collab_pairs(t.member, affil=t.affil), t.affil).select("wid", "pid", "unit_id", "cpid", "c_unit_id", "rel")


@register("relationship_classify", """SELECT unit_label, CASE rel WHEN 2 THEN 'External' ELSE 'Internal' END AS collab_dir,
CASE rel WHEN 2 THEN 'Across Institutions' WHEN 0 THEN 'Within Unit' ELSE 'Across Units' END AS relationship,
COUNT(*) AS n_rows, COUNT(DISTINCT wid) AS works FROM fx_details GROUP BY unit_label, rel""")
def _(t):
    d = ex.classify(ex.both_sides_explode(ex.collab_pairs(t.member, affil=t.affil), t.affil))
    return d.groupBy("unit_label", "collab_dir", "relationship").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("wid").alias("works"))


DETAILS_SQL = """SELECT 'HOME' AS InstitutionId, 'Home University' AS InstitutionName, d.college AS College, CAST(d.unit_id AS STRING) AS UnitId,
  d.unit_label AS Department, d.unit_type AS UnitType, CAST(d.pid AS STRING) AS PersonId, p.pname AS PersonName, d.broad_field AS Broad_Field,
  d.discipline AS Discipline, w.work_type AS CollaborationType, d.c_inst AS Collab_InstitutionId,
  CASE WHEN s.inst IS NULL THEN d.c_inst ELSE concat('Institution ', d.c_inst) END AS Collab_Institution, s.state AS Collab_State,
  d.c_college AS Collab_College, CAST(d.c_unit_id AS STRING) AS Collab_UnitId, d.c_unit_label AS Collab_Department,
  d.c_unit_type AS Collab_UnitType, d.c_broad_field AS Collab_BF, d.c_discipline AS Collab_Disc, CAST(d.cpid AS STRING) AS Collab_PersonID,
  q.pname AS Collab_PersonName, CAST(w.pub_year AS INT) AS Year, CAST(d.wid AS STRING) AS Collab_ID, w.detail AS Collab_Detail, w.title AS Collab_Title,
  p.rank AS Rank, CASE rel WHEN 2 THEN 'External' ELSE 'Internal' END AS Collab_Dir,
  CASE rel WHEN 2 THEN 'Across Institutions' WHEN 0 THEN 'Within Unit' ELSE 'Across Units' END AS Relationship
FROM fx_details d JOIN fx_work w ON d.wid = w.wid JOIN fx_person p ON d.pid = p.pid JOIN fx_person q ON d.cpid = q.pid
LEFT JOIN (SELECT inst, concat('ST_', CAST(MIN(pid) % 10 AS STRING)) AS state FROM fx_person WHERE inst <> 'INST_3' GROUP BY inst) s ON s.inst = d.c_inst"""


def flat_fact(t):
    named = t.raw_institutions.withColumn("inst_name", F.concat(F.lit("Institution "), "inst"))
    # Stored for its size: members are not shuffled for the places of a person.
    pairs = ex.collab_pairs(t.member, affil=stored(ex.named_places(t.affil, named), "places"), person=t.person, also=ex.NAMED)
    return ex.details_base(pairs, t.affil, t.person, t.work_all, HOME, named, "Home University")


@register("details_base", DETAILS_SQL)
def _(t):
    return flat_fact(t)


def typed_sources(t):
    """Focal rows of each kind of work in one layout, windows and flags applied: source, wid, pid, work_type, pub_year, detail, title."""
    def cols(df, source, wid, kind, year, detail, title):
        return df.select(
            F.lit(source).alias("source"), wid.alias("wid"), "pid", kind.alias("work_type"), year.cast("int").alias("pub_year"), detail.alias("detail"), title.alias("title")
        )

    c, lit = F.col, F.lit
    art = ex.split_by_flag(ex.in_window(ex.normalise_key(t.raw_articles, "doi"), "pub_year", ARTICLE_WINDOW))
    books = ex.in_window(ex.counted_books(t.raw_books), "pub_year", BOOK_WINDOW)
    return {
        "article": cols(art, "article", c("doi"), c("work_type"), c("pub_year"), c("journal_id").cast("string"), c("doi")),
        "book": cols(books, "book", c("isbn"), lit("Book"), c("pub_year"), c("publisher"), c("title")),
        "chapter": cols(t.raw_chapters, "chapter", c("chapter_id"), lit("Book Chapter"), c("pub_year"), c("book_title"), c("title")),
        "grant": cols(live_grants(t), "grant", c("grant_id"), lit("Federal Grant"), ex.start_year(c("start_date")), c("agency"), c("grant_name")),
        "patent": cols(t.raw_patents, "patent", c("patent"), lit("Patent"), c("pub_year"), c("patent_type"), c("title")),
        "trial": cols(t.raw_trials, "trial", c("nct_id"), lit("Clinical Trial"), ex.start_year(c("start_date")), lit("Utility"), c("title")),
    }


def focal_rows(t):
    """As ``typed_sources``, with patents from the client-facing table, which lacks returned lines."""
    narrow = t.raw_patents.filter("returnflag <> 'R'").select(F.col("patent").alias("wid"), "pid").distinct()
    parts = typed_sources(t)
    parts["patent"] = parts["patent"].join(narrow, ["wid", "pid"], "left_semi")
    return functools.reduce(lambda a, b: a.unionByName(b), parts.values()).distinct()


def partner_rows(t):
    """Partner side: articles of any year, broad patents; the other kinds as on the focal side."""
    parts = typed_sources(t)
    parts["article"] = ex.normalise_key(t.raw_articles, "doi").select(F.lit("article").alias("source"), F.col("doi").alias("wid"), "pid")
    return functools.reduce(lambda a, b: a.unionByName(b), [p.select("source", "wid", "pid") for p in parts.values()])


def typed_works(t):
    """The seven work types in one layout, windows applied per type."""
    return ex.work_type_union(typed_sources(t).values())


def raw_affil(t):
    """Affiliations as the extract builds them: fields, registry and colleges joined, disciplines merged."""
    return ex.merge_disciplines(enriched(t)).withColumn("is_ext", F.col("inst") != HOME)


# Focal (tf) and partner (tp) rows of all kinds, people with a place (ra), and pairs (tpair).
TYPED = ARTICLES.rstrip() + ", " + BOOKS.split(", ", 1)[1].rstrip() + ", " + GRANTS.split(", ", 1)[1].rstrip() + """, tsource AS (
  SELECT 'article' AS source, upper(doi) AS wid, pid, CASE WHEN is_confproc = 1 THEN 'Conference Proceeding' ELSE 'Article' END AS work_type,
    pub_year, CAST(journal_id AS STRING) AS detail, upper(doi) AS title FROM raw_article WHERE pub_year BETWEEN 1997 AND 1999
  UNION SELECT 'book', isbn, pid, 'Book', pub_year, publisher, title FROM raw_book
    WHERE (is_chapter IS NULL OR is_chapter = 0) AND is_duplicate = 0 AND is_excluded = 0 AND pub_year BETWEEN 1996 AND 2000
  UNION SELECT 'chapter', CAST(o_orderkey AS STRING), l_suppkey, 'Book Chapter', CAST(year(o_orderdate) AS INT),
    concat('Book ', CAST(o_orderkey AS STRING)), concat('Chapter ', CAST(o_orderkey AS STRING)) FROM raw_line WHERE o_orderkey % 7 = 3
  UNION SELECT 'grant', grant_id, pid, 'Federal Grant', pub_year, agency, grant_name FROM live_grant
  UNION SELECT 'patent', concat('US', CAST(o_orderkey AS STRING)), l_suppkey, 'Patent', CAST(year(o_orderdate) AS INT), o_orderstatus,
    concat('Patent ', CAST(o_orderkey AS STRING)) FROM raw_line WHERE o_orderkey % 7 = 5
  UNION SELECT 'trial', concat('NCT', CAST(o_orderkey AS STRING)), l_suppkey, 'Clinical Trial', CAST(year(o_orderdate) AS INT), 'Utility',
    concat('Trial ', CAST(o_orderkey AS STRING)) FROM raw_line WHERE o_orderkey % 7 = 6),
ra AS (SELECT DISTINCT ru.inst, ru.inst <> 'HOME' AS is_ext, ru.unit_id, ru.unit_label, ru.unit_type, ru.pid, ru.pname, ru.rank_code,
  CASE WHEN ru.group_id = 454 THEN 'Anthropology' WHEN ru.group_id = 455 THEN 'Architecture'
    WHEN ru.group_id = 456 THEN 'Architecture, Design, Planning, various' WHEN ru.group_id = 457 THEN 'Area and Ethnic Studies, various'
    WHEN ru.group_id = 458 THEN 'Communication and Communication Studies' WHEN ru.group_id = 459 THEN 'Linguistics'
    WHEN ru.group_id = 460 THEN 'Mass Communications/Media Studies' WHEN ru.group_id = 461 THEN 'Sociology' ELSE ru.discipline END AS discipline,
  rtax.broad_field, rcol.college FROM ru
  LEFT JOIN rtax ON ru.inst = rtax.inst AND ru.group_id = rtax.group_id
  LEFT JOIN rcol ON ru.inst = rcol.inst AND ru.unit_id = rcol.unit_id AND ru.group_id = rcol.group_id WHERE ru.discipline <> ''),
tf AS (SELECT * FROM tsource WHERE pid IN (SELECT pid FROM ra WHERE NOT is_ext) AND (source <> 'patent' OR (wid, pid) IN (
  SELECT concat('US', CAST(o_orderkey AS STRING)), l_suppkey FROM raw_line WHERE o_orderkey % 7 = 5 AND l_returnflag <> 'R'))),
tp AS (SELECT DISTINCT source, wid, pid FROM (
  SELECT source, wid, pid FROM tsource UNION SELECT 'article', upper(doi), pid FROM raw_article) WHERE pid IN (SELECT pid FROM ra)),
tpair AS (SELECT DISTINCT f.source, f.wid, f.pid, p.pid AS cpid FROM tf f JOIN tp p ON f.source = p.source AND f.wid = p.wid AND f.pid <> p.pid)
"""
TYPED = UNITS.rstrip() + ", " + TYPED


@register("collab_semijoin", "SELECT * FROM tpair", ctes=TYPED)
def _(t):
    affil = raw_affil(t)
    return ex.sided_pairs(ex.sided_members(focal_rows(t), partner_rows(t), affil.filter("NOT is_ext"), affil))


@register("details_from_types", """SELECT 'HOME' AS InstitutionId, 'Home University' AS InstitutionName, a.college AS College,
  CAST(a.unit_id AS STRING) AS UnitId, a.unit_label AS Department, a.unit_type AS UnitType, CAST(a.pid AS STRING) AS PersonId,
  a.pname AS PersonName, a.broad_field AS Broad_Field, a.discipline AS Discipline, f.work_type AS CollaborationType,
  b.inst AS Collab_InstitutionId, CASE WHEN s.inst IS NULL THEN b.inst ELSE concat('Institution ', b.inst) END AS Collab_Institution,
  s.state AS Collab_State, b.college AS Collab_College, CAST(b.unit_id AS STRING) AS Collab_UnitId, b.unit_label AS Collab_Department,
  b.unit_type AS Collab_UnitType, b.broad_field AS Collab_BF, b.discipline AS Collab_Disc, CAST(b.pid AS STRING) AS Collab_PersonID,
  b.pname AS Collab_PersonName, f.pub_year AS Year, f.wid AS Collab_ID, f.detail AS Collab_Detail, f.title AS Collab_Title,
  CASE a.rank_code WHEN 1 THEN 'Professor' WHEN 2 THEN 'Associate Professor' WHEN 3 THEN 'Assistant Professor' ELSE 'Other' END AS Rank,
  CASE WHEN b.is_ext THEN 'External' ELSE 'Internal' END AS Collab_Dir,
  CASE WHEN b.is_ext THEN 'Across Institutions' WHEN a.unit_id = b.unit_id THEN 'Within Unit' ELSE 'Across Units' END AS Relationship
FROM tpair t JOIN tf f ON t.source = f.source AND t.wid = f.wid AND t.pid = f.pid JOIN ra a ON t.pid = a.pid AND NOT a.is_ext JOIN ra b ON t.cpid = b.pid
LEFT JOIN (SELECT inst, concat('ST_', CAST(MIN(pid) % 10 AS STRING)) AS state FROM fx_person WHERE inst <> 'INST_3' GROUP BY inst) s ON s.inst = b.inst""",
          ctes=TYPED)
def _(t):
    named = t.raw_institutions.withColumn("inst_name", F.concat(F.lit("Institution "), "inst"))
    return ex.details_from_types(focal_rows(t), partner_rows(t), raw_affil(t), HOME, named, "Home University")


@register("work_type_union", """SELECT DISTINCT pid, CASE WHEN is_confproc = 1 THEN 'Conference Proceeding' ELSE 'Article' END AS work_type,
  upper(doi) AS wid, pub_year, CAST(journal_id AS STRING) AS detail, upper(doi) AS title FROM raw_article WHERE pub_year BETWEEN 1997 AND 1999
UNION SELECT pid, 'Book', isbn, pub_year, publisher, title FROM raw_book
  WHERE (is_chapter IS NULL OR is_chapter = 0) AND is_duplicate = 0 AND is_excluded = 0 AND pub_year BETWEEN 1996 AND 2000
UNION SELECT l_suppkey, 'Book Chapter', CAST(o_orderkey AS STRING), CAST(year(o_orderdate) AS INT),
  concat('Book ', CAST(o_orderkey AS STRING)), concat('Chapter ', CAST(o_orderkey AS STRING)) FROM raw_line WHERE o_orderkey % 7 = 3
UNION SELECT pid, 'Federal Grant', grant_id, pub_year, agency, grant_name FROM live_grant
UNION SELECT l_suppkey, 'Patent', concat('US', CAST(o_orderkey AS STRING)), CAST(year(o_orderdate) AS INT), o_orderstatus,
  concat('Patent ', CAST(o_orderkey AS STRING)) FROM raw_line WHERE o_orderkey % 7 = 5
UNION SELECT l_suppkey, 'Clinical Trial', concat('NCT', CAST(o_orderkey AS STRING)), CAST(year(o_orderdate) AS INT), 'Utility',
  concat('Trial ', CAST(o_orderkey AS STRING)) FROM raw_line WHERE o_orderkey % 7 = 6""",
          ctes=ARTICLES.rstrip() + ", " + BOOKS.split(", ", 1)[1].rstrip() + ", " + GRANTS.split(", ", 1)[1])
def _(t):
    return typed_works(t)


@register("membership_from_types", """SELECT w.work_type, COUNT(*) AS n_rows, COUNT(DISTINCT m.wid) AS works,
  SUM(CASE WHEN m.f THEN 1 ELSE 0 END)::BIGINT AS n_focal, SUM(CASE WHEN m.p THEN 1 ELSE 0 END)::BIGINT AS n_partner
FROM (SELECT source, wid, pid, bool_or(f) AS f, bool_or(p) AS p FROM (
    SELECT source, wid, pid, TRUE AS f, FALSE AS p FROM tf UNION ALL SELECT source, wid, pid, FALSE, TRUE FROM tp) GROUP BY source, wid, pid) m
JOIN (SELECT source, wid FROM (SELECT source, wid, pid, 1 AS f FROM tf UNION ALL SELECT source, wid, pid, 0 FROM tp)
  GROUP BY source, wid HAVING COUNT(DISTINCT pid) >= 2 AND MAX(f) = 1) u ON m.source = u.source AND m.wid = u.wid
JOIN (SELECT source, wid, MIN(work_type) AS work_type FROM tf GROUP BY source, wid) w ON m.source = w.source AND m.wid = w.wid
GROUP BY w.work_type""", ctes=TYPED)
def _(t):
    affil, focal = raw_affil(t), focal_rows(t)
    members = ex.sided_members(focal, partner_rows(t), affil.filter("NOT is_ext"), affil)
    kinds = focal.join(affil.filter("NOT is_ext").select("pid").distinct(), "pid", "left_semi").groupBy("source", "wid").agg(F.min("work_type").alias("work_type"))
    count = lambda c: F.sum(F.col(c).cast("int")).cast("bigint")
    return members.join(kinds, ["source", "wid"]).groupBy("work_type").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("wid").alias("works"), count("f").alias("n_focal"), count("p").alias("n_partner")
    )
