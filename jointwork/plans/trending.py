"""Queries on international partners over time and on points."""

from __future__ import annotations

from pyspark.sql import functions as F

from jointwork.operators import scopes as s, trends as tr
from jointwork.plans.registry import register

#: Years of the order table, for the columns of the SQL; the operator finds them in the data.
YEARS = list(range(1995, 2002))
BY_ANCHOR = """ianch AS (
  SELECT concat('U', CAST(unit_id AS STRING)) AS anchor, unit_label AS label, unit_type AS grp, * FROM fx_intl
  UNION ALL SELECT concat('C', college), college, 'college', * FROM fx_intl WHERE college IS NOT NULL)
"""


@register("country_works_scholars",
          "SELECT country, COUNT(DISTINCT wid) AS works, COUNT(DISTINCT pid) AS scholars FROM fx_intl GROUP BY country")
def _(t):
    return tr.country_works_scholars(t.intl)


@register("country_year", "SELECT country, " + ", ".join(
    f"COUNT(DISTINCT CASE WHEN pub_year = {y} THEN wid END) AS y{y}" for y in YEARS) + " FROM fx_intl GROUP BY country")
def _(t):
    return tr.country_year(t.intl)


@register("country_year_long", """SELECT c.country, y.pub_year, COALESCE(n.works, 0) AS works
FROM (SELECT DISTINCT country FROM fx_intl) c CROSS JOIN (SELECT DISTINCT pub_year FROM fx_intl) y
LEFT JOIN (SELECT country, pub_year, COUNT(DISTINCT wid) AS works FROM fx_intl GROUP BY country, pub_year) n
ON c.country = n.country AND y.pub_year = n.pub_year""")
def _(t):
    return tr.country_year_long(t.intl)


@register("partner_type", """SELECT partner_type, COUNT(DISTINCT wid) AS works, COUNT(DISTINCT inst_id) AS institutions
FROM fx_intl GROUP BY partner_type""")
def _(t):
    return tr.partner_type(t.intl.withColumn("partner_type", tr.sector_type(F.col("sector"), "HOUSEHOLD")))


@register("top_naics", """SELECT sector, works, CAST(row_number() OVER (ORDER BY works DESC, sector) AS INT) AS rnk FROM (
  SELECT sector, COUNT(DISTINCT wid) AS works FROM fx_intl WHERE partner_type = 'Non-Academic' GROUP BY sector)
ORDER BY works DESC, sector LIMIT 12""")
def _(t):
    return tr.top_sectors(t.intl, 12)


@register("top_nonacademic", """SELECT inst_id, works, country, CAST(row_number() OVER (ORDER BY works DESC, inst_id) AS INT) AS rnk FROM (
  SELECT inst_id, COUNT(DISTINCT wid) AS works, MIN(country) AS country FROM fx_intl WHERE partner_type = 'Non-Academic'
  GROUP BY inst_id) ORDER BY works DESC, inst_id LIMIT 15""")
def _(t):
    return tr.top_nonacademic(t.intl, 15)


@register("dept_intl", """SELECT d.unit_label, d.works, d.partners, d.countries, c.top_countries FROM (
  SELECT unit_label, COUNT(DISTINCT wid) AS works, COUNT(DISTINCT inst_id) AS partners, COUNT(DISTINCT country) AS countries
  FROM fx_intl WHERE unit_type = 'Department' GROUP BY unit_label) d
JOIN (SELECT unit_label, string_agg(concat(country, ':', CAST(n AS STRING)), ',' ORDER BY n DESC, country) AS top_countries FROM (
  SELECT unit_label, country, COUNT(DISTINCT wid) AS n,
    row_number() OVER (PARTITION BY unit_label ORDER BY COUNT(DISTINCT wid) DESC, country) AS rn
  FROM fx_intl WHERE unit_type = 'Department' GROUP BY unit_label, country) WHERE rn <= 6 GROUP BY unit_label) c
ON d.unit_label = c.unit_label""")
def _(t):
    return tr.dept_intl(t.intl)


@register("year_totals", "SELECT pub_year, COUNT(DISTINCT wid) AS works FROM fx_intl GROUP BY pub_year")
def _(t):
    return tr.year_totals(t.intl)


def _series(t):
    return tr.trend_series(s.qualifying_rows(t.intl, [f"NATION_{i}" for i in range(0, 13)], "Non-Academic", ["Article", "Conference Proceeding"]))


_WHERE = ("country IN (" + ", ".join(f"'NATION_{i}'" for i in range(0, 13)) + ") AND partner_type = 'Non-Academic'")


@register("trend_series", f"""SELECT anchor, pub_year, COUNT(DISTINCT wid) AS works, COUNT(DISTINCT inst_id) AS insts, COUNT(*) AS n_rows
FROM ianch WHERE {_WHERE} GROUP BY anchor, pub_year""", ctes=BY_ANCHOR)
def _(t):
    return _series(t)


@register("trend_table", f"""SELECT pub_year, COUNT(DISTINCT CASE WHEN anchor = 'U3' THEN wid END) AS U3,
COUNT(DISTINCT CASE WHEN anchor = 'U16' THEN wid END) AS U16, COUNT(DISTINCT CASE WHEN anchor = 'CCOLLEGE_1' THEN wid END) AS CCOLLEGE_1
FROM ianch WHERE {_WHERE} AND anchor IN ('U3', 'U16', 'CCOLLEGE_1') GROUP BY pub_year""", ctes=BY_ANCHOR)
def _(t):
    return tr.trend_table(_series(t), ["U3", "U16", "CCOLLEGE_1"])


@register("country_options", "SELECT DISTINCT country FROM ianch WHERE anchor IN ('U3', 'CCOLLEGE_2') AND country <> ''", ctes=BY_ANCHOR)
def _(t):
    return tr.country_options(t.intl, ["U3", "CCOLLEGE_2"])


@register("anchor_group_list", """SELECT DISTINCT grp AS "group", anchor, label,
CASE grp WHEN 'college' THEN 1 WHEN 'Department' THEN 2 WHEN 'Program' THEN 3 ELSE 4 END AS group_no FROM ianch""", ctes=BY_ANCHOR)
def _(t):
    return tr.anchor_group_list(t.intl)


@register("anchor_skew_profile", """SELECT anchor, COUNT(*) AS n_rows,
ROUND(COUNT(*) * 100.0 / (SELECT COUNT(*) FROM ianch), 2) AS share_pct FROM ianch GROUP BY anchor""", ctes=BY_ANCHOR)
def _(t):
    return tr.anchor_skew_profile(t.intl)


def _centroid_sql():
    return ", ".join(f"('{n}', {a}, {b})" for n, (a, b) in tr.STATE_CENTROIDS.items())


@register("nearest_state", f"""SELECT c_custkey, lat, lon, arg_min(state, km) AS state, ROUND(MIN(km), 1) AS km FROM (
  SELECT p.*, v.state, 2 * 6371.0 * asin(sqrt(pow(sin(radians(v.slat - p.lat) / 2), 2)
    + cos(radians(p.lat)) * cos(radians(v.slat)) * pow(sin(radians(v.slon - p.lon) / 2), 2))) AS km
  FROM (SELECT c_custkey, 25 + (c_custkey * 37 % 2400) / 100.0 AS lat, -124 + (c_custkey * 53 % 5700) / 100.0 AS lon FROM customer) p
  CROSS JOIN (VALUES {_centroid_sql()}) v(state, slat, slon)) GROUP BY c_custkey, lat, lon""")
def _(t):
    k = F.col("c_custkey")
    points = t.read("customer").select(
        k, (F.lit(25) + (k * 37 % 2400) / F.lit(100.0)).alias("lat"), (F.lit(-124) + (k * 53 % 5700) / F.lit(100.0)).alias("lon")
    )
    return tr.nearest_state(points)
