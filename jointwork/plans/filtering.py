"""Distinct works under combinations of filters, from bitmaps that are built once."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from jointwork.operators import bitmaps as bm, counts as c
from jointwork.plans.registry import register
from jointwork.sources.writers import stored

# name: categories, types, years, author cap
FILTERS = {
    "all": (c.CATEGORIES, None, None, None),
    "intra": (("within", "across"), None, None, None),
    "intra_papers_cap20": (("within", "across"), ("Article", "Conference Proceeding"), None, 20),
    "inter_1995_1997": (("inter",), None, (1995, 1997), 50),
    "grants_patents_1993_1994": (c.CATEGORIES, ("Federal Grant", "Patent"), (1993, 1994), 100),
    "across_books": (("across",), ("Book", "Book Chapter"), None, None),
}

FACTS = """facts AS (SELECT p.unit_kind, p.level, p.id, p.category, p.wid, w.work_type, w.pub_year, u.n_people
  FROM fx_pairs p JOIN fx_work w ON p.wid = w.wid JOIN fx_uni u ON p.wid = u.wid)
"""


def _where(categories, types, years, cap) -> str:
    quoted = lambda names: ", ".join(f"'{n}'" for n in names)
    parts = [f"category IN ({quoted(categories)})"]
    parts += [f"work_type IN ({quoted(types)})"] if types else []
    parts += [f"pub_year BETWEEN {years[0]} AND {years[1]}"] if years else []
    return " AND ".join(parts + ([f"n_people <= {cap}"] if cap else []))


def bitmaps(t):
    """Written once; every filter below reads it."""
    return stored(bm.work_bitmaps(c.work_cells(t.member, t.affil), bm.numbered_works(t.member, t.work_all)), "work-bitmaps")


@register("filtered_works", "\nUNION ALL ".join(
    f"SELECT '{name}' AS filter, unit_kind, level, id, COUNT(DISTINCT wid) AS n_works FROM facts WHERE {_where(*f)} GROUP BY unit_kind, level, id"
    for name, f in FILTERS.items()), ctes=FACTS)
def _(t):
    maps = bitmaps(t)
    # A row serves every filter that it passes, so all filters are one scan and one aggregation.
    passed = F.array_compact(F.array(*[F.when(bm.chosen(*f), F.lit(name)) for name, f in FILTERS.items()]))
    return bm.count_works(maps.withColumn("filter", F.explode(passed)), "filter", *bm.KEY)


@register("unit_set_works", """SELECT 'set_' || CAST(CAST(id AS BIGINT) % 3 AS STRING) AS unit_set, COUNT(DISTINCT wid) AS n_works FROM facts
WHERE unit_kind = 'Department' AND level = 'department' AND category IN ('within', 'across') AND pub_year BETWEEN 1994 AND 1996
GROUP BY CAST(id AS BIGINT) % 3""", ctes=FACTS)
def _(t):
    units = bitmaps(t).filter("unit_kind = 'Department' AND level = 'department'").filter(bm.chosen(("within", "across"), years=(1994, 1996)))
    return bm.count_works(units, F.concat(F.lit("set_"), (F.col("id").cast("bigint") % 3).cast("string")).alias("unit_set"))


@register("works_by_year_and_scope", """SELECT id, pub_year, COUNT(DISTINCT CASE WHEN category = 'within' THEN wid END) AS within_works,
COUNT(DISTINCT CASE WHEN category <> 'inter' THEN wid END) AS intra_works, COUNT(DISTINCT wid) AS all_works FROM facts
WHERE unit_kind = 'Program' AND level = 'department' GROUP BY id, pub_year""", ctes=FACTS)
def _(t):
    maps = bitmaps(t).filter("unit_kind = 'Program' AND level = 'department'")
    scopes = {"within_works": ("within",), "intra_works": ("within", "across"), "all_works": c.CATEGORIES}
    parts = [bm.count_works(maps.filter(bm.chosen(names)), "id", "pub_year").withColumnRenamed("n_works", column) for column, names in scopes.items()]
    joined = functools.reduce(lambda a, b: a.join(b, ["id", "pub_year"], "right"), parts)
    return joined.select("id", "pub_year", *[F.coalesce(column, F.lit(0)).alias(column) for column in scopes])
