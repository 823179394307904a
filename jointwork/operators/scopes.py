"""Filters: relation scope, author cap, work type, text and country."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from jointwork.model import ACROSS, EXTERNAL, SCOPES, WITHIN, WORK_TYPES


def scope_filter(df: DataFrame, scope: str, col: str = "rel") -> DataFrame:
    return df.filter(F.col(col).isin(*SCOPES[scope]))


def author_cap(member: DataFrame, cap: int | None) -> DataFrame:
    """Works with at most ``cap`` people; applied before pairs are built."""
    return member if cap is None else member.filter(F.col("n_people") <= cap)


def type_filter(df: DataFrame, types: Iterable[str] | None) -> DataFrame:
    """Empty or unknown selections mean every type."""
    chosen = [t for t in (types or []) if t in WORK_TYPES]
    return df.filter(F.col("work_type").isin(*chosen)) if chosen else df


def relate_edges(edges: DataFrame, members: DataFrame, person: DataFrame) -> DataFrame:
    """Edges seen from every anchor they touch, with their relation.

    Both ends in the anchor: within.  Otherwise external when an end outside
    the anchor is external, else across.  Edges meet anchors through their
    ends, so an anchor only receives its own edges.
    """
    # A person has a few anchors: one small array per person, met once for each end; no union, no aggregation of edges.
    anchors = members.groupBy("pid").agg(F.collect_set("anchor").alias("anchors"))
    ends = person.select("pid", "is_ext").join(anchors, "pid", "left").withColumn(
        "anchors", F.coalesce("anchors", F.array().cast("array<string>"))
    )
    side = lambda c: ends.select(F.col("pid").alias(c), F.col("is_ext").alias("x" + c), F.col("anchors").alias("in" + c))
    values = [c for c in edges.columns if c not in ("a", "b")]
    out = (
        edges.join(side("a"), "a").join(side("b"), "b")
        .select("a", "b", *values, "xa", "xb", "ina", "inb", F.explode(F.array_union("ina", "inb")).alias("anchor"))
        .withColumn("a_in", F.array_contains("ina", F.col("anchor"))).withColumn("b_in", F.array_contains("inb", F.col("anchor")))
    )
    outside = (~F.col("a_in") & F.col("xa")) | (~F.col("b_in") & F.col("xb"))
    rel = F.when(F.col("a_in") & F.col("b_in"), WITHIN).when(outside, EXTERNAL).otherwise(ACROSS)
    return out.select("anchor", "a", "b", *values, F.col("a_in").cast("int").alias("a_in"), F.col("b_in").cast("int").alias("b_in"), rel.alias("rel"))


def interdisc_works(work_meta: DataFrame) -> DataFrame:
    """Definition one: the work's flag."""
    return work_meta.filter("interdisc = 1")


def interdisc_rows(details: DataFrame) -> DataFrame:
    """Definition two: focal and partner disciplines of a row differ."""
    return details.filter("discipline <> c_discipline")


def detail_filters(
    details: DataFrame,
    college: str | None = None,
    unit_label: str | None = None,
    disciplines: Iterable[str] = (),
    partner_disciplines: Iterable[str] = (),
    years: Iterable[int] = (),
    title_contains: str | None = None,
    detail_contains: str | None = None,
) -> DataFrame:
    """Cascading report filters; an empty filter selects everything."""
    out = details
    if college is not None:
        out = out.filter(F.col("college") == college)
    if unit_label is not None:
        out = out.filter(F.col("unit_label") == unit_label)
    for col, values in (("discipline", disciplines), ("c_discipline", partner_disciplines), ("pub_year", years)):
        values = list(values)
        if values:
            out = out.filter(F.col(col).isin(*values))
    for col, needle in (("title", title_contains), ("detail", detail_contains)):
        if needle:
            out = out.filter(F.lower(col).contains(needle.lower()))
    return out


def qualifying_rows(
    intl: DataFrame,
    countries: Iterable[str] = (),
    partner_type: str = "all",
    types: Iterable[str] = (),
) -> DataFrame:
    """International rows that pass; one such row counts the work."""
    countries, types = list(countries), list(types)
    out = intl
    if types:
        name = F.when(F.col("is_confproc") == 1, "Conference Proceeding").otherwise("Article")
        out = out.filter(name.isin(*types))
    if countries:
        out = out.filter(F.col("country").isin(*countries))
    if partner_type != "all":
        out = out.filter(F.col("partner_type") == partner_type)
    return out


def name_search(person: DataFrame, query: str, n: int = 10) -> DataFrame:
    """Case-insensitive contains on the whole name; at least two characters."""
    q = query.strip().lower()
    if len(q) < 2:
        return person.limit(0)
    return person.filter(F.lower("pname").contains(q)).orderBy("pname", "pid").limit(n)
