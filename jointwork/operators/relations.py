"""Anchor-relative buckets, unit and college matrices, partner rankings.

Matrices count pairs of keys by inclusion and exclusion.  On a work, m_a
people hold key a and m_ab hold both a and b; two different people join a and
b exactly if m_a * m_b - m_ab > 0, and m_a * (m_b - m_ab) pairs lead from a to
people of b who are not in a.  Head counts are summed in the map tasks, the
keys of a work meet in tiles, and no row holds a whole work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from jointwork.functions.expressions import choose2, flag_sum, per_type_sums, top_k
from jointwork.functions.text import college_anchor, unit_anchor_key
from jointwork.model import ACROSS, EXTERNAL, SCOPES, TYPE_COLUMNS, WITHIN, in_kind, level_key
from jointwork.operators.skew import by_work, pair_up


def person_keys(affil: DataFrame, kind: str | None, level: str = "department") -> DataFrame:
    """Sorted keys per internal person at a level (a handful per person)."""
    rows = in_kind(affil.filter("NOT is_ext"), kind).select("pid", level_key(level).alias("k")).filter("k IS NOT NULL")
    return rows.groupBy("pid").agg(F.sort_array(F.collect_set("k")).alias("keys"))


def key_heads(member: DataFrame, affil: DataFrame, kind: str | None, level: str = "department", author_cap: int | None = None) -> DataFrame:
    """(wid, k, m, both): people of a work per key, and per other key those who hold it as well.

    ``both`` has an entry for a key only if somebody on the work holds it with
    ``k``; it is no longer than the list of keys.  People of a work with the
    same keys are one row before its rows come together; from there on the
    steps stay where the work lies.
    """
    rows = member if author_cap is None else member.filter(F.col("n_people") <= author_cap)
    people = rows.filter("NOT is_ext").select("wid", "pid").join(person_keys(affil, kind, level), "pid")
    same = people.select("wid", "keys").repartition("wid").groupBy("wid", "keys").agg(F.count(F.lit(1)).alias("n"))
    cells = same.select("wid", "keys", "n", F.explode("keys").alias("k")).select("wid", "k", "n", F.explode("keys").alias("other"))
    counts = cells.groupBy("wid", "k", "other").agg(F.sum("n").alias("n"))
    joint = F.collect_list(F.when(F.col("other") != F.col("k"), F.struct("other", "n")))
    return counts.groupBy("wid", "k").agg(F.max(F.when(F.col("other") == F.col("k"), F.col("n"))).alias("m"), F.map_from_entries(joint).alias("both"))


def key_pairs(heads: DataFrame, keep: tuple[str, ...] = (), within: tuple[str, ...] = (), ordered: bool = False) -> DataFrame:
    """(wid, a, b, m_a, m_b, m_ab) for the keys of a work, a < b, or a <> b if ``ordered``.

    ``keep`` columns come along from the side of a; only keys with equal
    ``within`` columns meet.
    """
    n_keys = F.count(F.lit(1)).over(Window.partitionBy("wid"))
    rows = heads.filter("wid IS NOT NULL").select("wid", *within, "k", "m", "both", n_keys.alias("n_keys"), *keep)
    met = pair_up(rows, ["wid", *within], "k", "n_keys", ordered=ordered)
    both = F.coalesce(F.try_element_at("both_l", F.col("k_r")), F.lit(0))
    return met.select(
        "wid", F.col("k_l").alias("a"), F.col("k_r").alias("b"), F.col("m_l").alias("m_a"), F.col("m_r").alias("m_b"), both.alias("m_ab"),
        *[F.col(f"{c}_l").alias(c) for c in keep],
    )


def matrix(
    member: DataFrame,
    affil: DataFrame,
    kind: str,
    level: str = "department",
    work: DataFrame | None = None,
    by_type: bool = False,
    author_cap: int | None = None,
) -> DataFrame:
    """Distinct works per unordered key pair; the diagonal is "within"."""
    heads = key_heads(member, affil, kind, level, author_cap)
    if by_type:
        heads = heads.join(by_work(work.select("wid", "work_type")), "wid")
    keep = ("work_type",) if by_type else ()
    off = key_pairs(heads, keep).filter(F.col("m_a") * F.col("m_b") > F.col("m_ab")).select("a", "b", *keep)
    cells = off.unionByName(heads.filter("m >= 2").select(F.col("k").alias("a"), F.col("k").alias("b"), *keep))
    one = F.lit(1).cast("bigint")
    if not by_type:
        return cells.groupBy("a", "b").agg(F.count(one).alias("works"))
    return cells.groupBy("a", "b").agg(*per_type_sums(TYPE_COLUMNS, one), F.count(one).alias("works"))


def chord_flows(college_matrix: DataFrame) -> DataFrame:
    """Both directions of every college pair, for a chord view."""
    back = college_matrix.filter("a <> b").select(F.col("b").alias("source"), F.col("a").alias("target"), "works")
    return college_matrix.select(F.col("a").alias("source"), F.col("b").alias("target"), "works").union(back)


def units_of(affil: DataFrame) -> DataFrame:
    """One row per internal unit."""
    return (
        affil.filter("NOT is_ext")
        .groupBy(F.col("unit_id").cast("string").alias("anchor"))
        .agg(F.min("unit_type").alias("unit_type"), F.min("unit_label").alias("label"), F.min("college").alias("college"))
    )


def anchor_buckets(member: DataFrame, affil: DataFrame) -> DataFrame:
    """Works per anchor and bucket, by the closest relation of each pair.

    "Across" looks at internal people of any kind who are not in the anchor.
    (work, anchor) rows are counted, so the buckets need no pair rows.
    """
    units = affil.filter("NOT is_ext").select("pid", F.col("unit_id").cast("string").alias("anchor")).distinct()
    heads = member.filter("NOT is_ext").join(units, "pid").groupBy("wid", "anchor").agg(
        F.count(F.lit(1)).alias("m"), F.max("n_internal").alias("total"), F.max("n_people").alias("people")
    )
    return heads.groupBy("anchor").agg(
        flag_sum(F.col("m") >= 2).alias("within_works"),
        flag_sum(F.col("total") > F.col("m")).alias("across_works"),
        flag_sum(F.col("people") > F.col("total")).alias("inter_works"),
    )


def partner_units(member: DataFrame, affil: DataFrame, same_kind: bool = True) -> DataFrame:
    """Across works and pairs per (anchor, partner unit).

    A partner counts when one of its people, who is not in the anchor, shares
    the work with someone of the anchor.  With ``same_kind`` the partner must
    have the anchor's unit type.
    """
    heads = key_heads(member, affil, None)
    within: tuple[str, ...] = ()
    if same_kind:
        heads, within = heads.join(units_of(affil).select(F.col("anchor").alias("k"), "unit_type"), "k"), ("unit_type",)
    theirs = F.col("m_b") - F.col("m_ab")
    met = key_pairs(heads, within=within, ordered=True).filter(theirs > 0)
    return met.groupBy(F.col("a").alias("anchor"), F.col("b").alias("partner")).agg(
        F.count(F.lit(1)).alias("works"), F.sum(F.col("m_a") * theirs).alias("pairs")
    )


def partner_institutions(member: DataFrame, affil: DataFrame, person: DataFrame) -> DataFrame:
    """External works and pairs per (anchor, institution).

    Both sides are head counts per work before they meet, so a work brings
    units-times-institutions rows, not people-times-people.
    """
    units = affil.filter("NOT is_ext").select("pid", F.col("unit_id").cast("string").alias("anchor")).distinct()
    # Units come as one array per person, and people are brought to their work before they are unfolded: one narrow shuffle a side.
    held = units.groupBy("pid").agg(F.collect_list("anchor").alias("anchors"))
    inside = member.filter("NOT is_ext").select("wid", "pid").join(held, "pid").select("wid", "anchors").repartition("wid")
    ours = inside.select("wid", F.explode("anchors").alias("anchor")).groupBy("wid", "anchor").agg(F.count(F.lit(1)).alias("m"))
    outside = member.filter("is_ext").select("wid", "pid").join(person.select("pid", "inst"), "pid").select("wid", "inst").repartition("wid")
    theirs = outside.groupBy("wid", "inst").agg(
        F.count(F.lit(1)).alias("x")
    )
    return ours.join(by_work(theirs), "wid").groupBy("anchor", "inst").agg(
        F.count(F.lit(1)).alias("works"), F.sum(F.col("m") * F.col("x")).alias("pairs")
    )


def partner_summed(partners: DataFrame, buckets: DataFrame) -> DataFrame:
    """Partner-summed across works next to the distinct count."""
    summed = partners.groupBy("anchor").agg(F.sum("works").alias("summed_works"), F.count(F.lit(1)).alias("partners"))
    return summed.join(buckets.select("anchor", F.col("across_works").alias("distinct_works")), "anchor")


def top_partners(matrix_df: DataFrame, n: int = 8) -> DataFrame:
    """Strongest n off-diagonal partners of every key."""
    off = matrix_df.filter("a <> b")
    both = off.select(F.col("a").alias("unit"), F.col("b").alias("partner"), "works").union(
        off.select(F.col("b").alias("unit"), F.col("a").alias("partner"), "works")
    )
    return top_k(both, n, [F.desc("works"), F.asc("partner")], ["unit"])


def unit_partner_entries(member: DataFrame, affil: DataFrame, person: DataFrame) -> DataFrame:
    """Anchor entries (name, rel, works, pairs) for all three relations."""
    labels = units_of(affil)
    units = affil.filter("NOT is_ext").select("pid", F.col("unit_id").cast("string").alias("anchor")).distinct()
    own = (
        member.filter("NOT is_ext").join(units, "pid").groupBy("wid", "anchor").agg(F.count(F.lit(1)).alias("m"))
        .filter("m >= 2")
        .groupBy("anchor").agg(F.count(F.lit(1)).alias("works"), F.sum(choose2(F.col("m"))).alias("pairs"))
        .join(labels.select("anchor", "label"), "anchor")
        .select("anchor", F.col("label").alias("name"), F.lit(WITHIN).alias("rel"), "works", "pairs")
    )
    across = (
        partner_units(member, affil)
        .join(labels.select(F.col("anchor").alias("partner"), F.col("label").alias("name")), "partner")
        .select("anchor", "name", F.lit(ACROSS).alias("rel"), "works", "pairs")
    )
    inter = partner_institutions(member, affil, person).select(
        "anchor", F.col("inst").alias("name"), F.lit(EXTERNAL).alias("rel"), "works", "pairs"
    )
    return own.unionByName(across).unionByName(inter)


def unit_partner_list(entries: DataFrame, scope: str = "all", n: int = 50) -> DataFrame:
    kept = entries.filter(F.col("rel").isin(*SCOPES[scope]))
    return top_k(kept, n, [F.desc("works"), F.asc("name"), F.asc("rel")], ["anchor"])


def graph_nodes(nodes: DataFrame, n: int) -> DataFrame:
    """The n strongest nodes of the unit or college graph with their works, and how many nodes are not shown."""
    total = nodes.agg(F.count(F.lit(1)).alias("total"))
    shown = nodes.orderBy(F.desc("works"), F.asc("id")).limit(n)
    hidden = F.greatest(F.lit(0), F.col("total") - n).cast("bigint").alias("dropped")
    return shown.withColumn("one", F.lit(1)).join(F.broadcast(total.withColumn("one", F.lit(1))), "one").select("id", "works", hidden)


def unit_graph(nodes: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """Strongest n nodes and the edges inside them."""
    keep = nodes.orderBy(F.desc("works"), F.asc("id")).limit(n).select("id")
    return (
        edges.filter("a <> b")
        .join(keep.select(F.col("id").alias("a")), "a", "left_semi")
        .join(keep.select(F.col("id").alias("b")), "b", "left_semi")
        .select("a", "b", "works")
    )


# --------------------------------------------------------------- anchors


def anchor_list(affil: DataFrame) -> DataFrame:
    """Unit and college anchors with their keys."""
    inside = affil.filter("NOT is_ext")
    units = inside.groupBy("unit_id").agg(F.min("unit_label").alias("label"), F.min("unit_type").alias("unit_type")).select(
        unit_anchor_key(F.col("unit_id")).alias("key"), "label", F.lit("unit").alias("kind"), "unit_type",
        F.col("unit_id").cast("string").alias("unit_id"),
    )
    colleges = inside.filter("college IS NOT NULL").select("college").distinct().select(
        college_anchor(F.col("college")).alias("key"), F.col("college").alias("label"), F.lit("college").alias("kind"),
        F.lit(None).cast("string").alias("unit_type"), F.lit(None).cast("string").alias("unit_id"),
    )
    return units.union(colleges)


def anchor_members(affil: DataFrame) -> DataFrame:
    """Bridge table anchor - person, for units and colleges."""
    inside = affil.filter("NOT is_ext")
    units = inside.select(unit_anchor_key(F.col("unit_id")).alias("anchor"), "pid")
    colleges = inside.filter("college IS NOT NULL").select(college_anchor(F.col("college")).alias("anchor"), "pid")
    return units.union(colleges).distinct()


def anchors_of_person(members: DataFrame) -> DataFrame:
    """The inverted map; a person has a few anchors."""
    return members.groupBy("pid").agg(
        F.count(F.lit(1)).alias("n_anchors"), F.array_join(F.sort_array(F.collect_set("anchor")), ",").alias("anchors")
    )


def resolve_anchor(requests: DataFrame, anchors: DataFrame) -> DataFrame:
    """Match by key, else by label, else by unit id; first hit wins.

    Three equi-joins on the anchor's names replace one OR condition, which
    would force a nested-loop join.
    """
    names = (
        anchors.select(F.col("key").alias("raw"), F.lit(1).alias("pri"), "key")
        .union(anchors.select(F.col("label"), F.lit(2), "key"))
        .union(anchors.filter("unit_id IS NOT NULL").select(F.col("unit_id"), F.lit(3), "key"))
        .groupBy("raw")
        .agg(F.min(F.struct("pri", "key")).alias("hit"))
    )
    return requests.join(names, "raw", "left").select(*requests.columns, F.col("hit.key").alias("anchor"))


def preferred_anchor(members: DataFrame, anchors: DataFrame, current: str, kind: str) -> DataFrame:
    """Anchor to open for a person: current, same kind, department, any."""
    a = anchors.select(F.col("key").alias("anchor"), F.col("kind").alias("akind"), "unit_type")
    is_unit = F.col("akind") == "unit"
    pri = (
        F.when(F.col("anchor") == current, 1)
        .when(is_unit & (F.col("unit_type") == kind), 2)
        .when(is_unit & (F.col("unit_type") == "Department"), 3)
        .otherwise(4)
    )
    return members.join(a, "anchor").groupBy("pid").agg(
        F.min(F.struct(pri.alias("pri"), F.col("anchor").alias("anchor"))).alias("best")
    ).select("pid", "best.anchor", "best.pri")
