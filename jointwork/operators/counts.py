"""Works and pairs per unit, college, institution and person.

All numbers come from ``member`` (who is on which work) and ``affil`` (which
units a person belongs to).  The pair explosion is never built here: with m
people of a key, T internal people and X external people on a work,

    within = C(m, 2)      across = m * (T - m)      inter = m * X

so the largest intermediate has one row per (work, key).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from jointwork.functions.expressions import choose2, flag_sum, joined_set
from jointwork.model import (
    ACROSS,
    EXTERNAL,
    KINDS,
    LEVELS,
    WITHIN,
    in_kind,
    kinds_of,
    level_key,
    relation_name,
)
from jointwork.operators.skew import by_work, pair_up

CATEGORIES = ("within", "across", "inter")


def ext_per_work(member: DataFrame) -> DataFrame:
    """Distinct external people per work."""
    return member.filter("is_ext").groupBy("wid").agg(F.count_distinct("pid").alias("n_ext"))


def internal_per_work(member: DataFrame) -> DataFrame:
    """Distinct internal people per work, whatever unit type they have."""
    return member.filter("NOT is_ext").groupBy("wid").agg(F.count_distinct("pid").alias("n_internal"))


def work_type(observations: DataFrame) -> DataFrame:
    """One type per work; ``min`` makes the choice independent of row order."""
    return observations.groupBy("wid").agg(F.min("work_type").alias("work_type"))


def person_disciplines(affil: DataFrame) -> DataFrame:
    return affil.filter("NOT is_ext AND discipline IS NOT NULL").select("pid", "discipline").distinct()


def interdisciplinary(member: DataFrame, affil: DataFrame) -> DataFrame:
    """Work flag: more than one discipline value among its internal people.

    A single person with two disciplines is enough.  Min and max of the value
    answer "more than one distinct" with a constant-size buffer per work.
    """
    return (
        member.filter("NOT is_ext")
        .join(person_disciplines(affil), "pid")
        .groupBy("wid")
        .agg(F.when(F.min("discipline") != F.max("discipline"), 1).otherwise(0).alias("interdisc"))
    )


def work_meta(member: DataFrame, affil: DataFrame, work: DataFrame) -> DataFrame:
    """Authors, interdisciplinary flag and descriptive fields per work."""
    spans = person_disciplines(affil).groupBy("pid").agg(
        F.min("discipline").alias("d_lo"), F.max("discipline").alias("d_hi")
    )
    people = member.join(spans, "pid", "left").groupBy("wid").agg(
        F.count(F.lit(1)).alias("n_authors"),
        F.min(F.when(~F.col("is_ext"), F.col("d_lo"))).alias("d_lo"),
        F.max(F.when(~F.col("is_ext"), F.col("d_hi"))).alias("d_hi"),
    )
    return people.join(by_work(work), "wid", "left").select(
        "wid",
        "work_type",
        "n_authors",
        F.when(F.col("d_lo") != F.col("d_hi"), 1).otherwise(0).alias("interdisc"),
        "pub_year",
        "title",
        "detail",
    )


def person_slots(affil: DataFrame, kinds: list[str], levels: list[str], total_scope: str) -> DataFrame:
    """Per internal person the (kind, level, key) cells to be counted.

    ``slots`` are the keys; column ``t<i>`` says whether the person is part of
    the total T of the i-th (kind, level).  ``total_scope='level'`` counts only
    people who have a key at the level; ``'kind'`` counts everybody who has a
    unit of the kind.  The institution is the same for every kind, so it is
    one slot without a kind.
    """
    if total_scope not in ("level", "kind"):
        raise ValueError("total_scope must be 'level' or 'kind'")
    rows = affil.filter(~F.col("is_ext")).withColumn("ks", kinds_of(F.col("unit_type")))
    slot = lambda kind, level: F.struct(
        kind.alias("unit_kind"), F.lit(level).alias("level"), level_key(level).alias("id")
    )
    wanted = F.array_intersect("ks", F.array(*[F.lit(k) for k in kinds]))

    def slots_at(level: str) -> Column:
        if level == "institution":
            return F.array(slot(F.lit(None).cast("string"), level))
        return F.transform(wanted, lambda k: slot(k, level))

    found, totals = [slots_at(level) for level in levels], []
    for i, (kind, level) in enumerate(_targets(kinds, levels)):
        counted = F.lit(True) if level == "institution" else F.array_contains("ks", kind)
        if total_scope == "level":
            counted = counted & level_key(level).isNotNull()
        totals.append(F.max(F.when(counted, 1).otherwise(0)).alias(f"t{i}"))
    keyed = F.filter(F.concat(*found), lambda x: x["id"].isNotNull())
    return rows.withColumn("keyed", keyed).groupBy("pid").agg(
        F.array_distinct(F.flatten(F.collect_list("keyed"))).alias("slots"), *totals
    )


def _targets(kinds: list[str], levels: list[str]) -> list[tuple[str, str]]:
    return [(k, v) for v in levels for k in kinds]


def work_cells(
    member: DataFrame,
    affil: DataFrame,
    kinds: Iterable[str] = KINDS,
    levels: Iterable[str] = LEVELS,
    total_scope: str = "level",
) -> DataFrame:
    """m, T and X per (work, kind, level, key), all levels together.

    Both sides of the last join are counts: heads per (work, key), bounded by
    the number of keys, and one row of totals per work.  People are reduced in
    the map tasks, so a work with very many people is no hot join key.
    """
    kinds, levels = list(kinds), list(levels)
    targets = _targets(kinds, levels)
    placed = member.select("wid", "pid", "is_ext").join(person_slots(affil, kinds, levels, total_scope), "pid", "left")
    totals = placed.groupBy("wid").agg(
        F.sum(F.when(F.col("is_ext"), 1).otherwise(0)).alias("n_ext"),
        *[F.sum(F.coalesce(f"t{i}", F.lit(0))).alias(f"t{i}") for i in range(len(targets))],
    )
    heads = (
        placed.filter("NOT is_ext")
        .select("wid", F.explode("slots").alias("s"))
        .groupBy("wid", "s.unit_kind", "s.level", "s.id")
        .agg(F.count(F.lit(1)).alias("m"))
    )
    if "institution" in levels:
        every = F.when(F.col("level") == "institution", F.array(*[F.lit(k) for k in kinds])).otherwise(F.array("unit_kind"))
        heads = heads.withColumn("unit_kind", F.explode(every))
    total = None
    for i, (kind, level) in enumerate(targets):
        hit = (F.col("unit_kind") == kind) & (F.col("level") == level)
        total = F.when(hit, F.col(f"t{i}")) if total is None else total.when(hit, F.col(f"t{i}"))
    return heads.join(by_work(totals), "wid").select("wid", "unit_kind", "level", "id", "m", total.alias("total"), "n_ext")


def work_changes(new: DataFrame, affil: DataFrame, kind: str, level: str, total_scope: str = "level") -> DataFrame:
    """What new (wid, pid, is_ext) rows add to their works: (wid, unit_kind, level, id, n).

    People per key carry kind, level and id; the work's own sums have no kind,
    and ``id`` says which: 'people', 'internal', 'external', 'total'.
    """
    placed = new.select("wid", "pid", "is_ext").join(person_slots(affil, [kind], [level], total_scope), "pid", "left")
    sums = {"people": F.lit(1), "internal": F.when(F.col("is_ext"), 0).otherwise(1), "external": F.when(F.col("is_ext"), 1).otherwise(0),
            "total": F.coalesce("t0", F.lit(0))}
    own = F.array(*[F.struct(F.lit(None).cast("string").alias("unit_kind"), F.lit(None).cast("string").alias("level"), F.lit(name).alias("id"),
                             value.cast("bigint").alias("n")) for name, value in sums.items()])
    keyed = F.transform(F.coalesce(F.when(~F.col("is_ext"), F.col("slots")), F.array().cast("array<struct<unit_kind:string,level:string,id:string>>")), lambda s: F.struct(
        F.coalesce(s["unit_kind"], F.lit(kind)).alias("unit_kind"), s["level"].alias("level"), s["id"].alias("id"), F.lit(1).cast("bigint").alias("n")))
    rows = placed.select("wid", F.explode(F.concat(own, keyed)).alias("c")).select("wid", "c.*").filter("n > 0")
    return rows.groupBy("wid", "unit_kind", "level", "id").agg(F.sum("n").alias("n"))


def cells_of(changes: DataFrame) -> DataFrame:
    """The cells of ``work_cells`` from summed changes, for works of two people or more with an internal one."""
    names = ["people", "internal", "external", "total"]
    sums = changes.filter("unit_kind IS NULL").groupBy("wid").agg(
        *[F.coalesce(F.max(F.when(F.col("id") == n, F.col("n"))), F.lit(0)).alias(n) for n in names]
    ).filter("people >= 2 AND internal >= 1")
    heads = changes.filter("unit_kind IS NOT NULL").withColumnRenamed("n", "m")
    return heads.join(by_work(sums), "wid").select("wid", "unit_kind", "level", "id", "m", "total", F.col("external").alias("n_ext"))


def work_flags() -> dict[str, Column]:
    m, total, n_ext = F.col("m"), F.col("total"), F.col("n_ext")
    return {"within": m >= 2, "across": total > m, "inter": n_ext > 0}


def _pairs() -> dict[str, Column]:
    m, total, n_ext = F.col("m"), F.col("total"), F.col("n_ext")
    return {"within": choose2(m), "across": m * (total - m), "inter": m * n_ext}


def pairs_long(cells: DataFrame) -> DataFrame:
    """(kind, level, id, category, work, pairs), only qualifying categories."""
    flags, pairs = work_flags(), _pairs()
    entry = F.array(
        *[
            F.when(flags[c], F.struct(F.lit(c).alias("category"), pairs[c].alias("pairs")))
            for c in CATEGORIES
        ]
    )
    return cells.select(
        "unit_kind", "level", "id", "wid", F.explode(F.filter(entry, lambda e: e.isNotNull())).alias("e")
    ).select("unit_kind", "level", "id", "e.category", "wid", "e.pairs")


def unit_pairs(member, affil, kind: str, level: str, total_scope: str = "level") -> DataFrame:
    return pairs_long(work_cells(member, affil, [kind], [level], total_scope))


def institution_pairs(member: DataFrame, affil: DataFrame) -> DataFrame:
    """The whole institution as one key, listed under both kinds."""
    return pairs_long(work_cells(member, affil, KINDS, ["institution"]))


def entity_meta(affil: DataFrame, kind: str, level: str) -> DataFrame:
    """Distinct keys of a level with one label and one college each."""
    label = {"department": "unit_label", "college": "college", "institution": "inst"}[level]
    rows = in_kind(affil.filter("NOT is_ext"), None if level == "institution" else kind)
    return (
        rows.select(level_key(level).alias("id"), F.col(label).alias("label"), "college")
        .filter("id IS NOT NULL")
        .groupBy("id")
        .agg(F.min("label").alias("label"), F.min("college").alias("college"))
        .select(F.lit(kind).alias("unit_kind"), F.lit(level).alias("level"), "id", "label", "college")
    )


def scope_rollup(cells: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Works per scope and pairs per category for every key.

    (work, key) is unique in ``cells``, so plain sums replace count-distinct
    and a hot key is reduced inside the map tasks.
    """
    f, p = work_flags(), _pairs()
    out = cells.groupBy("unit_kind", "level", "id").agg(
        flag_sum(f["within"]).alias("within_works"),
        flag_sum(f["across"]).alias("across_works"),
        flag_sum(f["inter"]).alias("inter_works"),
        flag_sum(f["within"] | f["across"]).alias("intra_works"),
        flag_sum(f["within"] | f["across"] | f["inter"]).alias("all_works"),
        F.sum(p["within"]).alias("within_collabs"),
        F.sum(p["across"]).alias("across_collabs"),
        F.sum(p["inter"]).alias("inter_collabs"),
    )
    if labels is not None:
        out = out.join(labels.select("unit_kind", "level", "id", "label"), ["unit_kind", "level", "id"], "left")
    return out


def set_rollup(cells: DataFrame) -> DataFrame:
    """Set sizes |W|, |A|, |I|, |W∪A|, |W∪A∪I| per key, in one aggregation: (work, key) is unique in ``cells``."""
    f = work_flags()
    any_ = f["within"] | f["across"] | f["inter"]
    return cells.filter(any_).groupBy("unit_kind", "level", "id").agg(
        flag_sum(f["within"]).alias("within_set"), flag_sum(f["across"]).alias("across_set"), flag_sum(f["inter"]).alias("inter_set"),
        flag_sum(f["within"] | f["across"]).alias("intra_set"), F.count(F.lit(1)).alias("all_set"),
    )


# ---------------------------------------------------------------- people


def person_units(affil: DataFrame) -> DataFrame:
    """Sorted unit ids per person over all unit types (a few per person)."""
    return affil.groupBy("pid").agg(F.sort_array(F.collect_set(F.col("unit_id").cast("string"))).alias("units"))


def person_min_rel(member: DataFrame, affil: DataFrame) -> DataFrame:
    """Closest relation of every ordered collaborator pair on every work.

    Instead of exploding both sides' affiliations and taking a minimum, the
    unit sets are compared as arrays: overlapping sets mean "within".
    """
    rows = member.join(person_units(affil), "pid", "left")
    pairs = pair_up(rows, "wid", "pid", "n_people", ordered=True, focal=~F.col("is_ext"))
    shared = F.coalesce(F.arrays_overlap("units_l", "units_r"), F.lit(False))
    return pairs.select(
        F.col("pid_l").alias("pid"),
        "wid",
        F.col("pid_r").alias("cpid"),
        F.when(F.col("is_ext_r"), EXTERNAL).when(shared, WITHIN).otherwise(ACROSS).alias("rel"),
    )


def _subsets(units: Column) -> Column:
    """All non-empty subsets of a short sorted array, each as text with the sign of inclusion and exclusion."""
    start = F.array(F.struct(F.lit("").alias("subset"), F.lit(-1).alias("sign")))
    grown = F.aggregate(units, start, lambda sets, u: F.concat(sets, F.transform(sets, lambda s: F.struct(
        F.concat(s["subset"], F.lit("|"), u).alias("subset"), (-s["sign"]).alias("sign")))))
    return F.filter(grown, lambda s: s["subset"] != "")


def person_work_counts(member: DataFrame, affil: DataFrame) -> DataFrame:
    """Distinct collaborators per (person, work) and relation, without pairs.

    Whoever shares a unit with a person is counted by inclusion and exclusion
    over the subsets of the person's units: n_T people of the work hold all
    units of T, so the sum of n_T over odd subsets less that over even ones
    is the number of people who hold any.  The people of a work are first
    summed per set of units (in the map tasks); a set of k units brings
    2^k - 1 rows, k being a few, and no row holds a whole work.
    """
    profiled = (
        member.filter("NOT is_ext").join(person_units(affil), "pid", "left")
        .withColumn("units", F.coalesce("units", F.array().cast("array<string>")))
        .select("wid", "pid", "units", "n_people", "n_internal")
    )
    heads = profiled.filter(F.size("units") > 0).groupBy("wid", "units").agg(F.count(F.lit(1)).alias("n"))
    subsets = heads.select("wid", "units", "n", F.explode(_subsets(F.col("units"))).alias("s")).select("wid", "units", "n", "s.subset", "s.sign")
    held = F.sum("n").over(Window.partitionBy("wid", "subset"))
    near = subsets.withColumn("held", held).groupBy("wid", "units").agg(F.sum(F.col("sign") * F.col("held")).alias("near"))
    within = F.coalesce(F.col("near") - 1, F.lit(0)).cast("bigint")
    return profiled.join(by_work(near), ["wid", "units"], "left").select(
        "pid", "wid", within.alias("within"), (F.col("n_internal") - 1 - within).cast("bigint").alias("across"),
        (F.col("n_people") - F.col("n_internal")).cast("bigint").alias("inter"),
    )


def people_of_kind(affil: DataFrame, kind: str) -> DataFrame:
    return in_kind(affil.filter("NOT is_ext"), kind).select("pid").distinct()


def person_pairs(work_counts: DataFrame, affil: DataFrame, kind: str) -> DataFrame:
    """Long person table; the kind only decides who is listed."""
    entries = F.filter(
        F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("pairs")) for c in CATEGORIES]),
        lambda e: e["pairs"] > 0,
    )
    return (
        work_counts.join(people_of_kind(affil, kind), "pid", "left_semi")
        .select("pid", "wid", F.explode(entries).alias("e"))
        .select(F.lit(kind).alias("unit_kind"), F.col("pid").alias("id"), "e.category", "wid", "e.pairs")
    )


def person_pairs_from_rel(min_rel: DataFrame, affil: DataFrame, kind: str) -> DataFrame:
    """Same table from the pair-grain relation, for checking the formula."""
    return (
        min_rel.join(people_of_kind(affil, kind), "pid", "left_semi")
        .groupBy(F.col("pid").alias("id"), "wid", relation_name(F.col("rel")).alias("category"))
        .agg(F.count_distinct("cpid").alias("pairs"))
        .select(F.lit(kind).alias("unit_kind"), "id", "category", "wid", "pairs")
    )


def person_meta(person: DataFrame, affil: DataFrame, kind: str, sep: str = "|") -> DataFrame:
    """Name, rank and the person's disciplines, colleges and units of a kind."""
    cells = (
        in_kind(affil.filter("NOT is_ext"), kind)
        .groupBy("pid")
        .agg(
            joined_set("discipline", sep).alias("disc"),
            joined_set("college", sep).alias("college"),
            joined_set("unit_label", sep).alias("units"),
        )
    )
    names = person.groupBy("pid").agg(F.min("pname").alias("label"), F.min("rank").alias("rank"))
    return cells.join(names, "pid", "left").select(
        F.lit(kind).alias("unit_kind"),
        F.col("pid").alias("id"),
        F.coalesce("label", F.col("pid").cast("string")).alias("label"),
        "rank",
        "disc",
        "college",
        "units",
    )


def works_per_person(work_counts: DataFrame, work: DataFrame, scope: str = "all", types=None) -> DataFrame:
    """Distinct works per scholar under a scope and an optional type filter."""
    wanted = {"within": ["within"], "across": ["across"], "inter": ["inter"],
              "intra": ["within", "across"], "all": list(CATEGORIES)}[scope]
    hit = F.lit(False)
    for c in wanted:
        hit = hit | (F.col(c) > 0)
    rows = work_counts.filter(hit).select("pid", "wid")
    if types:
        rows = rows.join(by_work(work.filter(F.col("work_type").isin(*types)).select("wid")), "wid", "left_semi")
    return rows.groupBy("pid").agg(F.count(F.lit(1)).alias("works"))


def multi_affil_people(affil: DataFrame, kind: str = "Department") -> DataFrame:
    """Per unit the people who also belong to another unit of the kind."""
    rows = in_kind(affil.filter("NOT is_ext"), kind).select("pid", "unit_id").distinct()
    many = rows.groupBy("pid").agg(
        F.count(F.lit(1)).alias("n_units"),
        F.array_join(F.transform(F.sort_array(F.collect_set("unit_id")), lambda u: u.cast("string")), ",").alias("units"),
    ).filter("n_units > 1")
    return rows.join(many, "pid").select("unit_id", "pid", "n_units", "units")


def within_defs_compare(cells: DataFrame, min_rel: DataFrame, affil: DataFrame, kind: str) -> DataFrame:
    """Works within a unit by head count (a) and by classified pairs (b)."""
    a = cells.filter((F.col("level") == "department") & (F.col("m") >= 2)).select("id", "wid", F.lit(1).alias("a"))
    units = in_kind(affil.filter("NOT is_ext"), kind).select("pid", F.col("unit_id").cast("string").alias("id")).distinct()
    near = min_rel.filter(F.col("rel") == WITHIN)
    b = (
        near.join(units, "pid")
        .join(units.select(F.col("pid").alias("cpid"), "id"), ["cpid", "id"], "left_semi")
        .select("id", "wid")
        .distinct()
        .withColumn("b", F.lit(1))
    )
    both = a.join(by_work(b), ["id", "wid"], "full_outer")
    return both.groupBy("id").agg(
        flag_sum(F.col("a") == 1).alias("works_a"),
        flag_sum(F.col("b") == 1).alias("works_b"),
        flag_sum(F.col("b").isNull()).alias("a_only"),
        flag_sum(F.col("a").isNull()).alias("b_only"),
    )
