"""From raw match tables to the membership, affiliation and detail tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from jointwork.functions.expressions import rank_label
from jointwork.operators.skew import by_work, pair_up

# Duplicate discipline cohorts, old id -> (canonical id, name).
DISCIPLINE_MERGE = {
    454: (11, "Anthropology"),
    455: (15, "Architecture"),
    456: (16, "Architecture, Design, Planning, various"),
    457: (17, "Area and Ethnic Studies, various"),
    458: (43, "Communication and Communication Studies"),
    459: (106, "Linguistics"),
    460: (111, "Mass Communications/Media Studies"),
    461: (156, "Sociology"),
}
# Agencies whose grants are not counted.
EXCLUDED_AGENCIES = ("ACS", "AHA", "AHRC", "BBSRC", "EPSRC", "ERC", "ESRC", "MRC", "NERC", "STFC", "Wellcome")
def affil_union(unit_tables: Mapping[str, DataFrame]) -> DataFrame:
    """Distinct union of the unit tables, each tagged with its unit type."""
    tagged = [df.withColumn("unit_type", F.lit(name)) for name, df in unit_tables.items()]
    return reduce(lambda a, b: a.unionByName(b), tagged).distinct()


def college_union(tables: Iterable[DataFrame], columns: list[str]) -> DataFrame:
    """Union by column name over the shared columns, without duplicates."""
    return reduce(lambda a, b: a.unionByName(b), [t.select(*columns) for t in tables]).distinct()


def affil_enrich(affil: DataFrame, taxonomy: DataFrame, registry: DataFrame, colleges: DataFrame) -> DataFrame:
    """Add broad field, registry id and college; unmatched rows stay."""
    return (
        affil.join(taxonomy, ["inst", "group_id"], "left")
        .join(registry, ["inst", "unit_id"], "left")
        .join(colleges, ["inst", "unit_id", "group_id"], "left")
    )


def state_join(affil: DataFrame, institutions: DataFrame) -> DataFrame:
    return affil.join(institutions.select("inst", "state"), "inst", "left")


def merge_disciplines(affil: DataFrame, mapping: Mapping[int, tuple[int, str]] = DISCIPLINE_MERGE) -> DataFrame:
    """Fold duplicate cohorts into the canonical one; drop blank names.

    The mapping has eight fixed rows, so it is a literal map in the
    projection and needs no join.
    """
    ids = F.create_map(*[F.lit(v) for old, (new, _) in mapping.items() for v in (old, new)])
    names = F.create_map(*[F.lit(v) for new, name in mapping.values() for v in (new, name)])
    canonical = F.coalesce(F.element_at(ids, F.col("group_id")), F.col("group_id"))
    return (
        affil.filter((F.col("discipline") != "") & F.col("discipline").isNotNull())
        .withColumn("group_id", canonical)
        .withColumn("discipline", F.coalesce(F.element_at(names, F.col("group_id")), F.col("discipline")))
        .distinct()
    )


def focal_only(affil: DataFrame, inst: str) -> DataFrame:
    return affil.filter(F.col("inst") == inst)


def in_window(df: DataFrame, year_col: str, window: tuple[int, int]) -> DataFrame:
    return df.filter(F.col(year_col).between(*window))


def counted_books(books: DataFrame) -> DataFrame:
    """Whole books only; a null chapter flag counts as "not a chapter"."""
    return books.filter(
        (F.coalesce("is_chapter", F.lit(0)) == 0) & (F.col("is_duplicate") == 0) & (F.col("is_excluded") == 0)
    )


def active_grants(
    sources: Iterable[DataFrame],
    window: tuple[int, int],
    country: str = "US",
    min_per_year: float = 10.0,
    excluded: Iterable[str] = EXCLUDED_AGENCIES,
) -> DataFrame:
    """Research grants whose [start, end] years touch the window.

    No start date: always active.  No end date: the start must lie in it.
    """
    lo, hi = window
    start, end = F.year("start_date"), F.year("end_date")
    active = (
        F.col("start_date").isNull()
        | (F.col("end_date").isNotNull() & (start <= hi) & (end >= lo))
        | (F.col("end_date").isNull() & start.between(lo, hi))
    )
    keep = (
        ~F.col("agency").isin(*excluded)
        & (F.col("country") == country)
        & (F.col("dollars_per_year") >= min_per_year)
        & (F.col("is_research") == 1)
        & active
    )
    cols = ["pid", "grant_id", "agency", "grant_name", "start_date"]
    return reduce(lambda a, b: a.union(b), [s.filter(keep).select(*cols) for s in sources]).distinct()


def normalise_key(df: DataFrame, col: str) -> DataFrame:
    """Upper-case the work key once, at ingest, and drop missing keys."""
    return df.withColumn(col, F.upper(F.trim(F.col(col)))).filter(F.col(col).isNotNull())


def split_by_flag(articles: DataFrame) -> DataFrame:
    return articles.withColumn(
        "work_type", F.when(F.col("is_confproc") == 1, "Conference Proceeding").otherwise("Article")
    )


def title_lookup(works: DataFrame, journals: DataFrame, titles: DataFrame) -> DataFrame:
    """Late left joins of the wide text columns."""
    return works.join(journals, "journal_id", "left").join(by_work(titles), "wid", "left")


def start_year(ts: Column) -> Column:
    return F.year(F.to_date(ts))


def work_type_union(parts: Iterable[DataFrame]) -> DataFrame:
    """Seven work types in one layout, distinct."""
    cols = ["pid", "work_type", "wid", "pub_year", "detail", "title"]
    return reduce(lambda a, b: a.unionByName(b), [p.select(*cols) for p in parts]).distinct()



def membership(matches: DataFrame, person: DataFrame) -> DataFrame:
    """(work, person) once each, for works with company.

    A work belongs to the universe when at least two known people share it
    and one of them is internal.  The head count stays on the row because
    pair building and author caps need it.
    """
    # Brought to their works first: all further steps stay there.
    known = matches.select("wid", "pid").repartition("wid").distinct().join(person.select("pid", "is_ext"), "pid")
    sizes = (
        known.groupBy("wid")
        .agg(
            F.count(F.lit(1)).alias("n_people"),
            F.sum(F.when(F.col("is_ext"), 0).otherwise(1)).alias("n_internal"),
        )
        .filter((F.col("n_people") >= 2) & (F.col("n_internal") >= 1))
    )
    return known.join(by_work(sizes), "wid").select("wid", "pid", "is_ext", "n_people", "n_internal")


# What a place of a person says, and what its institution adds.
NAMED = ("state", "inst_name")
PLACE = ("is_ext", "inst", "unit_type", "unit_id", "unit_label", "college", "discipline", "broad_field")


def places(affil: DataFrame, also: Iterable[str] = ()) -> DataFrame:
    """(pid, places): the affiliations of a person as one short array."""
    return affil.groupBy("pid").agg(F.collect_list(F.struct(*PLACE, *also)).alias("places"))


def collab_pairs(
    member: DataFrame, keep_size: bool = False, affil: DataFrame | None = None, person: DataFrame | None = None, also: Iterable[str] = ()
) -> DataFrame:
    """Focal person and collaborator on each work (focal side internal).

    With ``affil`` both people bring their places along from the member rows,
    so ``both_sides_explode`` has nothing to look up and the rows of a work stay
    where its pairs are.  ``also`` names more columns of ``affil`` for the places;
    with ``person`` names and the focal rank come along too.
    """
    rows = member.select("wid", "pid", "is_ext", "n_people", F.col("n_people").alias("people"))
    if affil is not None:
        rows = rows.join(places(affil, also), "pid")
    if person is not None:
        rows = rows.join(person.select("pid", "pname", "rank"), "pid")
    pairs = pair_up(rows, "wid", "pid", "n_people", ordered=True, focal=~F.col("is_ext"))
    size = [F.col("people_l").alias("n_people")] if keep_size else []
    near = [] if affil is None else [F.col("places_l").alias("_mine"), F.col("places_r").alias("_theirs")]
    names = [] if person is None else [F.col("pname_l").alias("pname"), F.col("rank_l").alias("rank"), F.col("pname_r").alias("cname")]
    return pairs.select("wid", F.col("pid_l").alias("pid"), F.col("pid_r").alias("cpid"), *size, *near, *names)


def pairs_of(member: DataFrame, people: DataFrame, works: DataFrame | None = None) -> DataFrame:
    """Pairs of ``collab_pairs`` whose focal person is one of ``people`` (internal), on ``works`` if given.

    People and works are chosen before pairs are built, so a report on one
    unit costs that unit's works and not all of them.
    """
    focal = people.select("pid").distinct()
    mine = member.join(focal, "pid", "left_semi").select("wid").distinct()
    if works is not None:
        mine = mine.join(by_work(works.select("wid").distinct()), "wid", "left_semi")
    rows = member.join(by_work(mine), "wid", "left_semi").join(focal.withColumn("f", F.lit(True)), "pid", "left")
    rows = rows.select("wid", "pid", F.coalesce("f", F.lit(False)).alias("f"), "n_people")
    pairs = pair_up(rows, "wid", "pid", "n_people", ordered=True, focal=F.col("f"))
    return pairs.select("wid", F.col("pid_l").alias("pid"), F.col("pid_r").alias("cpid"))


def sided_members(focal: DataFrame, partners: DataFrame, home: DataFrame, known: DataFrame) -> DataFrame:
    """One row per (source, work, person) with the sides it may stand on: ``f`` focal, ``p`` partner.

    ``focal`` and ``partners`` hold (source, wid, pid) of all kinds of work at
    once; a kind may take its sides from different tables, windows and flags.
    Focal rows count for people of ``home``, partner rows for people of
    ``known``.  Works without a focal row or with one person are left out; the
    head count stays on the row for pair building.
    """
    key = ["source", "wid", "pid"]
    side = lambda df, f: df.select(*key, F.lit(f).alias("f"), F.lit(not f).alias("p"))
    flag = lambda people, name: people.select("pid", F.lit(True).alias(name)).distinct()
    # Sides are put together before people are looked up: Spark takes a union of two joins on pid for partitioned
    # by pid even when it has coalesced their partitions differently, and would group the sides of a person apart.
    both = side(focal, True).unionByName(side(partners, False)).groupBy(*key).agg(F.max("f").alias("f"), F.max("p").alias("p"))
    rows = both.join(flag(home, "ours"), "pid", "left").join(flag(known, "met"), "pid", "left").select(
        *key, (F.col("f") & F.col("ours").isNotNull()).alias("f"), (F.col("p") & F.col("met").isNotNull()).alias("p")
    ).filter("f OR p")
    sizes = rows.groupBy("source", "wid").agg(F.count(F.lit(1)).alias("n_people"), F.max("f").alias("any_focal")).filter("any_focal AND n_people >= 2")
    return rows.join(by_work(sizes.drop("any_focal")), ["source", "wid"])


def sided_pairs(members: DataFrame) -> DataFrame:
    """(source, wid, pid, cpid): every focal row with every other partner row of the work, in tiles."""
    rows = members.select(F.struct("source", "wid").alias("w"), "pid", "f", "p", "n_people")
    pairs = pair_up(rows, "w", "pid", "n_people", ordered=True, focal=F.col("f"), partner=F.col("p"))
    return pairs.select("w.source", "w.wid", F.col("pid_l").alias("pid"), F.col("pid_r").alias("cpid"))


def relation_code(focal_unit: Column, partner_unit: Column, partner_ext: Column) -> Column:
    return F.when(partner_ext, 2).when(focal_unit == partner_unit, 0).otherwise(1)


def both_sides_explode(
    pairs: DataFrame, affil: DataFrame, focal_affil: DataFrame | None = None, also: Iterable[str] = ()
) -> DataFrame:
    """Every affiliation of the focal person (of ``focal_affil``, if given) times every one of the partner.

    This is the row-level fact; the count operators never need it.  People meet
    their places as one array each, unless the pairs bring them (see
    ``collab_pairs``), and both arrays are unfolded last: only pairs are
    shuffled, never the rows of the fact.  ``also`` names more columns of
    ``affil`` to bring along for the partner.
    """
    if "_mine" not in pairs.columns:
        mine = places(affil if focal_affil is None else focal_affil).withColumnRenamed("places", "_mine")
        theirs = places(affil, also).select(F.col("pid").alias("cpid"), F.col("places").alias("_theirs"))
        pairs = pairs.join(mine, "pid").join(theirs, "cpid")
    kept = [c for c in pairs.columns if c not in ("_mine", "_theirs")]
    one = pairs.select(*kept, F.explode(F.filter("_mine", lambda x: ~x["is_ext"])).alias("_f"), "_theirs")
    two = one.select(*kept, "_f", F.explode("_theirs").alias("_c"))
    focal = [F.col(f"_f.{c}").alias(c) for c in PLACE if c not in ("is_ext", "inst")]
    partner = [F.col(f"_c.{c}").alias(f"c_{c}") for c in (*PLACE, *also)]
    return two.select(*kept, *focal, *partner).withColumn("rel", relation_code(F.col("unit_id"), F.col("c_unit_id"), F.col("c_is_ext")))


def classify(details: DataFrame) -> DataFrame:
    """Direction and relationship labels of a detail row."""
    return details.withColumn("collab_dir", F.when(F.col("rel") == 2, "External").otherwise("Internal")).withColumn(
        "relationship",
        F.when(F.col("rel") == 2, "Across Institutions").when(F.col("rel") == 0, "Within Unit").otherwise("Across Units"),
    )


def details_base(
    pairs: DataFrame, affil: DataFrame, person: DataFrame, work: DataFrame | None, home: str, institutions: DataFrame | None = None,
    home_name: str | None = None,
) -> DataFrame:
    """The 29-column flat fact, ready to be written partitioned by UnitType.

    ``institutions`` (inst, state, inst_name) names the partners; what it lacks
    stays without state and is named by its id.  Without ``work`` the pairs
    carry the columns of their work themselves.  Pairs that bring names and places
    (``collab_pairs`` with the affiliations of ``named_places``) are not shuffled at
    all: a pair with the places of both people is many times a member row.
    """
    if "_mine" in pairs.columns:
        # Wide pairs are not sorted for their work either: a task holds the works of its part.
        d = pairs if work is None else pairs.join(work.hint("shuffle_hash"), "wid", "left")
        return _fact(classify(both_sides_explode(d, affil, also=NAMED)), home, home_name)
    p = person.select("pid", "pname", "rank")
    c = person.select(F.col("pid").alias("cpid"), F.col("pname").alias("cname"))
    # Each pair meets its work and its people before it is unfolded into rows; a place knows its institution before that.
    if work is not None:
        pairs = pairs.join(by_work(work), "wid", "left")
    d = classify(both_sides_explode(pairs.join(p, "pid"), named_places(affil, institutions), affil, also=NAMED)).join(c, "cpid")
    return _fact(d, home, home_name)


def named_places(affil: DataFrame, institutions: DataFrame | None) -> DataFrame:
    """``affil`` with state and name of the institution; pairs may only bring these places along if ``institutions`` names each once."""
    if institutions is None:
        return affil.withColumn("state", F.lit(None).cast("string")).withColumn("inst_name", F.col("inst"))
    names = institutions.select("inst", "state", "inst_name")
    return affil.join(names, "inst", "left").withColumn("inst_name", F.coalesce("inst_name", "inst"))


def _fact(d: DataFrame, home: str, home_name: str | None) -> DataFrame:
    s = lambda name: F.col(name).cast("string")
    return d.select(
        F.lit(home).alias("InstitutionId"), F.lit(home_name or home).alias("InstitutionName"), s("college").alias("College"),
        s("unit_id").alias("UnitId"), s("unit_label").alias("Department"), s("unit_type").alias("UnitType"),
        s("pid").alias("PersonId"), s("pname").alias("PersonName"), s("broad_field").alias("Broad_Field"),
        s("discipline").alias("Discipline"), s("work_type").alias("CollaborationType"),
        s("c_inst").alias("Collab_InstitutionId"), s("c_inst_name").alias("Collab_Institution"),
        s("c_state").alias("Collab_State"), s("c_college").alias("Collab_College"),
        s("c_unit_id").alias("Collab_UnitId"), s("c_unit_label").alias("Collab_Department"),
        s("c_unit_type").alias("Collab_UnitType"), s("c_broad_field").alias("Collab_BF"),
        s("c_discipline").alias("Collab_Disc"), s("cpid").alias("Collab_PersonID"), s("cname").alias("Collab_PersonName"),
        F.col("pub_year").cast("int").alias("Year"), s("wid").alias("Collab_ID"), s("detail").alias("Collab_Detail"),
        s("title").alias("Collab_Title"), s("rank").alias("Rank"), s("collab_dir").alias("Collab_Dir"),
        s("relationship").alias("Relationship"),
    )


def details_from_types(
    works: DataFrame, partners: DataFrame, affil: DataFrame, home: str, institutions: DataFrame | None = None, home_name: str | None = None
) -> DataFrame:
    """The flat fact of all kinds of work from their raw tables.

    ``works``: focal rows (source, wid, pid, work_type, pub_year, detail,
    title); a pair takes the work's columns from the focal row, so a person
    with two rows for a work has both.  ``partners``: (source, wid, pid).
    ``affil`` says who is known, where, and under which name and rank.
    """
    inside = affil.filter("NOT is_ext")
    pairs = sided_pairs(sided_members(works, partners, inside, affil))
    person = affil.groupBy("pid").agg(F.min("pname").alias("pname"), F.min(rank_label(F.col("rank_code"))).alias("rank"))
    places = affil.select("pid", "is_ext", "inst", "unit_type", "unit_id", "unit_label", "college", "discipline", "broad_field").distinct()
    with_work = pairs.join(works.distinct(), ["source", "wid", "pid"])
    return details_base(with_work, places, person, None, home, institutions, home_name)
