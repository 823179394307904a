"""Administrator metrics: participation, engagement, retention, white space."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from jointwork.functions.expressions import flag_sum, pct, rank_bucket, ratio, top_k
from jointwork.model import in_kind
from jointwork.operators.skew import TILE, by_work, cut_lineage, pair_up


def roster_load(roster: DataFrame) -> DataFrame:
    """(dept, pid, rank bucket, first college), one row per dept and person."""
    first = roster.groupBy("dept").agg(F.min("college").alias("college"))
    return (
        roster.groupBy("dept", "pid").agg(F.min(rank_bucket(F.col("rank"))).alias("rank"))
        .join(first, "dept", "left")
        .select("dept", "pid", "rank", "college")
    )


def person_totals(work_counts: DataFrame, active: DataFrame) -> DataFrame:
    """Works per relation for every active person."""
    return (
        work_counts.join(active.select("pid"), "pid", "left_semi").groupBy("pid").agg(
            flag_sum(F.col("across") > 0).alias("n_across"), flag_sum(F.col("inter") > 0).alias("n_inter")
        )
    )


def dept_people(affil: DataFrame, kind: str = "Department") -> DataFrame:
    """(dept label, pid) of the active side, any unit of the kind."""
    return in_kind(affil.filter("NOT is_ext"), kind).select(F.col("unit_label").alias("dept"), "pid").distinct()


def active_dept_people(affil: DataFrame, member: DataFrame, kind: str = "Department") -> DataFrame:
    return dept_people(affil, kind).join(member.select("pid").distinct(), "pid", "left_semi")


def dept_metrics(
    cells: DataFrame, labels: DataFrame, roster: DataFrame, active: DataFrame, work_flags: DataFrame
) -> DataFrame:
    """Participation and rates per department; null where no roster exists.

    Rates use the roster head count and fall back to the active people.
    Roster departments without any work appear as zero rows.
    """
    m, total, n_ext = F.col("m"), F.col("total"), F.col("n_ext")
    hit = (m >= 2) | (total > m) | (n_ext > 0)
    works = (
        cells.join(by_work(work_flags.select("wid", "interdisc")), "wid", "left")
        .groupBy("id").agg(
            flag_sum(m >= 2).alias("within"), flag_sum(total > m).alias("across"), flag_sum(n_ext > 0).alias("inter"),
            flag_sum(hit).alias("all_works"), flag_sum(hit & (F.coalesce("interdisc", F.lit(0)) == 1)).alias("inter_disc"),
        )
        .join(labels.select("id", F.col("label").alias("dept"), "college"), "id")
    )
    faculty = roster.groupBy("dept").agg(F.count_distinct("pid").alias("faculty"), F.min("college").alias("r_college"))
    act = active.groupBy("dept").agg(F.count_distinct("pid").alias("active"))
    j = works.join(act, "dept", "left").join(faculty, "dept", "full_outer")
    active_n = F.coalesce(F.col("active"), F.lit(0))
    denom = F.coalesce(F.col("faculty"), active_n)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return j.select(
        "dept",
        F.when(F.col("id").isNull(), F.col("r_college")).otherwise(F.col("college")).alias("college"),
        "faculty",
        active_n.alias("active"),
        pct(active_n, F.col("faculty")).alias("pct_active"),
        zero("within").alias("within"),
        zero("across").alias("across"),
        zero("inter").alias("inter"),
        ratio(zero("across"), denom).alias("across_per_faculty"),
        ratio(zero("inter"), denom).alias("inter_per_faculty"),
        F.coalesce(pct(F.col("inter_disc"), F.col("all_works")), F.lit(0.0)).alias("interdisc_pct"),
        F.col("id").isNull().alias("zero_collab"),
    )


def roster_only_depts(roster: DataFrame, active: DataFrame) -> DataFrame:
    """Roster departments that nobody with a collaboration belongs to."""
    quiet = roster.join(active.select("dept").distinct(), "dept", "left_anti")
    return quiet.groupBy("dept").agg(F.count_distinct("pid").alias("faculty")).withColumn("works", F.lit(0).cast("bigint"))


def rank_engagement(roster: DataFrame, active: DataFrame, totals: DataFrame) -> DataFrame:
    """Per department and rank: head count, % with any and with across works."""
    state = active.join(totals, "pid", "left").select("dept", "pid", F.lit(1).alias("act"), "n_across")
    j = roster.join(state, ["dept", "pid"], "left")
    g = j.groupBy("dept", "rank").agg(
        F.count(F.lit(1)).alias("faculty"),
        flag_sum(F.col("act") == 1).alias("n_any"),
        flag_sum(F.col("n_across") > 0).alias("n_acr"),
    )
    return g.select("dept", "rank", "faculty", pct(F.col("n_any"), F.col("faculty")).alias("pct_any"),
                    pct(F.col("n_acr"), F.col("faculty")).alias("pct_across"))


def rank_lens(roster: DataFrame, totals: DataFrame) -> DataFrame:
    """Institution-wide engagement per rank; people without works count as 0.

    The median is exact: ``percentile`` keeps a histogram of the distinct
    work counts per rank, which is small however many people there are.
    """
    people = roster.groupBy("pid").agg(F.min("rank").alias("rank")).join(totals, "pid", "left")
    acr, itr = F.coalesce("n_across", F.lit(0)), F.coalesce("n_inter", F.lit(0))
    n = F.count(F.lit(1))
    return people.groupBy("rank").agg(
        n.alias("n"),
        pct(flag_sum(F.col("n_across").isNotNull()), n).alias("pct_active"),
        pct(flag_sum(acr > 0), n).alias("pct_across"),
        F.percentile(acr, F.lit(0.5)).alias("med_across"),
        pct(flag_sum(itr > 0), n).alias("pct_inter"),
        F.percentile(itr, F.lit(0.5)).alias("med_inter"),
    )


def retention(work_counts: DataFrame, active: DataFrame, totals: DataFrame, person: DataFrame, roster: DataFrame, k: int = 8) -> DataFrame:
    """Works only one member of a department covers, top k members each, with name and rank.

    The rank is that of the roster, else the person's own.

    (dept, work) groups are reduced to a head count and one person id; a
    group of one is that person's unique work.  No window over works.
    """
    across = work_counts.filter("across > 0").select("pid", "wid")
    covers = across.join(active, "pid").groupBy("dept", "wid").agg(F.count(F.lit(1)).alias("n"), F.min("pid").alias("pid"))
    unique = covers.filter("n = 1").groupBy("dept", "pid").agg(F.count(F.lit(1)).alias("unique_works"))
    rows = (
        active.join(totals, "pid").join(unique, ["dept", "pid"], "left")
        .select("dept", "pid", F.col("n_across").alias("across"), F.col("n_inter").alias("inter"),
                F.coalesce("unique_works", F.lit(0)).alias("unique_works"))
    )
    best = top_k(rows, k, [F.desc("unique_works"), F.desc("across"), F.asc("pid")], ["dept"])
    own = person.groupBy("pid").agg(F.min("pname").alias("name"), F.min(rank_bucket(F.col("rank"))).alias("own_rank"))
    listed = roster.groupBy("pid").agg(F.min("rank").alias("roster_rank"))
    named = best.join(own, "pid", "left").join(listed, "pid", "left")
    return named.withColumn("rank", F.coalesce("roster_rank", "own_rank")).drop("roster_rank", "own_rank")


def discipline_vector(affil: DataFrame, active: DataFrame, kind: str = "Department") -> DataFrame:
    """Members per (dept, discipline); all disciplines of a member count."""
    disc = in_kind(affil.filter("NOT is_ext AND discipline IS NOT NULL"), kind).select("pid", "discipline").distinct()
    return active.join(disc, "pid").groupBy("dept", "discipline").agg(F.count(F.lit(1)).alias("n"))


def dept_sizes(roster: DataFrame, active: DataFrame) -> DataFrame:
    """Roster head count per department, else the number of active people."""
    r = roster.groupBy("dept").agg(F.count_distinct("pid").alias("faculty"))
    a = active.groupBy("dept").agg(F.count_distinct("pid").alias("active"))
    return r.join(a, "dept", "full_outer").select("dept", F.coalesce("faculty", "active").alias("size"))


def cosine_candidates(vectors: DataFrame, min_sim: float, tile: int = TILE) -> DataFrame:
    """(a, b), a < b: every pair whose cosine can reach ``min_sim``, and few others.

    ``vectors``: (dept, discipline, n), n > 0.  In one order of disciplines,
    rare before frequent, a vector's prefix ends where the length that is left
    falls below ``min_sim`` of the whole: two vectors without a discipline in
    both prefixes have a smaller cosine.  Prefixes meet in an inverted list by
    discipline; a frequent one is cut into tiles.
    """
    frequency = vectors.groupBy("discipline").agg(F.count(F.lit(1)).alias("df"))
    each = Window.partitionBy("dept")
    behind = each.orderBy("df", "discipline").rowsBetween(0, Window.unboundedFollowing)
    left = F.sqrt(F.sum(F.col("n") * F.col("n")).over(behind)) / F.sqrt(F.sum(F.col("n") * F.col("n")).over(each))
    # What is left, the place itself included, must be able to reach the threshold; the margin covers rounding.
    prefix = vectors.join(frequency, "discipline").withColumn("left", left).filter(F.col("left") >= min_sim * (1 - 1e-9)).select("discipline", "dept", "df")
    met = pair_up(prefix, "discipline", "dept", "df", tile=tile)
    return met.select(F.col("dept_l").alias("a"), F.col("dept_r").alias("b")).distinct()


def cosine_join(vectors: DataFrame, min_sim: float) -> DataFrame:
    """(a, b, sim) of all pairs with a cosine of ``min_sim`` or more."""
    norms = vectors.groupBy("dept").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    side = lambda c: vectors.select(F.col("dept").alias(c), "discipline", F.col("n").alias("n" + c))
    length = lambda c: norms.select(F.col("dept").alias(c), F.col("norm").alias("norm" + c))
    dots = cosine_candidates(vectors, min_sim).join(side("a"), "a").join(side("b"), ["b", "discipline"]).groupBy("a", "b").agg(
        F.sum(F.col("na") * F.col("nb")).alias("dot")
    )
    sim = F.col("dot") / (F.col("norma") * F.col("normb"))
    return dots.join(length("a"), "a").join(length("b"), "b").select("a", "b", sim.alias("sim")).filter(F.col("sim") >= min_sim)


def whitespace_pairs(
    vectors: DataFrame, sizes: DataFrame, shared_works: DataFrame, colleges: DataFrame,
    min_size: int = 8, min_sim: float = 0.04, n_shared: int = 5, k: int = 30,
) -> DataFrame:
    """Similar departments that collaborate little, with both colleges (``colleges``: dept, college) and shared disciplines."""
    big = sizes.filter(F.col("size") >= min_size)
    v = cut_lineage(vectors.join(big, "dept", "left_semi"))
    side = lambda c: big.select(F.col("dept").alias(c), F.col("size").alias("s" + c))
    of = lambda c: colleges.select(F.col("dept").alias(c), F.col("college").alias("college_" + c))
    scored = (
        cosine_join(v, min_sim).join(side("a"), "a").join(side("b"), "b")
        .join(shared_works, ["a", "b"], "left")
        .withColumn("actual", F.coalesce("works", F.lit(0)))
        .withColumn("score", F.col("sim") / (1 + F.col("actual") / F.sqrt(F.col("sa") * F.col("sb"))))
    )
    best = top_k(scored.select("a", "b", "sa", "sb", "sim", "actual", F.round("score", 4).alias("score")), k,
                 [F.desc("score"), F.asc("a"), F.asc("b")])
    best = cut_lineage(best)  # k rows
    pairs = best.select("a", "b").join(v.select(F.col("dept").alias("a"), "discipline", F.col("n").alias("na")), "a").join(
        v.select(F.col("dept").alias("b"), "discipline", F.col("n").alias("nb")), ["b", "discipline"])
    common = top_k(pairs.withColumn("low", F.least("na", "nb")), n_shared, [F.desc("low"), F.asc("discipline")], ["a", "b"])
    names = common.groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("rnk", "discipline"))).alias("d"))
    return best.join(names, ["a", "b"]).join(of("a"), "a", "left").join(of("b"), "b", "left").select(
        "a", "b", "college_a", "college_b", F.col("sa").alias("size_a"), F.col("sb").alias("size_b"), F.round("sim", 3).alias("sim"), "actual", "score",
        F.array_join(F.transform("d", lambda x: x["discipline"]), ",").alias("shared_disc"),
    )


def type_mix(work: DataFrame) -> DataFrame:
    return work.groupBy("work_type").agg(F.count(F.lit(1)).alias("works"))


def exec_summary(member: DataFrame, roster: DataFrame, work_flags: DataFrame, dept_cells: DataFrame, active: DataFrame, units: DataFrame) -> DataFrame:
    """One row of institution totals.

    Every part is a one-row aggregate; they are joined on a constant, which
    is a join of single rows.
    """
    one = F.lit(1).alias("one")
    heads = member.groupBy("wid").agg(F.max("n_internal").alias("i"), F.max("n_people").alias("p"))
    works = heads.agg(
        F.count(F.lit(1)).alias("universe"), flag_sum(F.col("i") >= 2).alias("internal_works"),
        flag_sum(F.col("p") > F.col("i")).alias("external_works"),
    )
    people = active.agg(F.count_distinct("pid").alias("scholars"))
    faculty = roster.agg(F.count_distinct("pid").alias("faculty_total"))
    cross = dept_cells.filter("total > m").agg(F.count_distinct("wid").alias("cross_unit_works"))
    disc = work_flags.agg(flag_sum(F.col("interdisc") == 1).alias("inter_disc"))
    # Departments of the metrics table: units with works, and those of the roster.
    with_works = dept_cells.select("id").distinct().join(units, "id").select(F.col("label").alias("dept"))
    depts = with_works.union(roster.select("dept")).agg(F.count_distinct("dept").alias("dept_count"))
    out = works.select("*", one)
    for part in (people, faculty, cross, disc, depts):
        out = out.join(F.broadcast(part.select("*", one)), "one")
    return out.select(
        "universe", "scholars", "faculty_total", pct(F.col("scholars"), F.col("faculty_total")).alias("pct_faculty_active"),
        "internal_works", "external_works", "cross_unit_works", pct(F.col("inter_disc"), F.col("universe")).alias("interdisc_pct"), "dept_count",
    )


def most_and_least_connected(metrics: DataFrame, min_faculty: int = 10, k: int = 5) -> DataFrame:
    """Departments with the highest and lowest across works per faculty."""
    rate = F.coalesce("across_per_faculty", F.lit(0.0))
    rows = metrics.filter(F.coalesce("faculty", F.lit(0)) >= min_faculty).select("dept", rate.alias("rate"), "faculty")
    top = top_k(rows, k, [F.desc("rate"), F.asc("dept")]).withColumn("list", F.lit("top"))
    low = top_k(rows, k, [F.asc("rate"), F.asc("dept")]).withColumn("list", F.lit("least"))
    return top.union(low).select("list", "rnk", "dept", "rate", "faculty")
