"""Report shaping: rosters, joined cells, nested payloads, dictionaries.

Nested results are cut into parts of bounded size, so no anchor and no work
is ever collected whole into one row; the parts together hold every row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from jointwork.functions.expressions import joined_set, top_k
from jointwork.functions.text import college_anchor, truncate, unit_anchor_key
from jointwork.model import UNIT_TYPES, WORK_TYPES, in_kind
from jointwork.operators.skew import CHUNK, chunk_no, dense_index, pair_up
from jointwork.sources.writers import stored


def detail_keys(member: DataFrame, affil: DataFrame, kind: str) -> DataFrame:
    """Exact keys (unit, relation, person, partner, work) of the explosion.

    The partner's units stay one array, so no duplicates are produced that
    would have to be removed again.
    """
    units = affil.groupBy("pid").agg(F.collect_set("unit_id").alias("units"))
    mine = in_kind(affil.filter("NOT is_ext"), kind).groupBy("pid").agg(F.collect_set("unit_id").alias("own"))
    rows = member.join(units, "pid").join(mine, "pid", "left").drop("n_internal")
    pairs = pair_up(rows, "wid", "pid", "n_people", ordered=True, focal=F.col("own").isNotNull())
    flat = pairs.select("wid", F.col("pid_l").alias("pid"), F.col("pid_r").alias("cpid"), "is_ext_r", "units_r",
                        F.explode("own_l").alias("unit_id"))
    near = F.array_contains("units_r", F.col("unit_id"))
    far = F.size(F.array_remove("units_r", F.col("unit_id"))) > 0
    rel = F.when(F.col("is_ext_r"), F.array(F.lit(2))).otherwise(
        F.filter(F.array(F.when(near, F.lit(0)), F.when(far, F.lit(1))), lambda x: x.isNotNull())
    )
    return flat.select(F.col("unit_id").cast("string").alias("unit_id"), F.explode(rel).alias("rel"), "pid", "cpid", "wid")


def work_roster(member: DataFrame, person: DataFrame, first_n: int = 10) -> DataFrame:
    """One row per work: internal people first, the first n and the rest's number.

    Only the first n people of a work leave the map tasks (row_number limit);
    the overflow comes from the head count that members carry.
    """
    rows = member.join(person.select("pid", "pname", "inst"), "pid")
    first = top_k(rows, first_n, [F.asc("is_ext"), F.asc("pname"), F.asc("pid")], ["wid"])
    shown = first.groupBy("wid").agg(
        F.max("n_people").alias("n_people"),
        F.sort_array(F.collect_list(F.struct("rnk", "pid", "pname", "inst", "is_ext"))).alias("people"),
    )
    return shown.select(
        "wid", F.col("people"), F.greatest(F.col("n_people") - first_n, F.lit(0)).cast("bigint").alias("more")
    )


def shape_affiliations(affil: DataFrame, concat: bool, sep: str = "; ") -> DataFrame:
    """Affiliations of a person as one cell per attribute or one row per value."""
    cols = ["unit_label", "college", "discipline", "broad_field"]
    if not concat:
        return affil.select("pid", *cols).distinct()
    return affil.groupBy("pid").agg(*[joined_set(c, sep).alias(c) for c in cols])


def units_by_type(affil: DataFrame, sep: str = "; ") -> DataFrame:
    """One column of unit labels per unit type; the type list is fixed."""
    return affil.groupBy("pid").agg(
        *[joined_set(F.when(F.col("unit_type") == u, F.col("unit_label")), sep).alias(f"{u.lower()}_units") for u in UNIT_TYPES]
    )


def truncate_columns(df: DataFrame, widths: dict[str, int]) -> DataFrame:
    return df.select(*[truncate(F.col(c), widths[c]).alias(c) if c in widths else F.col(c) for c in df.columns])


def _anchors_of_row() -> Column:
    return F.filter(
        F.array(unit_anchor_key(F.col("unit_id")), college_anchor(F.col("college"))), lambda a: a.isNotNull()
    )


def anchor_rows(rows: DataFrame) -> DataFrame:
    """Each row under its unit anchor and, if it has one, its college anchor."""
    return rows.withColumn("anchor", F.explode(_anchors_of_row()))


def anchor_payload(rows: DataFrame, entry: list[str], work_size: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """Rows nested per (anchor, work, part).

    ``work_size`` names the column with an upper bound for the rows of one
    anchor and work; a group is cut into parts of about ``chunk`` rows.
    """
    a = anchor_rows(rows)
    ident = F.concat_ws("-", *[F.col(c).cast("string") for c in entry])
    part = F.lit(0).cast("bigint") if work_size is None else chunk_no(ident, F.col(work_size), chunk)
    return (
        a.withColumn("part", part)
        .groupBy("anchor", "wid", "part")
        .agg(F.collect_list(F.struct(*entry)).alias("rows"), F.count(F.lit(1)).alias("n_rows"))
    )


# Entry of a payload row: name there, column of the flat fact.
PAYLOAD_ROW = {
    "pid": "PersonId", "college": "College", "unit": "Department", "unit_type": "UnitType", "discipline": "Discipline", "field": "Broad_Field",
    "cpid": "Collab_PersonID", "c_college": "Collab_College", "c_unit": "Collab_Department", "c_unit_type": "Collab_UnitType",
    "c_discipline": "Collab_Disc", "c_field": "Collab_BF", "c_inst": "Collab_Institution", "rel": "Relationship", "dir": "Collab_Dir",
}


def self_contained_payload(fact: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(anchor, part, people, works, rows_by_work): the flat fact nested so that a part can be read alone.

    ``people`` maps id to (name, rank), partners without rank; ``works`` maps
    id to (title, type, year, detail), long texts cut; ``rows_by_work`` maps id
    to its rows of 15 fields.  Values are plain: the file format encodes
    repeats.  An anchor has a part per ``chunk`` rows.  The rows of a work stay
    together; only a work of more rows than a part is spread by row.
    """
    anchors = F.filter(F.array(unit_anchor_key(F.col("UnitId")), college_anchor(F.col("College"))), lambda k: k.isNotNull())
    rows = fact.withColumn("anchor", F.explode(anchors)).withColumnRenamed("Collab_ID", "wid")
    per_work = rows.groupBy("anchor", "wid").agg(F.count(F.lit(1)).alias("_w"))
    # Stored for their sizes: a row per anchor and the few works that are too long for a part meet the rows where they lie.
    totals = stored(per_work.groupBy("anchor").agg(F.sum("_w").alias("_n")), "totals")
    long = stored(per_work.filter(F.col("_w") > chunk).select("anchor", "wid", F.lit(True).alias("_long")), "long")
    ident = F.when(F.col("_long").isNull(), F.col("wid")).otherwise(F.concat_ws("-", "wid", *PAYLOAD_ROW.values()))
    sized = rows.filter("wid IS NOT NULL").join(totals, "anchor").join(long, ["anchor", "wid"], "left")
    # Rows are shuffled once, to their part; all further steps stay there.
    placed = sized.withColumn("part", chunk_no(ident, F.col("_n"), chunk)).repartition("anchor", "part")
    entry = F.struct(*[F.col(c).alias(n) for n, c in PAYLOAD_ROW.items()])
    about = F.struct(
        F.substring("Collab_Title", 1, 200).alias("title"), F.col("CollaborationType").alias("type"), F.col("Year").alias("year"),
        F.substring("Collab_Detail", 1, 100).alias("detail"),
    )
    person = lambda pid, name, rank: F.struct(F.col(pid).alias("id"), F.struct(F.col(name).alias("name"), rank.alias("rank")).alias("about"))
    met = F.array(person("PersonId", "PersonName", F.col("Rank")), person("Collab_PersonID", "Collab_PersonName", F.lit("")))
    # A work of a part is one row here, with its rows and the people in them.
    works = placed.groupBy("anchor", "part", "wid").agg(
        F.collect_list(entry).alias("rows"), F.min(about).alias("about"), F.array_distinct(F.flatten(F.collect_set(met))).alias("met")
    )
    people = (
        works.select("anchor", "part", F.explode("met").alias("p")).groupBy("anchor", "part", "p.id").agg(F.max(F.struct("p.about.rank", "p.about.name")).alias("a"))
        .groupBy("anchor", "part").agg(F.map_from_entries(F.collect_list(F.struct("id", F.struct("a.name", "a.rank")))).alias("people"))
    )
    nested = works.groupBy("anchor", "part").agg(
        F.map_from_entries(F.collect_list(F.struct("wid", "about"))).alias("works"), F.map_from_entries(F.collect_list(F.struct("wid", "rows"))).alias("rows_by_work")
    )
    return people.join(nested, ["anchor", "part"]).select("anchor", "part", "people", "works", "rows_by_work")


def explode_payload(payload: DataFrame) -> DataFrame:
    """Payload parts back to flat rows, with names, ranks and the work's columns from the part's own maps.

    The maps are unfolded to rows and joined by part and id: a row never
    carries the maps of its part.  ``payload`` is read once per map.
    """
    part = ["anchor", "part"]
    rows = payload.select(*part, F.explode("rows_by_work").alias("wid", "rows")).select(*part, "wid", F.explode("rows").alias("r")).select(*part, "wid", "r.*")
    works = payload.select(*part, F.explode("works").alias("wid", "w")).select(*part, "wid", "w.*")
    people = payload.select(*part, F.explode("people").alias("id", "p"))
    one = people.select(*part, F.col("id").alias("pid"), F.col("p.name").alias("name"), F.col("p.rank").alias("rank"))
    other = people.select(*part, F.col("id").alias("cpid"), F.col("p.name").alias("c_name"))
    return rows.join(works, [*part, "wid"]).join(one, [*part, "pid"]).join(other, [*part, "cpid"]).drop("part")


def string_dictionary(df: DataFrame, cols: list[str]) -> DataFrame:
    """One shared code per distinct string of several columns."""
    values = df.select(F.explode(F.array(*[F.col(c).cast("string") for c in cols])).alias("value"))
    return dense_index(values.filter("value IS NOT NULL").distinct(), ["value"], "code")



def extract_anchor_rows(details: DataFrame, unit_id) -> DataFrame:
    """All rows of one unit, of details or of affiliations: filtered there, before pairs are built, a report costs one unit only."""
    return details.filter(F.col("unit_id") == unit_id)


def payload_stats(rows: DataFrame) -> DataFrame:
    """Size of every anchor's payload.

    Rows per (anchor, work, person) are counted first; the distinct counts
    then run on that much smaller table.
    """
    a = anchor_rows(rows)
    works = a.groupBy("anchor", "wid").agg(F.count(F.lit(1)).alias("n"))
    per_work = works.groupBy("anchor").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_works"), F.max("n").alias("max_rows"))
    people = a.select("anchor", F.explode(F.array("pid", "cpid")).alias("p")).distinct().groupBy("anchor").agg(
        F.count(F.lit(1)).alias("n_people")
    )
    return per_work.join(people, "anchor").withColumn("rows_per_work", F.round(F.col("n_rows") / F.col("n_works"), 3))


def work_index(work: DataFrame) -> DataFrame:
    """0-based position of every work in id order and its type's position."""
    types = F.array(*[F.lit(x) for x in WORK_TYPES])
    idx = dense_index(work.select("wid", "work_type"), ["wid"], "work_idx")
    return idx.select("wid", "work_idx", (F.array_position(types, F.col("work_type")) - 1).cast("int").alias("type_idx"))


def export_nested(pairs: DataFrame, meta: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Long table to nested rows; the three category arrays always exist.

    One row per (entity, part).  The number of parts follows from the
    entity's row count, so the whole institution is many rows, not one.
    """
    key = ["unit_kind", "level", "id"]
    sizes = pairs.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    entry = F.struct("wid", "pairs")
    has = lambda c: F.sort_array(F.collect_list(F.when(F.col("category") == c, entry))).alias(c)
    nested = (
        pairs.join(sizes, key)
        .withColumn("part", chunk_no(F.col("wid"), F.col("_n"), chunk))
        .groupBy(*key, "part")
        .agg(has("within"), has("across"), has("inter"))
    )
    empty = F.lit(0).cast("bigint")
    full = meta.select(*key, "label").join(nested, key, "left")
    none = F.array().cast(nested.schema["within"].dataType)
    return full.select(
        *key, "label", F.coalesce("part", empty).alias("part"),
        *[F.coalesce(F.col(c), none).alias(c) for c in ("within", "across", "inter")],
    )


def summary_dataset(rollup: DataFrame, partners: DataFrame) -> DataFrame:
    """Works, pairs and the strongest partners of every key."""
    best = partners.groupBy("unit_kind", "level", F.col("unit").alias("id")).agg(
        F.sort_array(F.collect_list(F.struct("rnk", "partner", "works"))).alias("top")
    )
    text = F.array_join(F.transform("top", lambda x: F.concat(x["partner"], F.lit(":"), x["works"].cast("string"))), ";")
    return rollup.join(best, ["unit_kind", "level", "id"], "left").withColumn("top_partners", F.coalesce(text, F.lit(""))).drop("top")
