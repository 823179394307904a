"""Report shaping, sources and sinks.

Sink queries write the derived tables to the shared folder and read them
back, so their result depends on what was really written.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from jointwork.functions.text import college_anchor_key, compact_unit, payload_filename, unit_anchor_key
from jointwork.model import KIND_UNIT_TYPES, KINDS, TYPE_COLUMNS
from jointwork.operators import counts as c, extract as ex, network as n, reconcile as q, relations as r, reports as rp
from jointwork.operators.skew import shared_dir
from jointwork.plans.counting import entity_labels
from jointwork.plans.networking import pair_counts
from jointwork.plans.extracting import DETAILS_SQL, flat_fact
from jointwork.plans.registry import register
from jointwork.sources import readers as rd, writers as wr
from jointwork.sources.writers import stored


def details(t):
    return ex.both_sides_explode(ex.collab_pairs(t.member, affil=t.affil), t.affil)


@register("work_roster", """SELECT wid, string_agg(concat(pname, '@', inst), ';' ORDER BY rn) AS people, MAX(greatest(n_people - 10, 0)) AS more
FROM (SELECT m.wid, m.n_people, p.pname, p.inst, row_number() OVER (PARTITION BY m.wid ORDER BY p.is_ext, p.pname, p.pid) AS rn
  FROM fx_member m JOIN fx_person p ON m.pid = p.pid) WHERE rn <= 10 GROUP BY wid""")
def _(t):
    people = F.array_join(F.transform("people", lambda x: F.concat(x["pname"], F.lit("@"), x["inst"])), ";")
    return rp.work_roster(t.member, t.person).select("wid", people.alias("people"), "more")


def _joined(col):
    return f"COALESCE(string_agg(DISTINCT {col}, '; ' ORDER BY {col}), '') AS {col}"


@register("concat_affiliations", "SELECT pid, " + ", ".join(
    _joined(x) for x in ("unit_label", "college", "discipline", "broad_field")) + " FROM fx_affil GROUP BY pid")
def _(t):
    return rp.shape_affiliations(t.affil, concat=True)


@register("explode_affiliations", "SELECT DISTINCT pid, unit_label, college, discipline, broad_field FROM fx_affil")
def _(t):
    return rp.shape_affiliations(t.affil, concat=False)


@register("unit_cols_by_type", "SELECT pid, " + ", ".join(
    f"COALESCE(string_agg(DISTINCT CASE WHEN unit_type = '{u}' THEN unit_label END, '; ' ORDER BY CASE WHEN unit_type = '{u}' THEN unit_label END), '') AS {u.lower()}_units"
    for u in ("Department", "Program", "Medical", "Clinical")) + " FROM fx_affil GROUP BY pid")
def _(t):
    return rp.units_by_type(t.affil)


@register("truncate_text", "SELECT doc_id, substr(text, 1, 200) AS title, substr(source, 1, 100) AS detail, lang FROM documents")
def _(t):
    docs = t.read("documents").select("doc_id", F.col("text").alias("title"), F.col("source").alias("detail"), "lang")
    return rp.truncate_columns(docs, {"title": 200, "detail": 100})


@register("compact_unit", """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN concat('Studies of ', c_mktsegment)
WHEN 2 THEN c_name ELSE concat(c_name, ', Department') END AS label FROM customer""")
def _(t):
    k = F.col("c_custkey") % 4
    label = (
        F.when(k == 0, F.concat("c_name", F.lit(", Department of"))).when(k == 1, F.concat(F.lit("Studies of "), "c_mktsegment", F.lit(", school OF")))
        .when(k == 2, F.concat("c_name", F.lit(", The"))).otherwise(F.concat("c_name", F.lit(", Department")))
    )
    return t.read("customer").select("c_custkey", compact_unit(label).alias("label"))


@register("anchor_keys", """SELECT DISTINCT unit_id, college, concat('U', CAST(unit_id AS STRING)) AS unit_key,
concat('C', substr(regexp_replace(concat(college, ' & "School" of ', c_mktsegment), '[^\\p{L}\\p{N}]', '_', 'g'), 1, 40)) AS college_key
FROM fx_home CROSS JOIN (SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment = 'FURNITURE') WHERE college IS NOT NULL""")
def _(t):
    name = F.concat(F.col("college"), F.lit(' & "School" of FURNITURE'))
    return t.affil.filter("NOT is_ext AND college IS NOT NULL").select(
        "unit_id", "college", unit_anchor_key(F.col("unit_id")).alias("unit_key"), college_anchor_key(name).alias("college_key")
    ).distinct()


@register("payload_filename", """SELECT p_partkey, concat(substr(trim(regexp_replace(k, '[^A-Za-z0-9]+', '_', 'g'), '_'), 1, 72), '_',
substr(sha1(k), 1, 8), '.json') AS file FROM (SELECT p_partkey, concat('|', p_name, '|U|', p_brand, ' / ', p_type, ' / ', p_type, '|', CAST(p_partkey AS STRING), '|') AS k FROM part)""")
def _(t):
    key = F.concat(F.lit("|"), "p_name", F.lit("|U|"), "p_brand", F.lit(" / "), "p_type", F.lit(" / "), "p_type", F.lit("|"),
                   F.col("p_partkey").cast("string"), F.lit("|"))
    return t.read("part").select("p_partkey", payload_filename(key).alias("file"))


DET_ANCHOR = """danch AS (
  SELECT concat('U', CAST(unit_id AS STRING)) AS anchor, * FROM fx_details
  UNION ALL SELECT concat('C', college), * FROM fx_details WHERE college IS NOT NULL)
"""


@register("anchor_payload", """SELECT anchor, wid, COUNT(*) AS n_rows, COUNT(DISTINCT pid) AS n_people, MAX(cpid) AS last_partner,
CAST(SUM(rel) AS BIGINT) AS rel_sum FROM danch GROUP BY anchor, wid""", ctes=DET_ANCHOR)
def _(t):
    rows = ex.both_sides_explode(ex.collab_pairs(t.member, keep_size=True, affil=t.affil), t.affil)
    # Rows of a work are at most its people squared times the places of a person on either side.
    places = t.affil.groupBy("pid").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    sized = rows.withColumn("bound", F.col("n_people") * F.col("n_people") * places**2)
    nested = rp.anchor_payload(sized, ["pid", "unit_label", "discipline", "cpid", "c_unit_label", "c_inst", "rel"], "bound")
    e = F.col("rows")
    flat = nested.select("anchor", "wid", F.explode("rows").alias("r")).select("anchor", "wid", "r.pid", "r.cpid", "r.rel")
    # People of a work are counted per person first, so no row holds them all.
    per_person = flat.groupBy("anchor", "wid", "pid").agg(F.count(F.lit(1)).alias("n"), F.max("cpid").alias("last"), F.sum("rel").alias("rels"))
    return per_person.groupBy("anchor", "wid").agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_people"), F.max("last").alias("last_partner"), F.sum("rels").alias("rel_sum"),
    )


@register("string_dictionary", """SELECT value, row_number() OVER (ORDER BY value) - 1 AS code FROM (
  SELECT DISTINCT value FROM (SELECT college AS value FROM fx_intl UNION ALL SELECT unit_label FROM fx_intl
    UNION ALL SELECT CAST(inst_id AS STRING) FROM fx_intl UNION ALL SELECT country FROM fx_intl UNION ALL SELECT sector FROM fx_intl)
  WHERE value IS NOT NULL)""")
def _(t):
    return rp.string_dictionary(t.intl, ["college", "unit_label", "inst_id", "country", "sector"])


@register("extract_anchor_rows", "SELECT wid, pid, cpid, c_unit_id, rel FROM fx_details WHERE unit_id = 3")
def _(t):
    own = rp.extract_anchor_rows(t.affil.filter("NOT is_ext"), 3)
    return ex.both_sides_explode(ex.pairs_of(t.member, own), t.affil, own).select("wid", "pid", "cpid", "c_unit_id", "rel")


@register("payload_stats", """SELECT a.anchor, a.n_rows, a.n_works, a.max_rows, b.n_people, ROUND(a.n_rows * 1.0 / a.n_works, 3) AS rows_per_work
FROM (SELECT anchor, CAST(SUM(n) AS BIGINT) AS n_rows, COUNT(*) AS n_works, MAX(n) AS max_rows FROM (
  SELECT anchor, wid, COUNT(*) AS n FROM danch GROUP BY anchor, wid) GROUP BY anchor) a
JOIN (SELECT anchor, COUNT(*) AS n_people FROM (SELECT anchor, pid FROM danch UNION SELECT anchor, cpid FROM danch) GROUP BY anchor) b
ON a.anchor = b.anchor""", ctes=DET_ANCHOR)
def _(t):
    return rp.payload_stats(details(t).select("wid", "pid", "cpid", "unit_id", "college"))


@register("work_index", """SELECT wid, row_number() OVER (ORDER BY wid) - 1 AS work_idx, CAST(CASE work_type WHEN 'Article' THEN 0
WHEN 'Conference Proceeding' THEN 1 WHEN 'Book' THEN 2 WHEN 'Book Chapter' THEN 3 WHEN 'Federal Grant' THEN 4 WHEN 'Patent' THEN 5
ELSE 6 END AS INT) AS type_idx FROM fx_work""")
def _(t):
    return rp.work_index(t.work)


def all_pairs(t):
    return c.pairs_long(c.work_cells(t.member, t.affil))


@register("export_nested_json", """SELECT k.unit_kind, k.level, k.id, k.label, COUNT(CASE WHEN category = 'within' THEN 1 END) AS n_within,
COUNT(CASE WHEN category = 'across' THEN 1 END) AS n_across, COUNT(CASE WHEN category = 'inter' THEN 1 END) AS n_inter,
CAST(COALESCE(SUM(pairs), 0) AS BIGINT) AS pairs, MIN(CASE WHEN category = 'within' THEN p.wid END) AS first_within
FROM (SELECT unit_kind, level, id, MIN(label) AS label FROM fx_key GROUP BY unit_kind, level, id) k
LEFT JOIN fx_pairs p ON k.unit_kind = p.unit_kind AND k.level = p.level AND k.id = p.id GROUP BY k.unit_kind, k.level, k.id, k.label""")
def _(t):
    # written once: the sizes of the parts and the parts themselves read it
    nested = rp.export_nested(wr.stored(all_pairs(t), "pairs"), entity_labels(t))
    path = shared_dir(t.spark, "nested-json")
    nested.write.mode("overwrite").json(path)
    back = rd.read_json_payload(t.spark, path, nested.schema)
    total = lambda col: F.aggregate(F.col(col), F.lit(0).cast("bigint"), lambda acc, x: acc + x["pairs"])
    return back.groupBy("unit_kind", "level", "id", "label").agg(
        F.sum(F.size("within")).alias("n_within"), F.sum(F.size("across")).alias("n_across"), F.sum(F.size("inter")).alias("n_inter"),
        F.sum(total("within") + total("across") + total("inter")).alias("pairs"),
        F.min(F.array_min(F.transform("within", lambda x: x["wid"]))).alias("first_within"),
    )


INTL_ANCHOR = """ianch AS (
  SELECT concat('U', CAST(unit_id AS STRING)) AS anchor, * FROM fx_intl
  UNION ALL SELECT concat('C', college), * FROM fx_intl WHERE college IS NOT NULL)
"""


FACT_ANCHOR = "fact AS (" + DETAILS_SQL + """), fanch AS (
  SELECT concat('U', UnitId) AS anchor, * FROM fact UNION ALL SELECT concat('C', College), * FROM fact WHERE College IS NOT NULL)
"""


def details_payload(t):
    return rp.self_contained_payload(stored(flat_fact(t), "fact"))


@register("explode_payload", """SELECT anchor, Relationship AS rel, CollaborationType AS type, COUNT(*) AS n_rows, COUNT(DISTINCT PersonName) AS names,
COUNT(DISTINCT Collab_PersonName) AS partners, MIN(Collab_Title) AS first_title, MAX(Collab_Detail) AS last_detail, CAST(SUM(Year) AS BIGINT) AS years,
MIN(Rank) AS first_rank, COUNT(DISTINCT concat(Collab_Department, Collab_UnitType, Collab_Institution)) AS partner_units
FROM fanch GROUP BY anchor, Relationship, CollaborationType""", ctes=FACT_ANCHOR)
def _(t):
    flat = rp.explode_payload(stored(details_payload(t), "payload"))
    return flat.groupBy("anchor", "rel", "type").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("name").alias("names"), F.count_distinct("c_name").alias("partners"), F.min("title").alias("first_title"),
        F.max("detail").alias("last_detail"), F.sum("year").alias("years"), F.min("rank").alias("first_rank"),
        F.count_distinct(F.concat("c_unit", "c_unit_type", "c_inst")).alias("partner_units"),
    )


@register("read_json_payload", """SELECT a.anchor, a.n_rows, a.works, b.people, b.first_name, b.last_name FROM (
  SELECT anchor, COUNT(*) AS n_rows, COUNT(DISTINCT Collab_ID) AS works FROM fanch GROUP BY anchor) a JOIN (
  SELECT anchor, COUNT(DISTINCT p) AS people, MIN(n) AS first_name, MAX(n) AS last_name FROM (
    SELECT anchor, PersonId AS p, PersonName AS n FROM fanch UNION SELECT anchor, Collab_PersonID, Collab_PersonName FROM fanch) GROUP BY anchor) b
ON a.anchor = b.anchor""", ctes=FACT_ANCHOR)
def _(t):
    """Written as JSON, one folder per anchor, and read back by schema: every part stands alone."""
    payload = details_payload(t)
    path = shared_dir(t.spark, "payload-json")
    wr.write_by(payload, path, "anchor", "json", compression="gzip")
    back = rd.read_json_payload(t.spark, path, payload.schema)
    lengths = F.aggregate(F.map_values("rows_by_work"), F.lit(0).cast("bigint"), lambda n, r: n + F.size(r))
    rows = back.select("anchor", lengths.alias("n"), F.map_keys("works").alias("w"))
    works = rows.select("anchor", F.explode("w").alias("wid")).groupBy("anchor").agg(F.count_distinct("wid").alias("works"))
    people = back.select("anchor", F.explode("people").alias("pid", "p")).groupBy("anchor").agg(
        F.count_distinct("pid").alias("people"), F.min("p.name").alias("first_name"), F.max("p.name").alias("last_name")
    )
    return rows.groupBy("anchor").agg(F.sum("n").alias("n_rows")).join(works, "anchor").join(people, "anchor")


@register("write_per_anchor", """SELECT n.anchor AS key, a.label, a.kind, a.unit_type, a.unit_id, concat('anchor=', n.anchor) AS file, n.n_rows FROM (
  SELECT anchor, COUNT(*) AS n_rows FROM ianch GROUP BY anchor) n JOIN (
  SELECT concat('U', CAST(unit_id AS STRING)) AS anchor, MIN(unit_label) AS label, 'unit' AS kind, MIN(unit_type) AS unit_type,
    CAST(unit_id AS STRING) AS unit_id FROM fx_home GROUP BY unit_id
  UNION ALL SELECT DISTINCT concat('C', college), college, 'college', NULL, NULL FROM fx_home WHERE college IS NOT NULL) a ON n.anchor = a.anchor""", ctes=INTL_ANCHOR)
def _(t):
    path = shared_dir(t.spark, "per-anchor")
    wr.write_by(rp.anchor_rows(t.intl).select("anchor", "wid", "pid", "inst_id", "country"), path, "anchor")
    return wr.anchor_index(t.spark.read.parquet(path), r.anchor_list(t.affil))


@register("write_long_csv", """SELECT 'work_meta' AS tbl, COUNT(*) AS n_rows, CAST(SUM(n_authors) AS BIGINT) AS total FROM fx_meta
UNION ALL SELECT 'entity_meta', COUNT(*), COUNT(*) FROM (SELECT DISTINCT unit_kind, level, id FROM fx_key)
UNION ALL SELECT 'entity_pairs', COUNT(*), CAST(SUM(pairs) AS BIGINT) FROM fx_pairs
UNION ALL SELECT 'person_meta', COUNT(*), COUNT(*) FROM (SELECT DISTINCT k.unit_kind, a.pid FROM fx_home a JOIN fx_kind k ON a.unit_type = k.unit_type)
UNION ALL SELECT 'person_disc', COUNT(*), COUNT(*) FROM (SELECT DISTINCT k.unit_kind, a.pid, a.discipline FROM fx_home a JOIN fx_kind k ON a.unit_type = k.unit_type)
UNION ALL SELECT 'person_pairs', COUNT(*), CAST(SUM(n) AS BIGINT) FROM (SELECT k.unit_kind, p.pid, p.wid, p.rel, COUNT(*) AS n FROM fx_minrel p
  JOIN (SELECT DISTINCT k.unit_kind, a.pid FROM fx_home a JOIN fx_kind k ON a.unit_type = k.unit_type) k ON p.pid = k.pid
  GROUP BY k.unit_kind, p.pid, p.wid, p.rel)""")
def _(t):
    from jointwork.model import kinds_of

    wc = c.person_work_counts(t.member, t.affil)
    union = lambda parts: reduce(lambda a, b: a.union(b), parts)
    tables = {
        "work_meta": (c.work_meta(t.member, t.affil, t.work_all), "n_authors"),
        "entity_meta": (entity_labels(t), None),
        "entity_pairs": (all_pairs(t), "pairs"),
        "person_meta": (union([c.person_meta(t.person, t.affil, k) for k in KINDS]), None),
        "person_disc": (t.affil.filter("NOT is_ext").select(F.explode(kinds_of(F.col("unit_type"))).alias("unit_kind"), "pid", "discipline").distinct(), None),
        "person_pairs": (union([c.person_pairs(wc, t.affil, k) for k in KINDS]), "pairs"),
    }
    root, out = shared_dir(t.spark, "long-csv"), []
    for name, (df, total) in tables.items():
        # Rows of the long tables repeat their keys: plain text would be many times the input.
        wr.write_csv(df, f"{root}/{name}", compression="gzip")
        back = rd.read_csv_positional(t.spark, f"{root}/{name}", df.schema)
        value = F.sum(total) if total else F.count(F.lit(1))
        out.append(back.agg(F.count(F.lit(1)).alias("n_rows"), value.cast("bigint").alias("total")).select(F.lit(name).alias("tbl"), "n_rows", "total"))
    return union(out)


@register("csv_download", """SELECT concat('"', CAST(pub_year AS STRING), '","', concat(label, ' ""', grp, '""'), '","', CAST(works AS STRING), '"') AS line FROM (
  SELECT pub_year, unit_label AS label, unit_type AS grp, COUNT(DISTINCT wid) AS works FROM fx_intl GROUP BY pub_year, unit_label, unit_type)
UNION ALL SELECT '"Year","Unit","works"'""")
def _(t):
    rows = t.intl.groupBy("pub_year", "unit_label", "unit_type").agg(F.count_distinct("wid").alias("works"))
    name = F.concat("unit_label", F.lit(' "'), "unit_type", F.lit('"'))
    path = shared_dir(t.spark, "download")
    # every part has the header line; readers keep one
    wr.write_download(rows.select(F.col("pub_year").alias("Year"), name.alias("Unit"), "works"), path)
    lines = t.spark.read.text(path).select(F.col("value").alias("line"))
    header = '"Year","Unit","works"'
    return lines.filter(F.col("line") != header).union(lines.filter(F.col("line") == header).distinct())


@register("read_details", """SELECT UnitId, Relationship, CollaborationType, Collab_UnitType, COUNT(*) AS n_rows, MIN(PersonName) AS first_name,
CAST(SUM(Year) AS BIGINT) AS years, MAX(Collab_State) AS last_state FROM (""" + DETAILS_SQL + """) GROUP BY ALL""")
def _(t):
    path = shared_dir(t.spark, "details-csv")
    # Rows of the fact repeat names and labels: plain text would be many times the input.
    wr.write_csv(flat_fact(t), path, "ISO-8859-1", "gzip")
    return rd.read_details(t.spark, path).groupBy("UnitId", "Relationship", "CollaborationType", "Collab_UnitType").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("PersonName").alias("first_name"), F.sum("Year").alias("years"), F.max("Collab_State").alias("last_state")
    )


# Rows of the pair files: within a unit one per pair, across units one per pair and partner unit.
PAIR_FILES = """pf AS (SELECT unit, rel, pid, partner_unit, cpid, COUNT(CASE WHEN work_type = 'Article' THEN 1 END) AS n_articles,
    COUNT(CASE WHEN work_type = 'Patent' THEN 1 END) AS n_patents, COUNT(*) AS works FROM (
    SELECT DISTINCT CAST(unit_id AS STRING) AS unit, rel, pid, CASE WHEN rel = 1 THEN CAST(c_unit_id AS STRING) END AS partner_unit, cpid, wid
    FROM fx_details WHERE rel IN (0, 1) AND unit_type IN ('Department', 'Medical', 'Clinical')) d JOIN fx_work w ON d.wid = w.wid
  GROUP BY unit, rel, pid, partner_unit, cpid)
"""


def pair_files(t):
    """Pair counts as one folder per view and unit, each view in its own layout, with long headers."""
    kinds = F.col("unit_type").isin(*KIND_UNIT_TYPES["Department"])
    rows = stored(n.pair_file_rows(details(t).filter(kinds), t.work_all, t.person), "pair-rows")
    path = shared_dir(t.spark, "pair-files")
    long = {"unit": "Unit", "scholar": "Unit Scholar", "pid": "Unit Scholar ID", "partner_unit": "Collab Unit", "partner": "Collab Scholar", "cpid": "Collab Scholar ID"}
    for rel, view, schema in ((0, "within", rd.PAIR_WITHIN_SCHEMA), (1, "across", rd.PAIR_ACROSS_SCHEMA)):
        out = rows.filter(F.col("rel") == rel).select(
            F.concat(F.lit("dept_"), "unit").alias("folder"), *[F.col(c).alias(long.get(c, f"Co Authored {c}")) for c in schema.names]
        )
        # The rows of a unit lie together as they were counted, so they are not shuffled once more for their folder.
        out.write.mode("overwrite").option("header", True).option("compression", "gzip").partitionBy("folder").csv(f"{path}/view={view}")
    return path


def read_back_pairs(t):
    return rd.read_pair_files(t.spark, pair_files(t), r"folder=[^/]*_([^/_]+)/")


@register("read_csv_positional", """SELECT unit, COUNT(*) AS n_rows, CAST(SUM(n_articles) AS BIGINT) AS n_articles, CAST(SUM(n_patents) AS BIGINT) AS n_patents,
MIN(p.pname) AS first_partner FROM pf JOIN fx_person p ON cpid = p.pid GROUP BY unit""", ctes=PAIR_FILES)
def _(t):
    path = pair_files(t)
    within = rd.read_csv_positional(t.spark, f"{path}/view=within/*/*.csv*", rd.PAIR_WITHIN_SCHEMA)
    across = rd.read_csv_positional(t.spark, f"{path}/view=across/*/*.csv*", rd.PAIR_ACROSS_SCHEMA)
    return within.unionByName(across, allowMissingColumns=True).groupBy("unit").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("n_articles").alias("n_articles"), F.sum("n_patents").alias("n_patents"), F.min("partner").alias("first_partner")
    )


@register("read_folders_union", """SELECT unit AS folder_unit, CASE rel WHEN 0 THEN 'within' ELSE 'across' END AS folder_scope, COUNT(*) AS n_rows,
CAST(SUM(n_articles) AS BIGINT) AS n_articles, COUNT(DISTINCT partner_unit) AS partner_units FROM pf GROUP BY unit, rel""", ctes=PAIR_FILES)
def _(t):
    return read_back_pairs(t).groupBy("folder_unit", "folder_scope").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("n_articles").alias("n_articles"), F.count_distinct("partner_unit").alias("partner_units")
    )


@register("reconcile_summary", """SELECT unit AS unit_id, CASE rel WHEN 0 THEN 'Within Unit' ELSE 'Across Units' END AS scope, COUNT(*) AS checked,
CAST(0 AS BIGINT) AS mismatched, CAST(0 AS BIGINT) AS missing_in_a, CAST(0 AS BIGINT) AS missing_in_b
FROM (SELECT DISTINCT unit, rel, pid, cpid FROM pf) GROUP BY unit, rel""", ctes=PAIR_FILES)
def _(t):
    """Pair counts from edges against the pair files, which come from detail rows and are read back in both layouts."""
    works = sum((F.col(x) for x in TYPE_COLUMNS.values()), F.lit(0)).cast("bigint").alias("works")
    key = ["unit_id", "scope", "pid", "cpid"]
    ours = pair_counts(t).select(*key, works)
    scope = F.when(F.col("folder_scope") == "within", "Within Unit").otherwise("Across Units")
    theirs = read_back_pairs(t).select(F.col("unit").alias("unit_id"), scope.alias("scope"), "pid", "cpid", works)
    # A pair has a row per partner unit, each with all its works.
    return q.reconcile_summary(q.reconcile(ours, theirs.groupBy(*key).agg(F.max("works").alias("works")), key, ["works"]), ["unit_id", "scope"])


@register("read_parquet_projected", "SELECT o_orderkey, o_orderdate FROM orders")
def _(t):
    return rd.read_parquet_projected(t.spark, f"{t.sf_dir}/orders.parquet", ["o_orderkey", "o_orderdate"])
