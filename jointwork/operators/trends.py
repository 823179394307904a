"""International partners by country, sector, unit and year.

Distinct works and institutions are counted after the any-row filters; every
``count_distinct`` shuffles on (group, value) first, so a country with a third
of all rows is still counted by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from jointwork.functions.expressions import top_k
from jointwork.functions.text import college_anchor, unit_anchor_key


def country_works_scholars(intl: DataFrame) -> DataFrame:
    return intl.groupBy("country").agg(F.count_distinct("wid").alias("works"), F.count_distinct("pid").alias("scholars"))


def country_year(intl: DataFrame, years: list[int] | None = None) -> DataFrame:
    """Country by year matrix over the years that occur (one number per year comes to the driver), or over given ones."""
    if years is None:
        years = sorted(r[0] for r in intl.filter("pub_year is not null").select("pub_year").distinct().collect())
    cells = intl.select("country", "pub_year", "wid").distinct()
    return cells.groupBy("country").agg(
        *[F.sum(F.when(F.col("pub_year") == y, 1).otherwise(0)).cast("bigint").alias(f"y{y}") for y in years]
    )


def country_year_long(intl: DataFrame) -> DataFrame:
    """Same numbers in long form, zero-filled over the years that occur.

    Every country row receives the one-row year list and unfolds it, so the
    spine is as long as the matrix itself.
    """
    cells = intl.groupBy("country", "pub_year").agg(F.count_distinct("wid").alias("works"))
    years = intl.select("pub_year").distinct().agg(F.sort_array(F.collect_set("pub_year")).alias("years"))
    spine = (
        intl.select("country").distinct().withColumn("one", F.lit(1))
        .join(F.broadcast(years.withColumn("one", F.lit(1))), "one")
        .select("country", F.explode("years").alias("pub_year"))
    )
    return spine.join(cells, ["country", "pub_year"], "left").na.fill(0, ["works"])


def sector_type(sector: Column, academic: str) -> Column:
    """Academic only on an exact match; a missing sector is non-academic."""
    return F.when(F.coalesce(sector == academic, F.lit(False)), "Academic").otherwise("Non-Academic")


def partner_type(intl: DataFrame) -> DataFrame:
    return intl.groupBy("partner_type").agg(
        F.count_distinct("wid").alias("works"), F.count_distinct("inst_id").alias("institutions")
    )


def top_sectors(intl: DataFrame, n: int = 12) -> DataFrame:
    rows = intl.filter("partner_type = 'Non-Academic' AND sector IS NOT NULL")
    return top_k(rows.groupBy("sector").agg(F.count_distinct("wid").alias("works")), n, [F.desc("works"), F.asc("sector")])


def top_nonacademic(intl: DataFrame, n: int = 15) -> DataFrame:
    rows = intl.filter("partner_type = 'Non-Academic'")
    agg = rows.groupBy("inst_id").agg(F.count_distinct("wid").alias("works"), F.min("country").alias("country"))
    return top_k(agg, n, [F.desc("works"), F.asc("inst_id")])


def dept_intl(intl: DataFrame, n_countries: int = 6) -> DataFrame:
    """Works, partners and countries per department with its top countries."""
    rows = intl.filter("unit_type = 'Department' AND unit_label IS NOT NULL")
    totals = rows.groupBy("unit_label").agg(
        F.count_distinct("wid").alias("works"),
        F.count_distinct("inst_id").alias("partners"),
        F.count_distinct("country").alias("countries"),
    )
    ranked = top_k(
        rows.groupBy("unit_label", "country").agg(F.count_distinct("wid").alias("n")),
        n_countries, [F.desc("n"), F.asc("country")], ["unit_label"],
    )
    best = ranked.groupBy("unit_label").agg(F.sort_array(F.collect_list(F.struct("rnk", "country", "n"))).alias("best"))
    return totals.join(best, "unit_label").select(
        "unit_label", "works", "partners", "countries",
        F.array_join(F.transform("best", lambda b: F.concat(b["country"], F.lit(":"), b["n"].cast("string"))), ",").alias(
            "top_countries"
        ),
    )


def year_totals(intl: DataFrame) -> DataFrame:
    return intl.filter("pub_year IS NOT NULL").groupBy("pub_year").agg(F.count_distinct("wid").alias("works"))


def by_anchor(intl: DataFrame) -> DataFrame:
    """Each row once for its unit and once for its college, if it has one."""
    keys = F.filter(
        F.array(
            F.struct(unit_anchor_key(F.col("unit_id")).alias("anchor"), F.col("unit_label").alias("label"),
                     F.col("unit_type").alias("group")),
            F.when(
                F.col("college").isNotNull() & ~F.col("college").isin("NULL", ""),
                F.struct(college_anchor(F.col("college")).alias("anchor"), F.col("college").alias("label"),
                         F.lit("college").alias("group")),
            ),
        ),
        lambda s: s.isNotNull(),
    )
    return intl.withColumn("_a", F.explode(keys)).select("*", "_a.anchor", "_a.label", "_a.group").drop("_a")


def trend_series(rows: DataFrame) -> DataFrame:
    """Works, institutions and rows per anchor and year.

    ``rows`` are already filtered: a work counts when one of its rows
    qualifies, institutions only on qualifying rows.
    """
    return by_anchor(rows).filter("pub_year IS NOT NULL").groupBy("anchor", "pub_year").agg(
        F.count_distinct("wid").alias("works"), F.count_distinct("inst_id").alias("insts"), F.count(F.lit(1)).alias("n_rows")
    )


def trend_table(series: DataFrame, anchors: list[str], metric: str = "works") -> DataFrame:
    """Year rows, one column per chosen anchor, zero where it has no works."""
    kept = series.filter(F.col("anchor").isin(*anchors))
    return kept.groupBy("pub_year").agg(
        *[F.sum(F.when(F.col("anchor") == a, F.col(metric)).otherwise(0)).cast("bigint").alias(a) for a in anchors]
    )


def country_options(intl: DataFrame, anchors: list[str]) -> DataFrame:
    return by_anchor(intl).filter(F.col("anchor").isin(*anchors) & (F.col("country") != "")).select("country").distinct()


def anchor_group_list(intl: DataFrame) -> DataFrame:
    """Anchors by group, colleges first, alphabetical inside a group."""
    order = (
        F.when(F.col("group") == "college", 1).when(F.col("group") == "Department", 2)
        .when(F.col("group") == "Program", 3).otherwise(4)
    )
    return by_anchor(intl).select("group", "anchor", "label").distinct().withColumn("group_no", order).orderBy(
        "group_no", "label", "anchor"
    )


def anchor_skew_profile(intl: DataFrame) -> DataFrame:
    """Rows per anchor and their share, biggest first."""
    sizes = by_anchor(intl).groupBy("anchor").agg(F.count(F.lit(1)).alias("n_rows"))
    total = sizes.agg(F.sum("n_rows").alias("total")).withColumn("one", F.lit(1))
    return (
        sizes.withColumn("one", F.lit(1)).join(F.broadcast(total), "one")
        .select("anchor", "n_rows", F.round(F.col("n_rows") * 100.0 / F.col("total"), 2).alias("share_pct"))
        .orderBy(F.desc("n_rows"), "anchor")
    )


def dup_factor(rows: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Rows per key: average and maximum duplication inside each group."""
    n = rows.groupBy(by, *keys).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(by).agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"), F.round(F.avg("n"), 4).alias("avg_dup"),
        F.max("n").alias("max_dup"),
    )


# Approximate geographic centre (latitude, longitude) per state.
STATE_CENTROIDS = {
    "Alabama": (32.799, -86.829), "Alaska": (61.385, -152.267), "Arizona": (33.729, -111.431),
    "Arkansas": (34.969, -92.373), "California": (36.117, -119.682), "Colorado": (39.059, -105.311),
    "Connecticut": (41.598, -72.755), "Delaware": (39.319, -75.507),
    "Florida": (27.766, -81.686), "Georgia": (33.041, -83.643), "Hawaii": (21.095, -157.499),
    "Idaho": (44.240, -114.479), "Illinois": (40.350, -88.986), "Indiana": (39.850, -86.258),
    "Iowa": (42.011, -93.210), "Kansas": (38.526, -96.726), "Kentucky": (37.669, -84.670),
    "Louisiana": (31.169, -91.868), "Maine": (44.694, -69.382), "Maryland": (39.064, -76.802),
    "Massachusetts": (42.230, -71.530), "Michigan": (43.327, -84.536), "Minnesota": (45.694, -93.900),
    "Mississippi": (32.742, -89.665), "Missouri": (38.457, -92.289), "Montana": (46.922, -110.454),
    "Nebraska": (41.125, -98.269), "Nevada": (38.313, -117.055), "New Hampshire": (43.452, -71.564),
    "New Jersey": (40.298, -74.521), "New Mexico": (34.840, -106.249), "New York": (42.166, -74.949),
    "North Carolina": (35.630, -79.806), "North Dakota": (47.528, -99.784), "Ohio": (40.388, -82.765),
    "Oklahoma": (35.565, -96.928), "Oregon": (44.572, -122.071), "Pennsylvania": (40.590, -77.210),
    "Rhode Island": (41.680, -71.512), "South Carolina": (33.856, -80.945), "South Dakota": (44.299, -99.438),
    "Tennessee": (35.747, -86.692), "Texas": (31.054, -97.563), "Utah": (40.150, -111.862),
    "Vermont": (44.045, -72.710), "Virginia": (37.769, -78.170), "Washington": (47.400, -121.490),
    "West Virginia": (38.491, -80.954), "Wisconsin": (44.268, -89.616), "Wyoming": (42.756, -107.302),
    "District of Columbia": (38.907, -77.037),
}
EARTH_RADIUS_KM = 6371.0


def nearest_state(points: DataFrame, centroids: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Nearest centroid by great-circle distance.

    The list is fixed and short, so it is an array literal in the projection:
    one narrow pass over the points, no join.
    """
    centroids = centroids or STATE_CENTROIDS
    items = F.array(
        *[F.struct(F.lit(s).alias("state"), F.lit(a).alias("lat"), F.lit(b).alias("lon")) for s, (a, b) in centroids.items()]
    )

    def km(c: Column) -> Column:
        half_lat = F.radians(c["lat"] - F.col("lat")) / 2
        half_lon = F.radians(c["lon"] - F.col("lon")) / 2
        h = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(F.col("lat"))) * F.cos(F.radians(c["lat"])) * F.sin(
            half_lon
        ) * F.sin(half_lon)
        return F.asin(F.sqrt(h)) * (2 * EARTH_RADIUS_KM)

    best = F.array_min(F.transform(items, lambda c: F.struct(km(c).alias("km"), c["state"].alias("state"))))
    return points.withColumn("_b", best).select(
        *points.columns, F.col("_b.state").alias("state"), F.round("_b.km", 1).alias("km")
    )
