"""Centroid clustering of integer vectors by JVM expressions alone.

A component x becomes the integer floor(scale * x).  The centroids are literal
arrays in the plan: ``zip_with`` and ``aggregate`` give the squared distance of
a vector to each of them, ``array_min`` over structs of (distance, number)
chooses the cluster, and one aggregation per round sums every component as a
column of its own, so it runs in generated code and only one row per task and
cluster is shuffled.  The driver sees one row per cluster and round: k * dim
sums, whatever the number of vectors.

Kept are vectors of exactly ``dim`` components, none of them null, NaN or
infinite.  Vectors with a component of 2**27 or more (scaled, either sign)
are left out as well, as their squared distances need not fit a long.  A kept
row without id is clustered but never starts a centroid; repeated rows are
vectors of their own.  With fewer kept vectors than ``k`` there are as many
centroids as vectors, and an empty table gives no rows.  Other columns, if
named like ours too, are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from jointwork.llm.registry import register, table
from jointwork.llm.text_columns import literal_array
from jointwork.sources.writers import stored

SCALE, DIM, K, ROUNDS, SEED = 64, 64, 16, 3, "1"
LIMIT = 1 << 27


def integers(vectors: DataFrame, ident: str, column: str, scale: int, dim: int) -> DataFrame:
    """(id, q) of the vectors that are kept; q holds ints."""
    x = F.col(column)
    whole = (F.size(x) == dim) & F.forall(x, lambda v: F.coalesce(F.abs(v.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(v.cast("double")))
    fits = F.forall(F.col("q"), lambda v: F.abs(v) < LIMIT)
    scaled = vectors.filter(F.coalesce(whole, F.lit(False))).select(
        F.col(ident).alias("id"), F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double"))).alias("q")
    )
    return scaled.filter(fits).select("id", F.col("q").cast("array<int>").alias("q"))


def nearest(q: Column, centroids: list[list[int]]) -> Column:
    """Struct (distance, cluster) of the nearest centroid; of equally near ones the smallest number."""
    def distance(centre: Column) -> Column:
        return F.aggregate(F.zip_with(q, centre, lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"), lambda total, d: total + d)

    # Literal arrays, folded into one constant; the lambda is planned once, not once per centroid.
    held = F.array(*[literal_array(c) for c in centroids])
    return F.array_min(F.transform(held, lambda centre, i: F.struct(distance(centre).alias("distance"), i.alias("cluster"))))


def first_centroids(vectors: DataFrame, k: int, seed: str) -> list[list[int]]:
    """The k vectors with the smallest hash of seed and id; of rows with one id the smaller vector first."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    return [list(r["q"]) for r in vectors.filter("id is not null").select("q", order.alias("h")).orderBy("h", "q").limit(k).collect()]


def moved(vectors: DataFrame, centroids: list[list[int]], dim: int) -> list[list[int]]:
    """Each centroid replaced by the floored mean of its vectors, if it has any."""
    near = vectors.select("q", nearest(F.col("q"), centroids)["cluster"].alias("cluster"))
    parts = near.selectExpr("cluster", *[f"get(q, {i}) AS x{i}" for i in range(dim)])
    rows = parts.groupBy("cluster").agg(F.expr("count(1) AS n"), *[F.expr(f"sum(x{i}) AS x{i}") for i in range(dim)]).collect()
    new = list(centroids)
    for r in rows:
        new[r["cluster"]] = [r[f"x{i}"] // r["n"] for i in range(dim)]
    return new


def cluster(
    vectors: DataFrame, ident: str = "vec_id", column: str = "embedding", scale: int = SCALE, dim: int = DIM, k: int = K, rounds: int = ROUNDS, seed: str = SEED,
) -> tuple[DataFrame, list[list[int]]]:
    """(id, cluster, distance) of every kept vector, and the final centroids."""
    kept = stored(integers(vectors, ident, column, scale, dim), "integer-vectors")
    centroids = first_centroids(kept, k, seed)
    if not centroids:
        near = F.struct(F.lit(0).cast("long").alias("distance"), F.lit(0).alias("cluster"))
        return kept.filter("id is not null").select("id", near.alias("near")).select("id", "near.cluster", "near.distance"), []
    for _ in range(rounds):
        centroids = moved(kept, centroids, dim)
    return stored(kept.select("id", nearest(F.col("q"), centroids).alias("near")).select("id", "near.cluster", "near.distance"), "clusters"), centroids


def with_inertia(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``assigned`` with the summed distance of the row's cluster and of all, and the hash of its centroid.

    The sums are one row per cluster; they return as literal arrays.
    """
    if not centroids:
        sums, hashes = [0], [""]
    else:
        found = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
        sums = [found.get(i, 0) for i in range(len(centroids))]
        hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return assigned.select(
        "id", "cluster", "distance", F.get(literal_array(sums), F.col("cluster")).alias("cluster_inertia"),
        F.lit(sum(sums)).cast("long").alias("inertia"), F.get(F.split(F.lit(",".join(hashes)), ","), F.col("cluster")).alias("centroid_sha256"),
    )


def _sql() -> str:
    ctes = [f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM})""",
            f"""c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS c, q AS m
  FROM (SELECT sha256('{SEED}:' || CAST(vec_id AS VARCHAR)) AS h, q FROM v ORDER BY h LIMIT {K}))"""]
    for r in range(ROUNDS + 1):
        ctes.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, q, min({{'d': d, 'c': c}}) AS near FROM (
  SELECT v.vec_id, v.q, c, CAST(list_sum(list_transform(list_zip(v.q, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v CROSS JOIN c{r})
  GROUP BY vec_id, q)""")
        if r < ROUNDS:
            ctes.append(f"""c{r + 1} AS MATERIALIZED (SELECT k.c, coalesce(n.m, k.m) AS m FROM c{r} k LEFT JOIN (
  SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM (
    SELECT near.c AS c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (
      SELECT near, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM a{r}) GROUP BY near.c, i) GROUP BY c) n ON k.c = n.c)""")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT vec_id, near.c AS cluster, near.d AS distance, CAST(sum(near.d) OVER (PARTITION BY near.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(near.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} k ON near.c = k.c"""


@register("op11_centroid_clustering", _sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_inertia(*cluster(table(spark, sf_dir, "embeddings"))).withColumnRenamed("id", "vec_id")
