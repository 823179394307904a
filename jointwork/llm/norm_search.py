"""Exact top-k by inner product: buckets of similar length, pruned by local cosine thresholds.

A component x becomes the integer floor(scale * x).  Vectors are grouped by
length into classes (each ``RATIO`` times longer than the one before), and a
class with many rows into blocks by hash; queries are cut into blocks as well.
A first pass over the longest blocks gives each query a score that k vectors
are known to reach.  Against the longest vector of a class this score asks for
a cosine: above 1 the query never meets the class; at ``COORDINATES`` or more
the query's strongest coordinates bound each product from above (their part
is exact, the rest by the lengths that are left); below it, only vectors too
short for the score are passed over.  Products of the others are computed in
full, so nothing that could be a result is lost.

Queries and vectors meet in cells of one block each (cogrouped), so a task
holds ``ROWS`` vectors and ``QUERIES`` queries whatever the data; a cell gives
k rows a query at most, and only those that reach the query's score.

Vectors that are null, or hold null, NaN or infinite components, take no part;
nor do vectors whose squared length is 2**62 or more, as their products need
not fit a long.  Only vectors with the same number of components meet.  The
row of the query itself is no result; other rows with its id are.  Of equal
scores the smaller id comes first, rows without id last; equal rows are
several results.  Fewer than k vectors give as many results as there are, an
empty table none.  Other columns are ignored.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from jointwork.llm.registry import register, table
from jointwork.llm.text_columns import small
from jointwork.sources.writers import stored

SCALE, K = 256, 5
RATIO = 1.1
ROWS, QUERIES = 4096, 1024
FIRST_ROWS = 8192
COORDINATES = 0.5
STRONGEST = 12
SMALL_ROWS = 100_000
#: Products below this are exact in doubles.
EXACT = float(1 << 53)
FOUND = "query_row long, query_id long, vec_id long, score long"


def integer_vectors(vectors: DataFrame, ident: str, column: str, scale: int) -> DataFrame:
    """(row, id, q, dim, norm, class): one row per vector that takes part; ``row`` tells equal rows apart."""
    x = F.col(column)
    finite = F.forall(x, lambda v: F.coalesce(F.abs(v.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(v.cast("double")))
    norm = F.sqrt(F.aggregate("q", F.lit(0.0), lambda total, v: total + v.cast("double") * v.cast("double")))
    return (
        vectors.filter(F.coalesce(finite, F.lit(False)))
        .select(F.col(ident).cast("long").alias("id"), F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double"))).alias("q"))
        .withColumn("norm", norm).filter(F.col("norm") < float(1 << 31))
        .select(
            F.monotonically_increasing_id().alias("row"), "id", "q", F.size("q").alias("dim"), "norm",
            F.floor(F.log(F.greatest(F.col("norm"), F.lit(1.0))) / float(np.log(RATIO))).cast("int").alias("class"),
        )
    )


def _block(n: Column, rows: int) -> Column:
    """Which of the blocks of about ``rows`` rows a row of a group of ``n`` belongs to."""
    return F.pmod(F.xxhash64("row"), _blocks(n, rows)).cast("int")


def _blocks(n: Column, rows: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / F.lit(float(rows)))).cast("int")


def _matrix(t: pa.Table) -> np.ndarray:
    values = t["q"].combine_chunks()
    values = values.chunk(0) if isinstance(values, pa.ChunkedArray) else values
    return np.asarray(values.flatten(), dtype=np.int64).reshape(t.num_rows, -1)


def _top(scores: np.ndarray, ids: np.ndarray, absent: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores >= least)
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((ids[places], absent[places], -scores[places]))][:k]


def _cell(queries: pa.Table, vectors: pa.Table, k: int) -> pa.Table:
    """Results of a block of queries in a block of vectors that reach the queries' scores."""
    out: list[tuple[np.ndarray, ...]] = []
    if queries.num_rows and vectors.num_rows:
        norms = np.asarray(vectors["norm"])
        order = np.argsort(-norms, kind="stable")  # the longest first: those too short for a score are the end
        p, norms = _matrix(vectors)[order], norms[order]
        rows = np.asarray(vectors["row"])[order]
        absent = np.asarray(vectors["id"].is_null())[order]
        ids = np.asarray(vectors["id"].fill_null(0))[order]
        q, lengths = _matrix(queries), np.asarray(queries["norm"])
        least = np.asarray(queries["least"].cast(pa.float64()).fill_null(-np.inf))
        exact = float(lengths.max()) * float(norms[0]) < EXACT
        kind = np.float64 if exact else np.int64
        p, q = p.astype(kind), q.astype(kind)
        squares = norms * norms
        for i, (mine, own) in enumerate(zip(np.asarray(queries["row"]), q)):
            slack = 0.5 + 1e-9 * lengths[i] * norms[0]
            if least[i] > 0 and least[i] - slack > lengths[i] * norms[0]:
                continue
            upto = len(norms) if least[i] <= 0 else int(np.searchsorted(-norms * lengths[i], -(least[i] - slack), "right"))
            cosine = least[i] / max(lengths[i] * norms[0], 1.0)
            some = slice(0, upto)
            if cosine >= COORDINATES and q.shape[1] > STRONGEST:
                strong = np.argpartition(-np.abs(own), STRONGEST)[:STRONGEST]
                part = p[:upto][:, strong].astype(np.float64)
                rest = np.sqrt(np.maximum(lengths[i] ** 2 - float((own[strong].astype(np.float64) ** 2).sum()), 0) * np.maximum(squares[:upto] - (part * part).sum(1), 0))
                some = np.flatnonzero(part @ own[strong].astype(np.float64) + rest >= least[i] - slack)
            scores = p[some] @ own
            good = np.flatnonzero((scores >= least[i]) & (rows[some] != mine))
            if len(good):
                scores = scores[good].astype(np.int64)
                best = _top(scores, ids[some][good], absent[some][good], k)
                out.append((np.full(len(best), i), np.arange(len(norms))[some][good][best], scores[best]))
    which, where, scores = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.int64))
    found = pa.array(ids[where], mask=absent[where]) if out else pa.array([], pa.int64())
    return pa.table({
        "query_row": queries["row"].take(which), "query_id": queries["id"].take(which), "vec_id": found, "score": pa.array(scores, pa.int64()),
    })


def _met(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    cell = ["dim", "class", "block", "query_block"]

    def work(key, a: pa.Table, b: pa.Table) -> pa.Table:
        return _cell(a, b, k)

    return queries.groupBy(*cell).cogroup(vectors.groupBy(*cell)).applyInArrow(work, FOUND)


def top_products(vectors: DataFrame, queries: Column, k: int = K, ident: str = "vec_id", column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """The k vectors with the largest products for each row where ``queries`` (on the column ``id``) holds: query_id, rank, vec_id, score."""
    every = stored(integer_vectors(vectors, ident, column, scale), "integer-vectors")
    asked = stored(every.filter(queries), "queries")
    # One row per number of components and class of length: a few hundred, whatever the number of vectors.
    down = Window.partitionBy("dim").orderBy(F.desc("class"))
    classes = stored(
        every.groupBy("dim", "class").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("longest"))
        .withColumn("blocks", _blocks(F.col("n"), ROWS))
        .withColumn("_before", F.coalesce(F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("first", F.when(F.col("_before") < FIRST_ROWS, F.least("blocks", F.ceil((FIRST_ROWS - F.col("_before")) / F.lit(float(ROWS))))).otherwise(0).cast("int"))
        .drop("_before"), "length-classes",
    )
    groups = stored(asked.groupBy("dim").agg(F.count(F.lit(1)).alias("n_queries")), "query-groups")
    placed = (
        every.join(small(classes, SMALL_ROWS), ["dim", "class"]).withColumn("block", _block(F.col("n"), ROWS))
        .join(small(groups, SMALL_ROWS), "dim")
        .withColumn("query_block", F.explode(F.sequence(F.lit(0), _blocks(F.col("n_queries"), QUERIES) - 1)))
    )
    mine = asked.join(small(groups, SMALL_ROWS), "dim").withColumn("query_block", _block(F.col("n_queries"), QUERIES)).select("row", "id", "q", "norm", "dim", "query_block")

    def side(frame: DataFrame, chosen: DataFrame, upto: str) -> DataFrame:
        """Each query once for every block that it has to meet."""
        return (
            frame.join(small(chosen, SMALL_ROWS), "dim")
            .filter((F.col(upto) > 0) & (F.col("least").isNull() | (F.col("least") <= 0) | (F.col("norm") * F.col("longest") * (1 + 1e-9) >= F.col("least") - 0.5)))
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.col(upto) - 1)))
            .select("row", "id", "q", "norm", "least", "dim", "class", "block", "query_block")
        )

    columns = ["row", "id", "q", "norm", "dim", "class", "block", "query_block"]
    start = _met(side(mine.withColumn("least", F.lit(None).cast("long")), classes, "first"), placed.filter(F.col("block") < F.col("first")).select(*columns), k)
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    least = stored(
        start.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == k).select(F.col("query_row").alias("row"), F.col("score").alias("least")), "least-scores",
    )
    met = _met(side(mine.join(least, "row", "left"), classes, "blocks"), placed.select(*columns), k)
    return met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding))
SELECT query_id, rank, vec_id, score FROM (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score,
    CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY CAST(list_inner_product(a.q, b.q) AS BIGINT) DESC, b.vec_id) AS INTEGER) AS rank
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0) WHERE rank <= {K}"""


@register("op12_norm_search", SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)
