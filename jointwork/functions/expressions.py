"""Small column builders.  No Python UDFs: everything stays in codegen."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from jointwork.model import RANK_CODES


def choose2(n: Column) -> Column:
    """Unordered pairs among n people, in integers."""
    return F.floor(n * (n - 1) / 2).cast("bigint")


def flag_sum(condition: Column) -> Column:
    """Count rows where the condition holds; nulls count as no."""
    return F.sum(F.when(condition, 1).otherwise(0)).cast("bigint")


def per_type_sums(types: dict[str, str], value: Column, type_col: str = "work_type") -> list[Column]:
    """One conditional sum per work type, under a fixed column list."""
    return [
        F.sum(F.when(F.col(type_col) == t, value).otherwise(0)).cast("bigint").alias(name)
        for t, name in types.items()
    ]


def rounded_ratio(part: Column, whole: Column, scale: int, digits: int) -> Column:
    """scale * part / whole, rounded half up in integers.

    Integer arithmetic gives the same digit on every engine; rounding a
    binary fraction would not.  Null where the denominator is null or zero.
    """
    unit = 10**digits
    part, whole = part.cast("bigint"), whole.cast("bigint")
    num, den = part * (2 * scale * unit) + whole, whole * 2
    return F.when(whole > 0, ((num - num % den) / den) / F.lit(float(unit)))


def pct(part: Column, whole: Column, digits: int = 1) -> Column:
    return rounded_ratio(part, whole, 100, digits)


def ratio(part: Column, whole: Column, digits: int = 2) -> Column:
    return rounded_ratio(part, whole, 1, digits)


def joined_set(col: Column | str, sep: str = "|") -> Column:
    """Distinct values of a short multi-valued attribute in one sorted cell."""
    return F.array_join(F.sort_array(F.collect_set(col)), sep)


def split_pipe(cell: Column, sep: str = r"\|") -> Column:
    """Split a multi-value cell, trim the parts and drop the blank ones."""
    parts = F.transform(F.split(F.coalesce(cell, F.lit("")), sep), lambda p: F.trim(p))
    return F.filter(parts, lambda p: p != "")


def rank_label(code: Column) -> Column:
    """Numeric rank code to its label."""
    out = None
    for value, name in RANK_CODES.items():
        out = F.when(code == value, name) if out is None else out.when(code == value, name)
    return out.otherwise("Other")


def rank_bucket(rank: Column) -> Column:
    """Free-text rank to one of four reporting buckets."""
    r = F.trim(F.coalesce(rank, F.lit("")))
    return (
        F.when(r == "Professor", "Professor")
        .when(r.startswith("Associate"), "Associate Professor")
        .when(r.startswith("Assistant"), "Assistant Professor")
        .otherwise("Other ranks")
    )


def top_k(
    df: DataFrame,
    k: int,
    order: Iterable[Column],
    by: Iterable[str] = (),
    rank_col: str = "rnk",
) -> DataFrame:
    """First k rows per group under a total order.

    ``row_number() <= k`` lets Spark prune each map task to k rows per group
    before the shuffle, so a hot group never reaches one task whole.  Without
    a group the first k rows are taken by ``orderBy().limit()`` (a per-task
    heap) and only those k rows are numbered.
    """
    order = list(order)
    by = list(by)
    if by:
        w = Window.partitionBy(*by).orderBy(*order)
        return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)
    w = Window.partitionBy(F.lit(0)).orderBy(*order)
    return df.orderBy(*order).limit(k).withColumn(rank_col, F.row_number().over(w))
