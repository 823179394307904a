"""Exact distinct works for any combination of filters, without a rescan.

Works are numbered densely in the order of type, year and author class, so a
bitmap bucket (32,768 numbers) holds works of one combination almost always
and the number of bitmaps grows with keys times works, not with keys times
combinations.  A row holds the works of a key and category in one bucket.
Any union of categories, types, years, author caps or keys is an OR of rows;
its count is exact, however the parts overlap.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from jointwork.operators.counts import CATEGORIES, work_flags
from jointwork.operators.skew import by_work, dense_index

CAPS = (20, 50, 100)
KEY = ("unit_kind", "level", "id")
FACETS = ("work_type", "pub_year", "cap")


def author_class(n_people: Column) -> Column:
    """The smallest author cap that a work passes; null if it passes none."""
    out = F.lit(None).cast("int")
    for cap in reversed(CAPS):
        out = F.when(n_people <= cap, cap).otherwise(out)
    return out


def numbered_works(member: DataFrame, work: DataFrame) -> DataFrame:
    """(wid, work_type, pub_year, cap, number) of every work of the universe; the number is its place in all bitmaps."""
    sizes = member.groupBy("wid").agg(author_class(F.max("n_people")).alias("cap"))
    rows = sizes.join(by_work(work.select("wid", "work_type", "pub_year")), "wid", "left")
    return dense_index(rows, [*FACETS, "wid"], "number")


def work_bitmaps(cells: DataFrame, works: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Bitmaps of the works of each key and category, by type, year and author class.

    A key with very many works is summed in the map tasks, bucket by bucket.
    """
    met = F.array_compact(F.array(*[F.when(flag, F.lit(name)) for name, flag in work_flags().items()]))
    rows = cells.select(*key, "wid", F.explode(met).alias("category")).join(by_work(works), "wid")
    return rows.groupBy(*key, "category", *FACETS, F.bitmap_bucket_number("number").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("works")
    )


def chosen(categories: Iterable[str] = CATEGORIES, types: Iterable[str] | None = None, years: tuple[int, int] | None = None, cap: int | None = None) -> Column:
    """Condition on bitmap rows; the parts that are not given let everything pass, unknown types, years and sizes too."""
    if cap is not None and cap not in CAPS:
        raise ValueError(f"the bitmaps hold the author caps {CAPS}")
    out = F.col("category").isin(*categories)
    if types is not None:
        out = out & F.col("work_type").isin(*types)
    if years is not None:
        out = out & F.col("pub_year").between(*years)
    return out if cap is None else out & (F.col("cap") <= cap)


def count_works(bitmaps: DataFrame, *by: str | Column) -> DataFrame:
    """Distinct works of the rows of each group."""
    merged = bitmaps.groupBy(*by, "bucket").agg(F.bitmap_or_agg("works").alias("works"))
    names = [c for c in merged.columns if c not in ("bucket", "works")]
    return merged.groupBy(*names).agg(F.sum(F.bitmap_count("works")).cast("bigint").alias("n_works"))
