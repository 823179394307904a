"""Column helpers shared by the operators: words, row keys, match positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Between two words of text whose A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def whole(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; plain ASCII texts take the short way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(lowered: Column) -> Column:
    return F.array_remove(F.split(lowered, GAP), "")


def row_key(*columns: str) -> Column:
    """Tells rows with the same (or no) id apart by their text; equal rows are one."""
    return F.xxhash64(*[F.col(c) for c in columns])


def small(df: DataFrame, rows: int) -> DataFrame:
    """Marks a written table for broadcast if it has at most ``rows`` rows; Spark joins it by shuffle otherwise."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def literal_array(values: list[int]) -> Column:
    """A constant array of whole numbers, sent to the plan as one literal; the optimizer folds it."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")


def all_matches(text: Column, pattern: Column) -> Column:
    """Array of (before, match): each match and the text between the previous one and it.

    ``split`` and ``regexp_extract_all`` walk the same matches, so piece i
    stands right before match i and their lengths give the positions.
    """
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    return F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("before"), found.alias("match"))


def positions(df: DataFrame, zipped: str, keys: list[str], measure) -> DataFrame:
    """Explode ``all_matches`` into rows with ``start`` and ``end`` in units of ``measure`` (from 0, end exclusive)."""
    rows = df.select("*", F.posexplode(zipped).alias("_i", "_m")).drop(zipped)
    upto = Window.partitionBy(*keys).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    both = measure(F.col("_m.before")) + measure(F.col("_m.match"))
    return (
        rows.withColumn("end", F.sum(both).over(upto).cast("long"))
        .withColumn("start", (F.col("end") - measure(F.col("_m.match"))).cast("long"))
        .withColumn("match", F.col("_m.match")).drop("_i", "_m")
    )
