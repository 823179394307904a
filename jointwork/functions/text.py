"""Text helpers for keys, file names and labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Label suffixes that are dropped for display, in this order.
UNIT_SUFFIXES = (", Department of", ", School of", ", Program in", ", The")


def unit_anchor_key(unit_id: Column) -> Column:
    return F.concat(F.lit("U"), unit_id.cast("string"))


def college_anchor(college: Column) -> Column:
    """Groups by the full name; the short key below names files only."""
    return F.concat(F.lit("C"), college)


def college_anchor_key(college: Column, width: int = 40) -> Column:
    return F.concat(
        F.lit("C"), F.substring(F.regexp_replace(college, r"[^\p{L}\p{N}]", "_"), 1, width)
    )


def payload_filename(key: Column, width: int = 72) -> Column:
    """Readable stem plus eight hash digits, so long keys stay unique."""
    stem = F.regexp_replace(F.regexp_replace(key, "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")
    return F.concat(
        F.substring(stem, 1, width), F.lit("_"), F.substring(F.sha1(key), 1, 8), F.lit(".json")
    )


def compact_unit(label: Column) -> Column:
    out = F.coalesce(label, F.lit(""))
    for suffix in UNIT_SUFFIXES:
        out = F.regexp_replace(out, f"(?i){suffix}$", "")
    return out


def truncate(text: Column, width: int) -> Column:
    return F.substring(text, 1, width)
