"""Importance resampling towards a target distribution of hashed n-grams.

Texts become arrays of feature buckets once (runs of one and two words, hashed
and counted with repeats), which are stored.  Counts of the buckets over all
documents and over all target texts give a gain per bucket, a literal array of
``BUCKETS`` numbers; a document's weight is summed over its array of buckets.
Weight plus Gumbel noise of the id is its score, so taking the highest scores
draws without replacement in proportion to the weights.

The draw needs exact ranks: parallel sorting by regular sampling.  Every task
sorts its rows and writes them as a run; regular samples of the runs give
``SEGMENTS`` - 1 splitters; rows are exchanged by segment, so no segment is
much larger than another, whatever the distribution of scores (ties included,
as ids are part of the order); each segment is sorted by itself, and the
counts of the segments before it make ranks out of its positions.  Segments
beyond the draw are neither exchanged nor sorted.  The driver sees the bucket
counts, the samples (SEGMENTS a run at most) and one count per segment.

Null and empty texts have no words and no features: weight 0.  A null id takes
part with the empty string in its place and comes last among equal scores;
repeated rows are rows of their own, with ranks of their own.  A text is
hashed in one piece, in about ten times its size of memory.  Empty tables give
no rows; an empty target table gives gains of the documents' counts alone.
Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from jointwork.llm.registry import register, table
from jointwork.llm.text_columns import literal_array, small
from jointwork.sources.writers import stored

BUCKETS = 10_000
MIN_WORDS, PERCENT, SEED = 20, 25, "7"
SEGMENTS = 256
#: Bytes of texts that are hashed together, and the length from which a word is hashed by itself.
TOGETHER, LONG_WORD = 1 << 22, 48
SMALL_ROWS = 100_000


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte -> lower-cased byte, byte -> is part of a word, byte -> step of the CRC."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    inside = np.zeros(256, bool)
    inside[48:58] = inside[97:123] = inside[128:] = True
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, np.uint32(0xEDB88320) ^ (crc >> np.uint32(1)), crc >> np.uint32(1))
    return lower, inside, crc.astype(np.uint32)


LOWER, INSIDE, STEP = _tables()


def _crc(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of data[start:start + size], each continued from ``before`` (0 at the start of a text)."""
    out = ~before
    by_size = np.argsort(-sizes, kind="stable")
    live = len(sizes) - np.searchsorted(sizes[by_size][::-1], np.arange(1, LONG_WORD + 1), "left")
    state, at = out[by_size], starts[by_size]
    short = len(sizes) - np.searchsorted(sizes[by_size][::-1], LONG_WORD, "right")  # so many are long and come first
    for step in range(LONG_WORD):
        n = live[step]
        if n <= short:
            break
        now = state[short:n]
        state[short:n] = STEP[(now ^ data[at[short:n] + step]) & np.uint32(255)] ^ (now >> np.uint32(8))
    out[by_size] = ~state
    for i in by_size[:short]:
        out[i] = zlib.crc32(data[starts[i] : starts[i] + sizes[i]], int(before[i]))
    return out


def features(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, and the buckets of all texts' features one text after the other with their number per text.

    ``data`` holds UTF-8 texts one after the other, each followed by a zero byte; ``ends`` are the places behind those.
    """
    data = LOWER[data]
    edge = np.diff(INSIDE[data].astype(np.int8), prepend=np.int8(0))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    text = np.searchsorted(ends, starts, "right")
    sizes, none = stops - starts, np.zeros(len(starts), np.uint32)
    one = _crc(data, starts, sizes, none)
    second = np.flatnonzero(text[1:] == text[:-1]) + 1 if len(text) else text
    spaced = ~one[second - 1]  # a space after the first word, then the second word
    spaced = ~(STEP[(spaced ^ np.uint32(32)) & np.uint32(255)] ^ (spaced >> np.uint32(8)))
    two = _crc(data, starts[second], sizes[second], spaced)
    n_words = np.bincount(text, minlength=len(ends))
    n_pairs = np.bincount(text[second], minlength=len(ends))
    buckets = np.concatenate([one, two]) % np.uint32(BUCKETS)
    order = np.argsort(np.concatenate([text, text[second]]), kind="stable")
    return n_words, buckets[order].astype(np.int16), n_words + n_pairs


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = batch.column("text").cast(pa.large_binary()).fill_null(b"")
        size = raw.nbytes and np.diff(np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1])
        parts = np.cumsum(size) // TOGETHER if len(raw) else np.zeros(0)
        for part in np.unique(parts):
            at = np.flatnonzero(parts == part)
            texts = raw.slice(at[0], len(at))
            joined = np.frombuffer(b"\0".join(texts.to_pylist()) + b"\0", np.uint8)
            n_words, buckets, n = features(joined, np.cumsum(size[at] + 1))
            arrays = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(buckets))
            yield pa.record_batch([batch.column("id").slice(at[0], len(at)), pa.array(n_words, pa.int64()), arrays], ["id", "n_words", "buckets"])


def hashed(texts: DataFrame, ident: str) -> DataFrame:
    """(id, n_words, buckets) of each text."""
    rows = texts.select(F.col(ident).alias("id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_hashed, f"id {rows.schema['id'].dataType.simpleString()}, n_words long, buckets array<smallint>")


def bucket_counts(rows: DataFrame) -> list[int]:
    found = rows.select(F.explode("buckets").alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect()
    counts = [0] * BUCKETS
    for r in found:
        counts[r["b"]] = r["n"]
    return counts


def gains(source: list[int], target: list[int]) -> list[int]:
    n_source, n_target = sum(source), sum(target)
    return [
        math.floor(1000 * math.log(float(t + 1) * (n_source + BUCKETS) / (float(s + 1) * (n_target + BUCKETS)))) for s, t in zip(source, target)
    ]


def scored(rows: DataFrame, gain: list[int]) -> DataFrame:
    """(id, n_words, n_features, weight, score) from arrays of buckets."""
    values = literal_array(gain)
    total = F.aggregate("buckets", F.lit(0).cast("long"), lambda sum_, b: sum_ + F.get(values, b.cast("int")))
    n = F.size("buckets").cast("long")
    head = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((head + 0.5) / 4294967296.0)))
    each = rows.select("id", "n_words", n.alias("n_features"), total.alias("total"), noise.alias("noise"))
    mean = F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(F.lit(0).cast("long"))
    return each.select("id", "n_words", "n_features", mean.alias("weight"), (mean + F.col("noise")).cast("long").alias("score"))


def _key() -> Column:
    """Ascending in the order of ranks: higher scores first, then smaller ids, then no id."""
    return F.struct((-F.col("score")).alias("s"), F.col("id").isNull().cast("long").alias("n"), F.coalesce("id", F.lit(0)).cast("long").alias("i"))


def sorted_runs(rows: DataFrame) -> DataFrame:
    """``rows`` as locally sorted runs, with the run of a row and its position there, stored."""
    run = rows.sortWithinPartitions(F.desc("score"), F.asc_nulls_last("id")).withColumn("_mid", F.monotonically_increasing_id())
    return stored(run.withColumn("run", F.shiftright("_mid", 33)).withColumn("place", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))).drop("_mid"), "runs")


def splitters(runs: DataFrame, segments: int = SEGMENTS) -> list[tuple]:
    """Keys that cut all rows into ``segments`` of about equal size: regular samples of the sorted samples of the runs."""
    sizes = stored(runs.groupBy("run").agg(F.count(F.lit(1)).alias("_n")), "run-sizes")
    step = lambda place: F.floor(place * F.lit(segments) / F.col("_n"))
    picked = runs.join(small(sizes, SMALL_ROWS), "run").filter(step(F.col("place") + 1) > step(F.col("place"))).select(_key().alias("key"))
    keys = sorted((r["key"]["s"], r["key"]["n"], r["key"]["i"]) for r in picked.collect())
    places = sorted({len(keys) * j // segments for j in range(1, segments)})
    return [keys[p] for p in places if p < len(keys)]


def segment_of(cuts: list[tuple]) -> Column:
    """How many of the sorted ``cuts`` a row's key is not below: a binary search of a few steps in the plan."""
    if not cuts:
        return F.lit(0)
    # Three constant arrays, which the optimizer folds; the steps halve the part that is left.
    held = [literal_array([int(c[i]) for c in cuts]) for i in range(3)]
    steps = literal_array([1 << b for b in reversed(range(len(cuts).bit_length()))])

    def search(key: Column) -> Column:
        def reached(place: Column) -> Column:
            s, n, i = (F.get(h, place.cast("int")) for h in held)
            below = (key["s"] > s) | ((key["s"] == s) & ((key["n"] > n) | ((key["n"] == n) & (key["i"] >= i))))
            return F.coalesce(below, F.lit(False))  # no cut at this place

        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda at, step: at + F.when(reached(at + step - 1), step).otherwise(0))

    return F.get(F.transform(F.array(_key()), search), F.lit(0)).cast("int")


def ranked(rows: DataFrame, draw: Column, percent: int = PERCENT, segments: int = SEGMENTS) -> DataFrame:
    """``rows`` (id, score and others) with ``rank``: exact places of the highest ``percent`` of those where ``draw`` holds, else null."""
    runs = sorted_runs(rows.withColumn("_in", F.coalesce(draw, F.lit(False))))
    cut = runs.withColumn("segment", F.when(F.col("_in"), segment_of(splitters(runs.filter("_in"), segments))))
    counts = {r["segment"]: r["n"] for r in cut.filter("_in").groupBy("segment").agg(F.count(F.lit(1)).alias("n")).collect()}
    wanted, before, offsets = sum(counts.values()) * percent // 100, 0, []
    for i in range(max(counts, default=-1) + 1):
        offsets.append(before)
        before += counts.get(i, 0)
    last = sum(1 for o in offsets if o < wanted)  # segments from here on hold nothing that is drawn
    inside = F.coalesce(F.col("segment") < last, F.lit(False))
    own = F.row_number().over(Window.partitionBy("segment").orderBy(F.desc("score"), F.asc_nulls_last("id"))).cast("long")
    place = F.get(literal_array(offsets or [0]), F.col("segment")) + own
    drawn = cut.filter(inside).withColumn("_place", place).withColumn("rank", F.when(F.col("_place") <= wanted, F.col("_place"))).drop("_place")
    rest = cut.filter(~inside).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).drop("_in", "segment", "run", "place")


def resample(docs: DataFrame, target: DataFrame, ident: str = "doc_id", target_ident: str = "item_id", percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """Every document with n_words, n_features, weight, score and, if it is drawn, its rank."""
    rows = stored(hashed(docs, ident), "buckets")
    gain = gains(bucket_counts(rows), bucket_counts(hashed(target, target_ident)))
    return ranked(scored(rows, gain), F.col("n_words") >= min_words, percent).withColumnRenamed("id", ident)


@register("op13_importance_resampling")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")
