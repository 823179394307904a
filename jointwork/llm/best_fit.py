"""Packing documents into sequences: best fit over a histogram of lengths.

1. Tasks encode whole texts, add the end id and cut documents longer than a
   sequence; a piece keeps its length and the checksum of its ids.
2. Only the histogram goes to the driver, at most ``capacity`` numbers.  Best
   fit, longest first, is planned for counts: all pieces of a length that go
   to bins with the same room are one step, so the plan has a few steps per
   length however many documents there are.
3. A piece takes the slot planned for its rank within its length.  Ranks are
   counted per (length, bucket of the id), so no length is ranked in one task.

Null text counts as empty (one piece with the end id).  Rows with equal
doc_id are documents of their own, also with a null doc_id.  An empty table
gives no row.  Other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from jointwork.llm.registry import register, table
from jointwork.llm.token_ids import encoder, in_blocks
from jointwork.sources.writers import stored

CAPACITY = 4096
END_ID = 1
BUCKETS = 64
REMEMBERED = 300_000
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, bucket int"


def cut_pieces(docs: DataFrame, vocabulary: str, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(vocabulary, False, REMEMBERED), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = list(zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("bucket").to_pylist()))
            for block in in_blocks(rows):
                out = []
                for (doc, _, bucket), ids in zip(block, enc.encode([t or "" for _, t, _ in block])):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[at : at + 4 * capacity]
                        out.append((doc, k, at // 4, len(piece) // 4, zlib.crc32(piece), bucket))
                doc, k, at, n, crc, bucket = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(k, pa.int32()), pa.array(at, pa.int64()), pa.array(n, pa.int32()), pa.array(crc, pa.int64()), pa.array(bucket, pa.int32())],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "bucket"],
                )

    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int").alias("bucket")
    return docs.select("doc_id", "text", bucket).mapInArrow(cut, PIECES)


def plan_slots(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest first, for counts: steps (length, first rank, pieces, first sequence, pieces per sequence, offset).

    Piece j of a step stands in sequence first + j // per, at offset + (j % per) * length.
    """
    steps, used = [], 0
    room: list[int] = []  # sorted rooms with open bins
    open_bins: dict[int, list[tuple[int, int]]] = {}  # room -> ranges of sequences

    def put(r: int, lo: int, hi: int) -> None:
        if r and lo < hi:
            if r not in open_bins:
                bisect.insort(room, r)
                open_bins[r] = []
            open_bins[r].append((lo, hi))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            k = bisect.bisect_left(room, length)
            if k < len(room):
                r = room[k]
                lo, hi = open_bins[r].pop()
                if not open_bins[r]:
                    del open_bins[r], room[k]
            else:
                r, per = capacity, capacity // length
                lo, hi = used, used + -(-left // per)
                used = hi
            per = r // length
            full = min(hi - lo, left // per)
            if full:
                steps.append((length, rank, full * per, lo, per, capacity - r))
                rank, left = rank + full * per, left - full * per
                put(r - per * length, lo, lo + full)
            if full < hi - lo:
                if left:  # fewer than fill one more bin
                    steps.append((length, rank, left, lo + full, per, capacity - r))
                    put(r - left * length, lo + full, lo + full + 1)
                    full, rank, left = full + 1, rank + left, 0
                put(r, lo + full, hi)
    return steps


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32, bucket) with sequence_id and offset."""
    sizes = pieces.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))  # at most capacity * BUCKETS rows
    by_length = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(by_length), F.lit(0)).alias("before"))
    counts = {r[0]: r[1] for r in sizes.groupBy("length").agg(F.sum("n")).collect()}
    steps = np.array(plan_slots(counts, capacity), "i8").reshape(-1, 6)
    steps = steps[np.lexsort((steps[:, 1], steps[:, 0]))]
    reach = 1 << 42
    plan = pieces.sparkSession.sparkContext.broadcast((steps, steps[:, 0] * reach + steps[:, 1]))

    def slot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, keys = plan.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy().astype("i8"), batch.column("rank").to_numpy()
            step = steps[np.searchsorted(keys, length * reach + rank, "right") - 1]
            j = rank - step[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start")), pa.array(length), batch.column("ids_crc32"),
                 pa.array(step[:, 3] + j // step[:, 4]), pa.array(step[:, 5] + j % step[:, 4] * length)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        pieces.join(F.broadcast(before), ["length", "bucket"])
        .withColumn("rank", (F.row_number().over(inside) - 1 + F.col("before")).cast("long"))
    )
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        slot, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def best_fit(docs: DataFrame, vocabulary: str, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    return pack(stored(cut_pieces(docs, vocabulary, end_id, capacity), "pieces"), capacity)


@register("op4_best_fit")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return best_fit(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
