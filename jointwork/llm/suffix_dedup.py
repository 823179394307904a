"""Repeated byte strings by a logarithmic family of indexes of hashed anchor grams.

1. Suffixes are indexed at anchors (see ``anchors``): every window of
   ``window`` bytes holds one, at the same place in each of its copies.
2. Documents come in batches.  A batch gets its index: the distinct hashes of
   the first ``gram`` bytes of its anchored suffixes, dealt out by hash.  This
   is no suffix order: the first bytes (``head``) only sort the rows of a file,
   and no comparison reads them.  The index is joined by hash with the levels
   that exist; hashes in both are candidates for long matches.  Then levels of
   equal size merge, so the family has as many levels as the number of batches
   has bits, and an entry is rewritten as often at most.
3. Runs of windows at candidate suffixes are compared in whole.  If a run's
   bytes occur twice, all its windows are repeated.  Runs that share only
   their anchor with other runs (the ends of repeated passages) are cut out of
   their texts and compared window by window.
4. The repeated windows of a document are merged to spans and removed.

Matches never cross documents.  Null text counts as empty.  Repeated rows are
documents of their own, so all of their windows are repeated; a null doc_id is
kept.  An empty table gives no row.  Other columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from jointwork.llm.anchors import GRAM, WINDOW, runs
from jointwork.llm.registry import register, table
from jointwork.llm.rolling import mix, prefix_sums, spans
from jointwork.llm.text_columns import row_key, whole
from jointwork.operators.skew import shared_dir
from jointwork.sources.writers import stored

BATCHES = 4
BLOCK_BYTES = 1 << 20
#: Keys with more different runs than this are compared by Spark, window by window; the others within one task each.
MANY_RUNS = 50_000


def tidy(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now, not at the driver's next collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", row_key("doc_id", "text").alias("k"), whole().cast("binary").alias("text"))


def _runs(batch: pa.RecordBatch, window: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, anchor, first, last, key, variant, head) for blocks of rows; a very long text comes in overlapping parts."""
    texts: list[bytes] = []
    owner: list[int] = []
    offset: list[int] = []

    def flush():
        who, a, first, last, key, variant, head, _ = runs(texts, window, gram)
        off = np.array(offset, "i8")[who] if len(who) else who
        out = (np.array(owner, "i8")[who] if len(who) else who, a + off, first + off, last + off, key, variant, head)
        texts.clear(), owner.clear(), offset.clear()
        return out

    size = 0
    for i, text in enumerate(batch.column("text").to_pylist()):
        if len(text) < window:
            continue
        for at in range(0, len(text) - window + 1, BLOCK_BYTES):
            part = text[at : at + BLOCK_BYTES + window - 1]
            texts.append(part), owner.append(i), offset.append(at)
            size += len(part)
            if size >= BLOCK_BYTES:
                yield flush()
                size = 0
    if texts:
        yield flush()


class SuffixFamily:
    """Levels of anchored suffixes; level i holds 2**i batches."""

    def __init__(self, window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram = window, gram
        self.levels: dict[int, tuple[DataFrame, str]] = {}
        self.matched: list[DataFrame] = []

    def _write(self, rows: DataFrame) -> tuple[DataFrame, str]:
        path = shared_dir(rows.sparkSession, "suffixes")
        rows.repartition("key").sortWithinPartitions("head", "key").write.parquet(path)
        return rows.sparkSession.read.schema(rows.schema).parquet(path), path

    def add(self, batch: DataFrame) -> None:
        """Index a batch (k, text) and note the suffixes that it shares with itself or with earlier batches."""
        window, gram = self.window, self.gram

        def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                for _, _, _, _, key, _, head in _runs(rows, window, gram):
                    key, at, n = np.unique(key, return_index=True, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(head[at].view("i8")), pa.array(key.view("i8")), pa.array(n)], ["head", "key", "n"])

        spark = batch.sparkSession
        found = batch.select("text").mapInArrow(suffixes, "head long, key long, n long")
        new, path = self._write(found.groupBy("key").agg(F.min("head").alias("head"), F.sum("n").alias("n")))
        self.matched.append(new.filter("n > 1").select("key"))
        for level, _ in self.levels.values():
            self.matched.append(stored(new.select("key").join(level.select("key"), "key", "left_semi"), "matched"))
        self.matched[-len(self.levels) - 1] = stored(self.matched[-len(self.levels) - 1], "matched")
        rank, merged, old = 0, new, [path]
        while rank in self.levels:
            level, where = self.levels.pop(rank)
            merged, rank = merged.unionByName(level), rank + 1
            old.append(where)
        if rank:  # all levels that the batch carries over merge at once
            merged, path = self._write(merged.groupBy("key").agg(F.min("head").alias("head"), F.sum("n").alias("n")))
            conf = spark._jsc.hadoopConfiguration()
            for where in old:
                p = spark._jvm.org.apache.hadoop.fs.Path(where)
                p.getFileSystem(conf).delete(p, True)
        self.levels[rank] = (merged, path)
        tidy(spark)

    def matches(self) -> DataFrame:
        """Keys of suffixes that occur at least twice."""
        out = self.matched[0]
        for more in self.matched[1:]:
            out = out.unionByName(more)
        return out.distinct()


def candidate_runs(keyed: DataFrame, matches: DataFrame, window: int, gram: int) -> DataFrame:
    """(key, variant, k, first, before, last) of all runs at matching suffixes; ``before`` bytes lie before the anchor."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            ks = rows.column("k").to_numpy()
            for who, a, first, last, key, variant, _ in _runs(rows, window, gram):
                place = (first << 16) | ((a - first) << 8) | (last - first)
                yield pa.RecordBatch.from_arrays([pa.array(key.view("i8")), pa.array(variant.view("i8")), pa.array(ks[who]), pa.array(place)], ["key", "variant", "k", "place"])

    found = keyed.select("k", "text").mapInArrow(entries, "key long, variant long, k long, place long")
    return found.join(matches, "key", "left_semi")


def repeated_spans(keyed: DataFrame, candidates: DataFrame, window: int) -> DataFrame:
    """(k, begin, end) of repeated windows, partly merged.  ``candidates`` is a written table."""
    counts = candidates.groupBy("key", "variant").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k", "place")).alias("one"))
    counts = stored(counts, "run-counts")
    kinds = counts.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.max("n").alias("most"))
    first = F.shiftright("place", 16)
    end = first + F.col("place").bitwiseAND(F.lit(255)) + window
    full = (
        candidates.join(counts.filter("n > 1").select("key", "variant"), ["key", "variant"], "left_semi")
        .select("k", first.alias("begin"), end.alias("end"))
    )
    mixed = (
        counts.join(kinds.filter("kinds > 1"), "key")
        .select("key", "kinds", (F.col("n") == 1).alias("open"), F.col("one.k").alias("k"), F.col("one.place").alias("place"))
    )
    lists = mixed.groupBy("k").agg(F.collect_list(F.struct("key", "kinds", "open", "place")).alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out = {c: [] for c in ("key", "kinds", "open", "k", "place", "bytes")}
            held = 0
            for k, text, wanted in zip(*(rows.column(c).to_pylist() for c in ("k", "text", "runs"))):
                for r in wanted:
                    at = r["place"] >> 16
                    for c, v in zip(out, (r["key"], r["kinds"], r["open"], k, r["place"], text[at : at + (r["place"] & 255) + window])):
                        out[c].append(v)
                    held += 300
                if held > 8 << 20:
                    yield pa.RecordBatch.from_pydict(out, schema=schema)
                    out, held = {c: [] for c in out}, 0
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    schema = pa.schema([("key", pa.int64()), ("kinds", pa.int64()), ("open", pa.bool_()), ("k", pa.int64()), ("place", pa.int64()), ("bytes", pa.binary())])
    # Rows that are equal in doc_id and text have one key: their runs are whole copies and one of them is enough here.
    cuts = keyed.select("k", "text").join(lists, "k").mapInArrow(cut, "key long, kinds long, open boolean, k long, place long, bytes binary").dropDuplicates(["k", "place"])
    cuts = stored(cuts, "cuts")

    def windows(rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row number, window start in the text and hash of each window with its place around the anchor."""
        texts, places = rows.column("bytes").to_pylist(), rows.column("place").to_numpy()
        sums = prefix_sums(np.frombuffer(b"".join(texts), "u1"))
        n = (places & 255) + 1
        who = np.repeat(np.arange(len(places)), n)
        step = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
        starts = np.cumsum([0] + [len(t) for t in texts[:-1]])
        begin = starts[who] + step
        before = ((places >> 8) & 255)[who] - step
        return who, (places >> 16)[who] + step, spans(sums, begin, begin + window) ^ mix(before.astype("u8") + np.uint64(7))

    def covered(who: np.ndarray, at: np.ndarray, ks: np.ndarray) -> pa.Table:
        """Neighbouring windows of a row as one span."""
        new = np.ones(len(who), bool)
        new[1:] = (who[1:] != who[:-1]) | (at[1:] != at[:-1] + 1)
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(who)) - 1
        return pa.table([pa.array(ks[who[begin]]), pa.array(at[begin]), pa.array(at[end] + window)] if len(who) else [pa.array([], pa.int64())] * 3, names=["k", "begin", "end"])

    def compare(rows: pa.Table) -> pa.Table:
        """All runs of a key: windows that two of them hold."""
        who, at, h = windows(rows)
        _, back, n = np.unique(h, return_inverse=True, return_counts=True)
        good = (n[back] > 1) & rows.column("open").to_numpy(zero_copy_only=False)[who]
        return covered(who[good], at[good], rows.column("k").to_numpy())

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            who, at, h = windows(rows)
            own = rows.column("open").to_numpy(zero_copy_only=False)[who]
            yield pa.RecordBatch.from_arrays([pa.array(rows.column("k").to_numpy()[who]), pa.array(at), pa.array(h.view("i8") ^ rows.column("key").to_numpy()[who]), pa.array(own)], ["k", "at", "h", "open"])

    span = "k long, begin long, end long"
    few = cuts.filter(F.col("kinds") <= MANY_RUNS).groupBy("key").applyInArrow(compare, span)
    each = cuts.filter(F.col("kinds") > MANY_RUNS).mapInArrow(spread, "k long, at long, h long, open boolean")
    twice = each.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    many = each.filter("open").join(twice, "h", "left_semi").select("k", F.col("at").alias("begin"), (F.col("at") + window).alias("end"))
    return full.unionByName(few).unionByName(many)


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, texts: bool = False) -> DataFrame:
    """Per document: bytes, removed bytes and spans, digest of what is kept (and with ``texts`` the kept bytes)."""
    spark = docs.sparkSession
    keyed = _keyed(docs)
    family = SuffixFamily(window, gram)
    for b in range(batches):
        family.add(keyed.filter(F.pmod("k", F.lit(batches)) == b))
    candidates = stored(candidate_runs(keyed, stored(family.matches(), "matches"), window, gram), "candidates")
    tidy(spark)
    found = stored(repeated_spans(keyed, candidates, window).distinct(), "spans")
    tidy(spark)
    lists = found.groupBy("k").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out = []
            for doc, text, places in zip(*(rows.column(c).to_pylist() for c in ("doc_id", "text", "spans"))):
                kept, at, removed, n = [], 0, 0, 0
                for begin, end in sorted((p["begin"], p["end"]) for p in places or []):
                    if begin > at or not n:
                        kept.append(text[at:begin])
                        n += 1
                        removed += end - begin
                        at = end
                    elif end > at:
                        removed += end - at
                        at = end
                kept = b"".join([*kept, text[at:]])
                out.append((doc, len(text), removed, n, hashlib.sha256(kept).hexdigest(), *([kept] if texts else [])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    schema = pa.schema(fields + [("kept", pa.binary())] * texts)
    return keyed.join(lists, "k", "left").select("doc_id", "text", "spans").mapInArrow(
        strip, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts
    )


@register("op3_suffix_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
