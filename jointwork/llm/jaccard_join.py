"""Exact Jaccard join on word shingles by grouped prefixes.

1. Shingles of a document are hashed.  Those that a share of all documents
   holds ("frequent", a short list) are kept apart; the others are counted by
   bucket of their hash, and only shingles of two documents or more return to
   their documents.  A shingle of one document can match nothing.
2. In the order rare before frequent, two documents with Jaccard similarity of
   at least t share a shingle among their first n - ceil(t n) + 1.  Of these
   only the repeated ones count.  Documents with equal size, equal number of
   single shingles and equal repeated prefix are one GROUP.
3. Groups that share a prefix shingle are compared as a whole: sizes, places
   of the shared shingle, and single shingles bound the similarity.
4. Groups are expanded and verified: first the smallest member of each group
   against its own members, and one hub per prefix shingle against all groups
   there; then, exactly, every pair that the filters leave and that is not yet
   linked through others.  Thus no link between texts of different components
   is missed, and a large group of near copies does not need all its pairs.

Rows are documents of their own also when ids repeat or are null; a component
takes the smallest doc_id in it.  Null and empty texts have no shingles and no
links.  An empty table gives no row.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from jointwork.llm.components import components
from jointwork.llm.registry import register, table
from jointwork.llm.remember import forget
from jointwork.llm.rolling import mix, shingle_sets
from jointwork.sources.writers import stored

SIZE = 5
PERCENT = 80
BLOCK = 1024
#: A shingle is frequent if this share of the documents holds it, by blocks and in all; at most 2 / SHARE times the
#: mean number of shingles of a document can be.
SHARE = 0.01
NO_ID = np.iinfo(np.int64).min
POSTINGS = "bucket long, block long, low binary, high binary, owner binary, info binary"
RETURNED = "block long, key binary, df binary, owner binary, info binary"
MEMBERS = "node long, doc_id long, n long, single long, group_key long, same_set long, prefix array<struct<key: long, place: int>>, keys binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    forget()
    number = TaskContext.get().partitionId() << 24
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            yield number, batch.slice(at, BLOCK)
            number += 1


def _sets(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    return shingle_sets([(t or "").encode() for t in batch.column("text").to_pylist()], size)


def frequent_shingles(docs: DataFrame, size: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of the frequent shingles.

    Blocks send what is frequent among their own documents (summed by Spark);
    what is frequent nowhere is not frequent as a whole.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, batch in _blocks(batches):
            hashes, n = np.unique(_sets(batch, size)[1], return_counts=True)
            often = n >= max(8, share * batch.num_rows)
            yield pa.RecordBatch.from_pydict({"h": pa.array(hashes[often].view("i8")), "n": pa.array(n[often])})

    counts = docs.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    found = counts.filter(F.col("n") >= F.lit(max(8.0, share / 2 * docs.count()))).toPandas()
    order = np.argsort(found["h"].to_numpy("i8").view("u8"))
    return found["h"].to_numpy("i8").view("u8")[order], found["n"].to_numpy("i8")[order]


def members(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, share: float = SHARE) -> DataFrame:
    """Per document its set size; for those that may have partners also group, prefix and repeated shingles."""
    spark = docs.sparkSession
    n_docs = docs.count()
    frequent = spark.sparkContext.broadcast(frequent_shingles(docs, size, share))
    n_buckets = 1 << max(6, (max(n_docs, 1) // 512).bit_length())  # some 500 documents' shingles each
    bits = n_buckets.bit_length() - 1

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, _ = frequent.value
        for block, batch in _blocks(batches):
            owner, h = _sets(batch, size)
            sizes = np.bincount(owner, minlength=batch.num_rows).astype("i8")
            at = np.searchsorted(often, h)
            is_often = (often[np.minimum(at, len(often) - 1)] == h) if len(often) else np.zeros(len(h), bool)
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False) if batch.column("doc_id").null_count == 0 else np.array(
                [NO_ID if x is None else x for x in batch.column("doc_id").to_pylist()])
            heavy = np.stack([owner[is_often], at[is_often]]).astype("<i8") if len(h) else np.zeros((2, 0), "<i8")
            info = np.int64([batch.num_rows]).tobytes() + ids.astype("<i8").tobytes() + sizes.tobytes() + heavy.tobytes()
            owner, h = owner[~is_often].astype("<u2"), h[~is_often]
            order = np.argsort(h)
            owner, h = owner[order], h[order]
            bucket = (h >> np.uint64(64 - bits)).astype("i8")
            rest = (h >> np.uint64(24 - bits)) & np.uint64((1 << 40) - 1)
            low, high = (rest & np.uint64(0xFFFFFFFF)).astype("<u4"), (rest >> np.uint64(32)).astype("u1")
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1)) if len(bucket) else np.zeros(0, "i8")
            ends = np.append(cuts[1:], len(bucket))
            yield pa.RecordBatch.from_arrays([
                pa.array([*bucket[cuts].tolist(), -1 - block]), pa.array([block] * (len(cuts) + 1), pa.int64()),
                *(pa.array([*(a[i:j].tobytes() for i, j in zip(cuts, ends)), None], pa.binary()) for a in (low, high, owner)),
                pa.array([None] * len(cuts) + [info], pa.binary()),
            ], names=["bucket", "block", "low", "high", "owner", "info"])

    def repeated(key: tuple, rows: pa.Table) -> pa.Table:
        """Shingles of a bucket that two documents hold, back to their blocks with the number of documents."""
        if key[0].as_py() < 0:
            none = pa.nulls(rows.num_rows, pa.binary())
            return pa.table([rows["block"].combine_chunks(), none, none, none, rows["info"].combine_chunks()], names=["block", "key", "df", "owner", "info"])
        lows = [np.frombuffer(x, "<u4") for x in rows["low"].to_pylist()]
        low, high = np.concatenate(lows).astype("u8"), np.concatenate([np.frombuffer(x, "u1") for x in rows["high"].to_pylist()]).astype("u8")
        owner = np.concatenate([np.frombuffer(x, "<u2") for x in rows["owner"].to_pylist()])
        block = np.repeat(rows["block"].to_numpy(), [len(x) for x in lows])
        h = low | (high << np.uint64(32)) | (np.uint64(key[0].as_py()) << np.uint64(40))
        order = np.argsort(h, kind="stable")
        h, owner, block = h[order], owner[order], block[order]
        cut = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        df = np.repeat(np.diff(np.append(cut, len(h))), np.diff(np.append(cut, len(h))))
        h, owner, block, df = (x[df > 1] for x in (h, owner, block, df))
        order = np.argsort(block, kind="stable")
        h, owner, block, df = (x[order] for x in (h, owner, block, df))
        cut = np.flatnonzero(np.diff(block, prepend=-1))
        end = np.append(cut[1:], len(block))
        cols = [[x[i:j].tobytes() for i, j in zip(cut, end)] for x in (h.astype("<u8"), df.astype("<i4"), owner)]
        return pa.table([pa.array(block[cut]), *(pa.array(c, pa.binary()) for c in cols), pa.nulls(len(cut), pa.binary())], names=["block", "key", "df", "owner", "info"])

    def prefixes(key: tuple, rows: pa.Table) -> pa.Table:
        """All documents of a block."""
        often, often_df = frequent.value
        got = [r for r in rows.to_pylist() if r["info"] is None]
        info = next(r["info"] for r in rows.to_pylist() if r["info"] is not None)
        count = int(np.frombuffer(info[:8], "<i8")[0])
        ids, sizes = np.frombuffer(info[8 : 8 + 8 * count], "<i8"), np.frombuffer(info[8 + 8 * count : 8 + 16 * count], "<i8")
        heavy = np.frombuffer(info[8 + 16 * count :], "<i8").reshape(2, -1)
        cat = lambda name, kind: np.concatenate([np.zeros(0, kind), *(np.frombuffer(r[name], kind) for r in got)])
        # Keys of frequent shingles have the top bit, so that they differ from the others and come last.
        keys = np.concatenate([cat("key", "<u8"), heavy[1].astype("u8") | np.uint64(1 << 63)])
        df = np.concatenate([cat("df", "<i4"), often_df[heavy[1]]])
        owner = np.concatenate([cat("owner", "<u2").astype("i8"), heavy[0]])
        order = np.lexsort((keys, df, keys >> np.uint64(63), owner))
        keys, owner = keys[order], owner[order]
        begin, end = np.searchsorted(owner, np.arange(count)), np.searchsorted(owner, np.arange(count), "right")
        single = sizes - (end - begin)
        length = sizes - (percent * sizes + 99) // 100 + 1
        out = {c: [] for c in ("node", "doc_id", "n", "single", "group_key", "same_set", "prefix", "keys")}
        for i in range(count):
            row = (int(key[0].as_py()) * BLOCK + i, None if ids[i] == NO_ID else int(ids[i]), int(sizes[i]), int(single[i]))
            rest = (None, None, None, None)
            if sizes[i] and single[i] < length[i]:
                mine = keys[begin[i] : end[i]]
                first = mine[: length[i] - single[i]]
                weights = mix(np.arange(1, len(first) + 1, dtype="u8"))
                shape = mix(np.array([(int(sizes[i]) << 32) + int(single[i])], "u8"))[0]
                group = mix((mix(first) * weights).sum(keepdims=True) ^ shape).view("i8")[0]
                mine = np.sort(mine)
                same = mix((mix(mine) * mix(np.arange(1, len(mine) + 1, dtype="u8"))).sum(keepdims=True) ^ shape).view("i8")[0] if single[i] == 0 else mix(np.array([row[0]], "u8")).view("i8")[0]
                places = [{"key": k, "place": p} for p, k in enumerate(first.view("i8").tolist(), int(single[i]))]
                rest = (int(group), int(same), places, mine.astype("<u8").tobytes())
            for c, v in zip(out, (*row, *rest)):
                out[c].append(v)
        kinds = [pa.int64()] * 6 + [pa.list_(pa.struct([("key", pa.int64()), ("place", pa.int32())])), pa.binary()]
        return pa.table([pa.array(v, t) for v, t in zip(out.values(), kinds)], names=list(out))

    posted = docs.select("doc_id", "text").mapInArrow(post, POSTINGS)
    return posted.groupBy("bucket").applyInArrow(repeated, RETURNED).groupBy("block").applyInArrow(prefixes, MEMBERS)


def _reach(n_a: Column, single_a: Column, n_b: Column, single_b: Column, percent: int) -> Column:
    """No pair with such sizes and single shingles can be less similar in its union: the most that can be shared is enough."""
    shared = F.least(n_a - single_a, n_b - single_b)
    return shared * 100 >= percent * F.greatest(n_a + single_b, n_b + single_a)


def _fits(a: str, b: str, percent: int) -> Column:
    """All filters for two groups at a shared prefix shingle: sizes, its places, single shingles."""
    col = F.col
    least = F.ceil(F.lit(percent) * (col(f"{a}.n") + col(f"{b}.n")) / (100 + percent))
    most = F.least(col(f"{a}.n") - col(f"{a}.place"), col(f"{b}.n") - col(f"{b}.place"))
    return (
        (col(f"{a}.n") * 100 >= percent * col(f"{b}.n")) & (col(f"{b}.n") * 100 >= percent * col(f"{a}.n"))
        & (most >= least) & _reach(col(f"{a}.n"), col(f"{a}.single"), col(f"{b}.n"), col(f"{b}.single"), percent)
    )


def prefix_shingles(groups: DataFrame) -> DataFrame:
    return groups.select("group_key", "pivot", "n", "single", F.explode("prefix").alias("t")).select(
        F.col("t.key").alias("key"), F.col("t.place").alias("place"), "group_key", "pivot", "n", "single"
    )


def hub_pairs(tokens: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, gb): per prefix shingle the group with the fewest single shingles stands for a hub; its pivot a and the other groups gb."""
    hub = tokens.groupBy("key").agg(F.min(F.struct("single", "pivot", "n", "place", "group_key")).alias("h"))
    t, h = tokens.alias("t"), hub.select("key", "h.*").alias("h")
    return (
        t.join(h, (F.col("t.key") == F.col("h.key")) & (F.col("t.group_key") != F.col("h.group_key")) & _fits("t", "h", percent))
        .select(F.col("h.pivot").alias("a"), F.col("t.group_key").alias("gb")).distinct()
    )


def group_pairs(tokens: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (ga < gb) of groups that pass the filters and are not in one component yet.

    ``tokens`` carry ``root``, the component of all members of the group, or
    null if they are in several.  A shingle whose groups are all in one
    component has no pair.
    """
    open_ = tokens.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("all"), F.count("root").alias("known"))
    some = open_.filter("all > 1 and (known < all or lo <> hi)").select("key")
    left = tokens.join(some, "key", "left_semi")
    a, b, col = left.alias("a"), left.alias("b"), F.col
    apart = col("a.root").isNull() | col("b.root").isNull() | (col("a.root") != col("b.root"))
    fits = (col("a.key") == col("b.key")) & (col("a.group_key") < col("b.group_key")) & apart & _fits("a", "b", percent)
    return a.join(b, fits).select(col("a.group_key").alias("ga"), col("b.group_key").alias("gb")).distinct()


def verify(pairs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) of class representatives that are similar enough, by their repeated shingles."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("a_n", "a_keys", "b_n", "b_keys")))
            good = []
            for na, ka, nb, kb in rows:
                ka, kb = np.frombuffer(ka, "<u8"), np.frombuffer(kb, "<u8")
                shared = len(np.intersect1d(ka, kb, assume_unique=True))
                good.append(100 * shared >= percent * (na + nb - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good))

    side = lambda s: classes.select(F.col("node").alias(s), F.col("n").alias(f"{s}_n"), F.col("keys").alias(f"{s}_keys"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_n", "a_keys", "b_n", "b_keys").mapInArrow(check, "a long, b long")


def jaccard_components(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, node (row id), n (set size), component_id."""
    every = stored(members(docs, size, percent), "members")
    some = every.filter("group_key is not null")
    # Equal sets are one class, stood for by its smallest row.
    reps = some.groupBy("group_key", "same_set", "n", "single").agg(F.min("node").alias("node"))
    classes = stored(reps.join(some.select("node", "prefix", "keys"), "node"), "classes")
    slim = classes.select("node", "group_key")
    groups = classes.groupBy("group_key", "n", "single").agg(F.min("node").alias("pivot"), F.any_value("prefix").alias("prefix"))
    groups = stored(groups, "groups")
    tokens = prefix_shingles(groups)
    ordered = lambda df: df.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    inner = groups.select(F.col("pivot").alias("a"), F.col("group_key").alias("gb"))
    members_of = slim.select(F.col("group_key").alias("gb"), F.col("node").alias("b"))
    tried = stored(ordered(hub_pairs(tokens, percent).unionByName(inner).join(members_of, "gb").select("a", "b")), "tried")
    links = stored(verify(tried, classes, percent), "star-links")
    placed = slim.join(components(links), "node", "left").select("node", "group_key", F.coalesce("root", "node").alias("root"))
    placed = stored(placed, "placed")
    # What is left: pairs between different components.  A group in one component has none within itself.
    homes = placed.groupBy("group_key").agg(F.when(F.min("root") == F.max("root"), F.min("root")).alias("root"))
    homes = stored(homes, "homes")
    near = group_pairs(tokens.join(homes, "group_key"), percent)
    own = homes.filter("root is null").select(F.col("group_key").alias("ga"), F.col("group_key").alias("gb"))
    left = placed.select(F.col("group_key").alias("ga"), F.col("node").alias("a"), F.col("root").alias("ra"))
    right = placed.select(F.col("group_key").alias("g"), F.col("node").alias("b"), F.col("root").alias("rb"))
    apart = near.unionByName(own).join(left, "ga")
    apart = apart.join(right, (F.col("gb") == F.col("g")) & (F.col("ra") != F.col("rb"))).select("a", "b")
    rest = ordered(apart).join(tried, ["a", "b"], "left_anti")
    more = stored(verify(rest, classes, percent), "rest-links")
    final = components(links.unionByName(more))
    rep_of = some.join(reps.select("group_key", "same_set", "n", "single", F.col("node").alias("rep")), ["group_key", "same_set", "n", "single"]).select("node", "rep")
    rooted = rep_of.join(final.select(F.col("node").alias("rep"), "root"), "rep", "left").select("node", F.coalesce("root", "rep").alias("root"))
    named = every.select("node", "doc_id", "n").join(rooted, "node", "left")
    named = stored(named.select("node", "doc_id", "n", F.coalesce("root", "node").alias("root")), "rooted")
    smallest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return named.join(smallest, "root").select("doc_id", "node", "n", "component_id")


@register("op2_jaccard_join")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id")
