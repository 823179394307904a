"""Benchmark decontamination over a positional inverted index.

1. Count how often the words of the benchmark occur in the documents.
2. Each window (``size`` consecutive item words; a shorter item is one window)
   is looked up by its RAREST positions in the item.  Only the postings
   (word, document, position) of those words are stored.
3. Postings, shifted by the offset of their word in the item, are intersected
   per document and item: documents that have all chosen words of a window in
   nearly the same shift (``SLOP`` diagonals) match in proximity.
4. Proximity matches are checked word by word, which gives exact phrases; the
   exact windows of a document are merged into hit words.

Null text has no words.  Items without words or without an id match nothing;
items with one id are one item.  Rows equal in doc_id and text are one
document; a null doc_id is kept.  Without documents there is no row; without
items nothing is hit.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from jointwork.llm.registry import register, table
from jointwork.llm.text_columns import GAP, LOWER, UPPER, ascii_lower, row_key, small, whole, words_of
from jointwork.sources.writers import stored

SIZE = 10
RAREST = 3
SLOP = 16
SMALL_ROWS = 1_000_000


def item_words(benchmark: DataFrame) -> DataFrame:
    return (
        benchmark.filter("item_id is not null")
        .select("item_id", row_key("item_id", "text").alias("item"), words_of(ascii_lower(whole())).alias("iw"))
        .distinct().withColumn("m", F.size("iw")).filter("m > 0")
    )


def word_counts(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Occurrences in the documents of each benchmark word (an estimate that only orders words: letter case is folded wholly)."""
    vocabulary = stored(items.select(F.explode("iw").alias("word")).distinct(), "vocabulary")
    words = docs.select(F.explode(F.split(F.lower(whole()), GAP)).alias("word"))
    return words.join(small(vocabulary, SMALL_ROWS), "word").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def window_anchors(items: DataFrame, counts: DataFrame, size: int, rarest: int) -> DataFrame:
    """Per item and window the positions of its rarest words."""
    placed = items.select("item", "m", F.posexplode("iw").alias("at", "word")).join(counts, "word", "left").fillna(0, ["n"])
    first = F.greatest(F.lit(0), F.col("at") - size + 1)
    last = F.least(F.col("at"), F.greatest(F.lit(0), F.col("m") - size))
    in_window = placed.select("item", "word", "at", "n", F.explode(F.sequence(first, last)).alias("window"))
    order = Window.partitionBy("item", "window").orderBy("n", "at")
    return in_window.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= rarest).drop("r", "n")


def postings(docs: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, k, word, pos, ...) of the given words, with positions from 0."""
    told = docs.select("doc_id", row_key("doc_id", "text").alias("k"), words_of(ascii_lower(whole())).alias("w"))
    return told.select("doc_id", "k", F.posexplode("w").alias("pos", "word")).join(small(words, SMALL_ROWS), "word")


def proximity(docs: DataFrame, items: DataFrame, size: int = SIZE, rarest: int = RAREST, slop: int = SLOP) -> DataFrame:
    """(doc_id, k, item, shifts): all chosen words of a window within a cell of ``slop`` shifts; ``shifts`` are the places where the item would begin."""
    anchors = stored(window_anchors(items, word_counts(docs, items), size, rarest), "anchors")
    places = stored(anchors.select("word", "item", "at").distinct(), "anchor-places")
    shifted = (
        postings(docs, places)
        .select("doc_id", "k", "item", "at", (F.col("pos") - F.col("at")).alias("shift"))
        .withColumn("cell", F.floor(F.col("shift") / slop))
    )
    needed = anchors.groupBy("item", "window").agg(F.sort_array(F.collect_set("at")).alias("need"))
    needed = needed.groupBy("item").agg(F.collect_set("need").alias("needs"), F.min(F.size("need")).alias("least"))
    met = shifted.groupBy("doc_id", "k", "item", "cell").agg(F.collect_set("at").alias("met"), F.collect_set("shift").alias("shifts"))
    return (
        met.join(small(stored(needed, "needed"), SMALL_ROWS), "item").filter(F.size("met") >= F.col("least"))
        .filter(F.exists("needs", lambda need: F.size(F.array_except(need, F.col("met"))) == 0))
        .select("doc_id", "k", "item", "shifts")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, rarest: int = RAREST, slop: int = SLOP) -> DataFrame:
    """Per document: words, hit words, items hit exactly and items met in proximity only."""
    items = stored(item_words(benchmark), "items")
    near = stored(proximity(docs, items, size, rarest, slop), "near")
    wanted = (
        near.join(items.select("item", "m"), "item").select("doc_id", "k", F.explode(F.transform("shifts", lambda s: F.struct(F.col("item"), F.col("m"), s.alias("shift")))).alias("c"))
        .groupBy("doc_id", "k").agg(F.collect_set("c").alias("cs"))
    )
    told = docs.select("doc_id", row_key("doc_id", "text").alias("k"), "text")
    wanted = small(stored(wanted, "wanted"), SMALL_ROWS).withColumnsRenamed({"doc_id": "_doc", "k": "_k"})
    found = told.join(wanted, (told["k"] == F.col("_k")) & told["doc_id"].eqNullSafe(F.col("_doc")), "left")
    cut = found.select("doc_id", "k", "cs", words_of(ascii_lower(whole())).alias("w")).select(
        "doc_id", "k", F.size("w").cast("long").alias("n_words"),
        F.explode_outer(F.transform("cs", lambda c: F.struct(
            c["item"].alias("item"), c["shift"].alias("shift"), F.greatest(F.lit(0), -c["shift"]).alias("skip"),
            F.slice(F.col("w"), F.greatest(F.lit(1), c["shift"] + 1), F.greatest(F.lit(0), c["m"] + F.least(F.lit(0), c["shift"]))).alias("dw"),
        ))).alias("c"),
    )
    length = F.least(F.lit(size), F.col("m"))
    here = F.slice("iw", F.col("c.skip") + 1, F.size("c.dw"))
    same = F.filter(
        F.sequence(F.lit(1), F.size("c.dw") - length + 1),
        lambda s: F.slice(F.col("c.dw"), s, length) == F.slice(here, s, length),
    )
    hits = (
        cut.withColumn("item", F.col("c.item")).join(small(items, SMALL_ROWS), "item", "left")
        .withColumn("starts", F.when(F.size("c.dw") >= length, same))
        .select("doc_id", "k", "n_words", "item_id", length.alias("len"), F.col("c.shift").alias("shift"), F.col("c.skip").alias("skip"), F.explode_outer("starts").alias("s"))
        .withColumn("begin", F.col("shift") + F.col("skip") + F.col("s") - 1).withColumn("end", F.col("begin") + F.col("len"))
    )
    before = Window.partitionBy("doc_id", "k").orderBy(F.col("begin").asc_nulls_first(), "end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.col("end") - F.greatest(F.col("begin"), F.coalesce(F.max("end").over(before), F.lit(0)))
    exact = F.when(F.col("s").isNotNull(), F.col("item_id").cast("string"))
    return (
        hits.withColumn("fresh", F.greatest(F.lit(0), F.coalesce(fresh, F.lit(0)))).groupBy("doc_id", "k")
        .agg(F.max("n_words").alias("n_words"), F.sum("fresh").cast("long").alias("n_hit"),
             F.sort_array(F.collect_set(exact)).alias("items"),
             F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("met"))
        .select("doc_id", "k", "n_words", "n_hit", "items", F.array_except("met", "items").alias("near_items"))
    )


SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
b1 AS (SELECT item_id, w, least(len(w), {SIZE}) AS l FROM b WHERE len(w) > 0),
b2 AS (SELECT item_id, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM b1),
win AS (SELECT DISTINCT item_id, l, list_slice(w, s, s + l - 1) AS g FROM b2),
d1 AS (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS p FROM d, (SELECT DISTINCT l FROM win) x WHERE len(w) >= l),
hit AS (SELECT DISTINCT doc_id, p, d1.l, item_id FROM d1 JOIN win ON d1.l = win.l AND list_slice(d1.w, d1.p, d1.p + d1.l - 1) = win.g),
words AS (SELECT doc_id, COUNT(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + l)) AS q FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, COUNT(*) AS n, string_agg(i, ',' ORDER BY i) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items.ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""


@register("op6_decontamination", SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
