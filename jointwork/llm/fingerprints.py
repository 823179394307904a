"""I-Match fingerprints over randomised lexicon subsets.

The lexicon holds the words whose document frequency lies in a band (as a
share of all documents, and at least two documents).  A text's distinct
lexicon words are sorted and hashed once for each of many random subsets of
the lexicon.  Subsets of different size are used: the large ones agree for
copies only, the small ones still agree when part of a text has changed, so
the share of agreeing subsets grades the likeness of two texts.

A text without any lexicon word is fingerprinted by a hash of all of it.
Null text counts as empty.  Rows equal in doc_id and text are one row; a null
doc_id sorts first.  An empty table gives no row; a single document is its own
next one.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from jointwork.llm.registry import register, table
from jointwork.llm.text_columns import GAP, row_key, small, whole
from jointwork.operators.skew import dense_index
from jointwork.sources.writers import stored

BAND = (1 / 5000, 1 / 20)
#: One lexicon subset per entry; a word is in it with chance 1 / entry.
SUBSETS = [2] * 2 + [16] * 6 + [64] * 16 + [256] * 24
#: Lexicons up to this size are broadcast.  A word of the band is in N / 5000 documents at least, so there are
#: at most 5000 times as many words as a document has on average; larger lexicons are joined by shuffle.
LEXICON_ROWS = 2_000_000
NO_WORD = 0
#: The first subsets are large; words of the others only are kept in a list of their own, which is much shorter.
LARGE = sum(n < 64 for n in SUBSETS)
#: What Spark's hash gives for an empty list: the subset has no word of the text.
EMPTY = 42


def terms_of(text: Column) -> Column:
    return F.array_distinct(F.split(F.lower(text), GAP))


def lexicon(docs: DataFrame, band: tuple[float, float] = BAND, subsets: list[int] = SUBSETS) -> DataFrame:
    """(h, mask): hashes of the words of the band, with a bit per subset that holds the word."""
    total = docs.count()
    counts = docs.select(F.explode(terms_of(whole())).alias("word")).filter("word <> ''").select(F.xxhash64("word").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    inside = counts.filter((F.col("df") >= max(2, band[0] * total)) & (F.col("df") <= max(2, band[1] * total)))
    bits = [F.when(F.pmod(F.xxhash64("h", F.lit(j)), F.lit(n)) == 0, F.lit(1 << j)).otherwise(F.lit(0)) for j, n in enumerate(subsets)]
    mask = bits[0].cast("long")
    for bit in bits[1:]:
        mask = mask.bitwiseOR(bit.cast("long"))
    return inside.select("h", mask.alias("mask"))


def neighbours(docs: DataFrame) -> DataFrame:
    """(k, doc_id, previous_k, need, next_k): ``need`` characters of this document go to the one before it."""
    ids = stored(docs.select("doc_id", row_key("doc_id", "text").alias("k"), F.length(whole()).cast("long").alias("n")).distinct(), "ids")
    total = ids.count()
    ranked = stored(dense_index(ids, ["doc_id", "k"], "rank"), "ranked")
    step = lambda by: F.pmod(F.col("rank") + by, F.lit(max(1, total)))
    earlier = ranked.select(step(1).alias("rank"), F.col("k").alias("previous_k"), F.floor(F.col("n") / 2).cast("int").alias("need"))
    later = ranked.select(step(-1).alias("rank"), F.col("k").alias("next_k"))
    return ranked.join(earlier, "rank").join(later, "rank").select("k", "doc_id", "previous_k", "need", "next_k")


def edited_pairs(docs: DataFrame, around: DataFrame) -> DataFrame:
    """(k, doc_id, text, edited): texts move once whole and once by half.

    Both uses of ``own`` read the same columns, so that Spark shuffles it once.
    """
    own = docs.select(row_key("doc_id", "text").alias("k"), whole().alias("text"))
    heads = own.join(around.select("k", "previous_k", "need"), "k").select(
        F.col("previous_k").alias("k"), F.substring(F.col("text"), F.lit(1), F.col("need")).alias("head")
    )
    kept = F.length("text") - F.floor(F.length("text") / 2).cast("int")
    both = own.join(around.select("k", "doc_id"), "k").join(heads, "k")
    return both.select("k", "doc_id", "text", F.concat(F.substring(F.col("text"), F.lit(1), kept), F.col("head")).alias("edited"))


def subset_hashes(large: Column, small_: Column, n: int) -> Column:
    """Per subset the hash of its sorted words, ``EMPTY`` where there are none.

    Expressions in a lambda are evaluated each time, so each list is walked
    once per subset and only the few words found are sorted.
    """
    def one(terms: Column):
        return lambda j: F.xxhash64(F.sort_array(F.transform(F.filter(terms, lambda t: F.getbit(t["mask"], j) == 1), lambda t: t["h"]))).bitwiseAND(F.lit(0xFFFFFFFF))

    return F.concat(F.transform(F.sequence(F.lit(0), F.lit(LARGE - 1)), one(large)), F.transform(F.sequence(F.lit(LARGE), F.lit(n - 1)), one(small_)))


def fingerprints(texts: DataFrame, words: DataFrame, n_subsets: int = len(SUBSETS)) -> DataFrame:
    """``texts`` (k, which, text, info) -> (k, which, info, whole, hashes).

    Each text gives one row without a word, which carries its columns, so a
    text without lexicon words stays, and the word rows stay narrow.
    """
    info = F.struct("info", F.xxhash64("text").alias("whole"))
    empty = F.lit(None).cast(texts.select(info.alias("i")).schema["i"].dataType)
    first = F.array(F.struct(F.lit(NO_WORD).cast("long").alias("h"), info.alias("i")))
    rows = texts.select("k", "which", F.explode(F.concat(first, F.transform(terms_of(F.col("text")), lambda w: F.struct(F.xxhash64(w).alias("h"), empty.alias("i"))))).alias("t"))
    marked = words.unionByName(words.sparkSession.createDataFrame([(NO_WORD, 0)], "h long, mask long"))
    met = rows.select("k", "which", "t.h", "t.i").join(small(stored(marked, "lexicon"), LEXICON_ROWS), "h")
    has = lambda bits: F.collect_set(F.when(F.col("mask").bitwiseAND(F.lit(bits)) != 0, F.struct("h", "mask")))
    low = (1 << LARGE) - 1
    grouped = met.groupBy("k", "which").agg(has(low).alias("large"), has((1 << n_subsets) - 1 - low).alias("small"), F.max("i").alias("i"))
    return grouped.select("k", "which", "i.info", "i.whole", subset_hashes(F.col("large"), F.col("small"), n_subsets).alias("hashes"))


def as_text(hashes: Column, whole_hash: Column) -> Column:
    shown = F.transform(hashes, lambda h: F.when(h == EMPTY, F.lit("-")).otherwise(F.lower(F.lpad(F.hex(h), 8, "0"))))
    any_word = F.exists(hashes, lambda h: h != EMPTY)
    return F.when(any_word, F.array_join(shown, ".")).otherwise(F.concat(F.lit("text-"), F.lower(F.hex(whole_hash))))


def likeness(a: Column, b: Column, whole_a: Column, whole_b: Column) -> Column:
    """Share of subsets with words in either text whose hashes agree; 1 for equal texts."""
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    either = F.size(F.filter(pairs, lambda p: (p["a"] != EMPTY) | (p["b"] != EMPTY)))
    agree = F.size(F.filter(pairs, lambda p: (p["a"] == p["b"]) & (p["a"] != EMPTY)))
    return F.when(whole_a == whole_b, F.lit(1.0)).when(either > 0, agree / either).otherwise(F.lit(0.0))


@register("op7_fingerprints")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    around = stored(neighbours(docs), "neighbours")
    both = edited_pairs(docs, around)
    texts = both.select("k", "doc_id", F.explode(F.array(
        F.struct(F.lit(0).alias("which"), F.col("text")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("text"))
    )).alias("t")).select(
        "k", "t.which", "t.text",
        F.struct("doc_id", F.length("t.text").cast("long").alias("n"), F.when(F.col("t.which") == 1, F.sha2(F.col("t.text"), 256)).alias("sha")).alias("info"),
    )
    found = stored(fingerprints(texts, lexicon(docs)), "fingerprints")
    own = found.filter("which = 0").select("k", "info.doc_id", F.col("info.n").alias("n_chars"), "hashes", "whole")
    edited = found.filter("which = 1").select("k", F.col("info.sha").alias("edited_sha256"), F.col("hashes").alias("e_hashes"), F.col("whole").alias("e_whole"))
    following = own.select(F.col("k").alias("next_k"), F.col("hashes").alias("n_hashes"), F.col("whole").alias("n_whole"))
    return own.join(edited, "k").join(around.select("k", "next_k"), "k").join(following, "next_k").select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("hashes"), F.col("whole")).alias("fingerprint"),
        as_text(F.col("e_hashes"), F.col("e_whole")).alias("edited_fingerprint"),
        likeness(F.col("hashes"), F.col("e_hashes"), F.col("whole"), F.col("e_whole")).alias("near_edited"),
        likeness(F.col("hashes"), F.col("n_hashes"), F.col("whole"), F.col("n_whole")).alias("near_next"),
    )
