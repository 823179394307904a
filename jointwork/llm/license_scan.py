"""License scan: ordered signature rules behind a keyword prefilter.

Words are looked at with A-Z lower-cased and joined by single spaces.  A
document meets a rule's regular expression only if it holds the rule's
keyword as a word, so most documents meet none.  Overlapping detections are
resolved by priority and containment: a detection inside another one of the
same or a higher priority goes; of detections of the same words the earlier
rule stays.  The base phrases are always reported.

Null text has no words: counts 0, places null, labels empty, score 0.  Rows
equal in doc_id and text are one row; a null doc_id is kept.  An empty table
gives no row.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from jointwork.llm.license_rules import BASE, Rule, rules
from jointwork.llm.registry import register, table
from jointwork.llm.text_columns import GAP, all_matches, positions, row_key, whole
from jointwork.sources.writers import stored

TABLE = "rule int, label string, keyword string, pattern string, priority int, score double"


def rule_table(spark: SparkSession, ordered: list[Rule]) -> DataFrame:
    """Base phrases have priority 9 and come first."""
    rows = [(i, label, key, rf"(?<= ){phrase}(?= )", 9, 1.0) for i, (label, key, phrase) in enumerate(BASE)]
    rows += [(i, r.label, r.keyword, r.pattern, r.priority, r.score) for i, r in enumerate(ordered, len(rows))]
    return spark.createDataFrame(rows, TABLE)


def _lowered() -> Column:
    """Folds all letters: no rule and no word boundary can tell the difference to folding A-Z."""
    return F.lower(whole())


def gated(docs: DataFrame, keywords: list[str]) -> DataFrame:
    """(doc_id, k, n_words, words): the words joined by spaces where one of them is a keyword, else null."""
    words = docs.select("doc_id", row_key("doc_id", "text").alias("k"), F.array_remove(F.split(_lowered(), GAP), "").alias("w"))
    joined = F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" "))
    return words.select(
        "doc_id", "k", F.size("w").cast("long").alias("n_words"),
        F.when(F.arrays_overlap("w", F.array(*[F.lit(key) for key in keywords])), joined).alias("words"),
    )


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def detections(some: DataFrame, table: DataFrame, keywords: list[str]) -> DataFrame:
    """(doc_id, k, rule, label, priority, score, first, last): places in words, before suppression."""
    held = F.array_compact(F.array(*[F.when(F.contains("words", F.lit(f" {key} ")), F.lit(key)) for key in keywords]))
    tried = (
        some.filter("words is not null").select("doc_id", "k", "words", F.explode(held).alias("keyword"))
        .join(F.broadcast(table), "keyword")  # a few hundred rules
        .filter(F.rlike("words", F.col("pattern")))
        .select("doc_id", "k", "rule", "label", "priority", "score", all_matches(F.col("words"), F.col("pattern")).alias("found"))
    )
    placed = positions(tried.repartition("k").dropDuplicates(["doc_id", "k", "rule"]), "found", ["k", "rule"], _spaces)
    return placed.select(
        "doc_id", "k", "rule", "label", "priority", "score", (F.col("start") - 1).alias("first"), (F.col("end") - 1).alias("last")
    )


def suppress(found: DataFrame) -> DataFrame:
    """Keep base phrases and detections that lie in no other one of their priority or a higher one.

    In order of (first, longest first, priority, rule) whatever contains a
    detection comes before it, so running ends per priority decide; no pairs.
    """
    order = Window.partitionBy("k").orderBy("first", F.desc("last"), F.desc("priority"), "rule").rowsBetween(Window.unboundedPreceding, -1)
    levels = [1, 2, 3, 4, 5]
    reach = F.coalesce(*[F.when(F.col("priority") == p, F.max(F.when(F.col("priority").between(p, 5), F.col("last"))).over(order)) for p in levels])
    return found.withColumn("_reach", reach).filter((F.col("priority") == 9) | F.col("_reach").isNull() | (F.col("_reach") < F.col("last"))).drop("_reach")


def scan(docs: DataFrame, ordered: list[Rule] | None = None) -> DataFrame:
    spark, ordered = docs.sparkSession, rules() if ordered is None else ordered
    keywords = sorted({key for _, key, _ in BASE} | {r.keyword for r in ordered})
    some = stored(gated(docs, keywords), "gated")
    kept = suppress(detections(some, rule_table(spark, ordered), keywords))
    base = F.col("priority") == 9
    each = kept.groupBy("doc_id", "k").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("first"))).alias("first_word"), F.max(F.when(base, F.col("first"))).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
        F.max("score").alias("score"), F.count(F.when(~base, 1)).alias("n_rules"),
    )
    counted = some.select("doc_id", "k", "n_words").distinct()
    each = each.withColumnsRenamed({"doc_id": "_doc", "k": "_k"})
    return (
        counted.join(each, (counted["k"] == each["_k"]) & counted["doc_id"].eqNullSafe(each["_doc"]), "left").drop("k", "_k", "_doc")
        .fillna({"n_base": 0, "n_rules": 0, "base_labels": "", "labels": "", "score": 0.0})
    )


@register("op1_license_scan")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
