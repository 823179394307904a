"""Resolve a unit and a metric in a question and answer from the rollup."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

# Scope words in the order they are looked for.
SCOPE_WORDS = ("within", "across", "intra", "inter", "all")


def unit_word(label: Column) -> Column:
    """The part of a label before its first comma, lower case."""
    return F.lower(F.trim(F.substring_index(label, ",", 1)))


def expand_alias(text: Column, aliases: Mapping[str, str]) -> Column:
    """Append the expansion of the first alias that occurs in the text."""
    extra = None
    for alias, full in aliases.items():
        hit = text.contains(alias)
        extra = F.when(hit, F.lit(" " + full)) if extra is None else extra.when(hit, F.lit(" " + full))
    return text if extra is None else F.concat(text, extra.otherwise(F.lit("")))


def question_scope(text: Column) -> Column:
    out = None
    for word in SCOPE_WORDS:
        out = F.when(text.contains(word), word) if out is None else out.when(text.contains(word), word)
    return out.otherwise("all")


def question_metric(text: Column) -> Column:
    return F.when(text.contains("partner"), "partners").when(text.contains("collab"), "collabs").otherwise("works")


def resolve_unit(questions: DataFrame, units: DataFrame, aliases: Mapping[str, str] | None = None, min_chars: int = 3) -> DataFrame:
    """Longest unit name contained in each question.

    "Contains" becomes an equi-join: every substring of the question with the
    length of some unit name is looked up by value.  The lengths are one
    short array, so neither side is compared with all of the other.
    """
    names = (
        units.withColumn("word", unit_word(F.col("label")))
        .filter(F.length("word") >= min_chars)
        .groupBy("word").agg(F.min("id").alias("unit_id"))
    )
    lengths = names.agg(F.collect_set(F.length("word")).alias("lens")).withColumn("one", F.lit(1))
    text = questions.select("qid", expand_alias(F.lower("question"), aliases or {}).alias("q"), F.lit(1).alias("one"))
    starts = F.sequence(F.lit(1), F.greatest(F.length("q") - F.col("len") + 1, F.lit(1)))
    # one row holding the few distinct name lengths
    pieces = text.join(F.broadcast(lengths), "one").select("qid", "q", F.explode("lens").alias("len")).filter(
        F.length("q") >= F.col("len")
    ).select("qid", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring(F.col("q"), i, F.col("len"))))).alias("word"))
    hits = pieces.join(names, "word")
    return hits.groupBy("qid").agg(
        F.min(F.struct((-F.length("word")).alias("n"), F.col("unit_id").alias("unit_id"), F.col("word").alias("word"))).alias("b")
    ).select("qid", "b.unit_id", "b.word")


def answer(questions: DataFrame, resolved: DataFrame, rollup: DataFrame, partners: DataFrame, n_partners: int = 3) -> DataFrame:
    """Value of the asked metric in the unit's kind (``unit_kind`` on all sides); pair counts exist for three scopes only."""
    q = F.lower("question")
    asked = questions.select("qid", question_scope(q).alias("scope"), question_metric(q).alias("metric"))
    names = partners.filter(F.col("rnk") <= n_partners).groupBy("unit_kind", F.col("unit").alias("unit_id")).agg(
        F.sort_array(F.collect_list(F.struct("rnk", "partner", "works"))).alias("p")
    )
    value = None
    for metric, scopes in (("works", SCOPE_WORDS), ("collabs", ("within", "across", "inter"))):
        for scope in scopes:
            hit = (F.col("metric") == metric) & (F.col("scope") == scope)
            col = F.col(f"{scope}_{metric}").cast("string")
            value = F.when(hit, col) if value is None else value.when(hit, col)
    listed = F.array_join(F.transform("p", lambda x: F.concat(x["partner"], F.lit(":"), x["works"].cast("string"))), ";")
    text = F.when(F.col("metric") == "partners", F.coalesce(listed, F.lit("none"))).otherwise(F.coalesce(value, F.lit("n/a")))
    return (
        asked.join(resolved, "qid")
        .join(rollup.withColumnRenamed("id", "unit_id"), ["unit_kind", "unit_id"], "left")
        .join(names, ["unit_kind", "unit_id"], "left")
        .select("qid", "unit_id", "unit_kind", "scope", "metric", text.alias("answer"))
    )
