"""From raw documents to packed training sequences.

Each stage takes what its predecessor kept, written as Parquet and read again,
and returns the columns of ``documents``; the last returns packed pieces.

    toxicity          documents that the network rejects go
    jaccard           of rows linked by Jaccard >= 0.8 that with the smallest doc_id stays
    decontamination   documents that hold a benchmark window go
    personal_data     spans are replaced by their kind in brackets
    packing           pieces with sequence and offset

In the jaccard stage rows without doc_id come after all others, different texts
under one doc_id are rows of their own, and of equal rows one stays.  An empty table stays empty through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from jointwork.llm import best_fit, decontamination, jaccard_join, personal_data, toxicity
from jointwork.llm.registry import ship, table
from jointwork.llm.text_columns import row_key, small
from jointwork.operators.skew import shared_dir
from jointwork.sources.writers import stored

DROPPED_ROWS = 1_000_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Decided row by row: a row is known by its doc_id and the hash of id and text, so texts under one id are told apart."""
    ship(spark)
    key = row_key("doc_id", "text")
    found = stored(jaccard_component_keys(docs.select(key.alias("doc_id"), "text")), "near-copies")
    rows = found.join(docs.select("doc_id", key.alias("k")).distinct(), "k")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k")
    stays = rows.groupBy("component_id").agg(F.min(order).alias("stays"), F.max(order).alias("last")).filter("stays <> last").select("component_id", "stays")
    gone = rows.join(stays, "component_id").filter(order != F.col("stays")).select(F.col("doc_id").alias("_doc"), F.col("k").alias("_k"))
    kept = docs.join(small(stored(gone, "gone"), DROPPED_ROWS), (key == F.col("_k")) & docs["doc_id"].eqNullSafe(F.col("_doc")), "left_anti")
    if found.filter("copies > 1").limit(1).count():
        kept = kept.withColumn("_k", key).dropDuplicates(["doc_id", "_k"]).drop("_k")
    return kept


def jaccard_component_keys(rows: DataFrame) -> DataFrame:
    """(k, component_id, copies) of the keys that stand for ids in ``rows``."""
    return jaccard_join.jaccard_components(rows).groupBy(F.col("doc_id").alias("k")).agg(F.min("component_id").alias("component_id"), F.count(F.lit(1)).alias("copies"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    hit = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark")).filter("n_hit > 0")
    gone = small(stored(hit.select(F.col("doc_id").alias("_doc"), F.col("k").alias("_k")), "contaminated"), DROPPED_ROWS)
    return docs.join(gone, (row_key("doc_id", "text") == F.col("_k")) & docs["doc_id"].eqNullSafe(F.col("_doc")), "left_anti")


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return personal_data.redact(docs, personal_data.find_spans(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ship(spark)
    return best_fit.best_fit(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("jaccard", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("personal_data", redact),
    ("packing", pack),
]

#: A network, an iteration and a tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
