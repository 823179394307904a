"""Toxicity: a small recurrent network over all overlapping windows of a text.

The network (``toxicity_model``) is fitted in numpy on a bounded sample of the
labelled documents: whole texts of the ``TRAIN_DOCS`` with the smallest hash
of their id, without the held-out third (crc32 of the id as text, modulo 3, is
1).  Labels, language, source and id are no inputs.  Scoring sees every word
of every document in windows of 16 words that overlap by half; the highest
window scores and the number of windows make the score.

Null and empty texts have one empty window and get a score too.  Rows are
scored one by one, so repeated rows and ids and null ids are kept as they are;
a document with several labels counts as toxic if one of them says so, null
labels are ignored.  Without labels of both kinds nothing can be learned: the
score is the share of toxic labels (0 without labels).  An empty table gives
no row.  Other columns are ignored, and ``keep_clean`` passes them through.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from jointwork.llm.registry import register, table
from jointwork.llm.remember import held
from jointwork.llm.token_ids import in_blocks
from jointwork.llm.toxicity_model import Model, train

TRAIN_DOCS = 3000
THRESHOLD = 0.7


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def training_sample(docs: DataFrame, labels: DataFrame, size: int = TRAIN_DOCS) -> tuple[list[str], list[int]]:
    """Texts and labels of at most ``size`` documents, in an order that depends on the ids only."""
    usable = (
        labels.filter("doc_id is not null and toxic is not null").filter(~held_out())
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    chosen = usable.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    # At most ``size`` rows are broadcast, and as many texts come to the driver.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return [r["text"] or "" for r in rows], [int(r["toxic"] > 0) for r in rows]


def fit(docs: DataFrame, labels: DataFrame, size: int = TRAIN_DOCS) -> Model | float:
    texts, toxic = training_sample(docs, labels, size)
    if min(toxic.count(0), toxic.count(1)) < 2:
        return sum(toxic) / len(toxic) if toxic else 0.0
    model = train(texts, toxic)
    del texts
    gc.collect()
    return model


def score(docs: DataFrame, model: Model | float, out: str = "score") -> DataFrame:
    """(doc_id, ``out``) for each row."""
    if not isinstance(model, Model):
        return docs.select("doc_id", F.lit(float(model)).alias(out))
    spark = docs.sparkSession
    sent, name = spark.sparkContext.broadcast(model.copy()), f"{spark.sparkContext.applicationId}-{id(model)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = held(name, sent.value.copy)  # remembered words serve later tasks of this worker
        for batch in batches:
            for rows in in_blocks(list(range(batch.num_rows))):
                part = batch.slice(rows[0], len(rows))
                values = net.score(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(values.astype(np.float64))], ["doc_id", out])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, {out} double")


def keep_clean(docs: DataFrame, model: Model | float, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below ``threshold``."""
    if not isinstance(model, Model):
        return docs if model < threshold else docs.limit(0)
    spark, columns = docs.sparkSession, docs.schema
    sent, name = spark.sparkContext.broadcast(model.copy()), f"{spark.sparkContext.applicationId}-{id(model)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = held(name, sent.value.copy)
        at = columns.names.index("text")
        for batch in batches:
            for rows in in_blocks(list(range(batch.num_rows))):
                part = batch.slice(rows[0], len(rows))
                yield part.filter(pa.array(net.score(part.column(at).to_pylist()) < threshold))

    return docs.mapInArrow(run, columns)


@register("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted")
    )
