"""Incremental ingest with Structured Streaming.

What was seen before is Spark's own keyed state, kept in RocksDB and the
checkpoint; a batch looks up the keys it holds and reads nothing else, so its
cost does not grow with the history.  Results are logs of changes
(``delta_log``): a batch writes what it changed under its id, a replay
overwrites it, readers merge changes with associative aggregates, and
``compact`` keeps the log short.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from jointwork.functions.text import college_anchor, unit_anchor_key
from jointwork.operators.counts import cells_of, work_changes
from jointwork.streaming import delta_log

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 4, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(path)


def drain(query) -> None:
    """Wait until everything available has been processed."""
    query.awaitTermination()


def ingest(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Append new files exactly once; the checkpoint replaces byte offsets."""
    drain(
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def each_batch(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], mode: str = "append") -> list[dict]:
    """Run ``handle`` on everything available; the progress reports of the batches are returned.

    State is kept in RocksDB, so it may be larger than an executor's memory.
    """
    spark, key = stream.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKSDB)
    try:
        query = stream.writeStream.foreachBatch(handle).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        drain(query)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return list(query.recentProgress)


# ------------------------------------------------------------------- first seen


def first_seen_schema(stream: DataFrame, key: str, fields: list[str]) -> str:
    return ", ".join(f"`{f}` {stream.schema[f].dataType.simpleString()}" for f in [key, *fields])


def _smallest(key: str, fields: list[str]):
    return lambda rows: rows.groupBy(key).agg(*[F.min(f).alias(f) for f in fields])


def first_seen(stream: DataFrame, key: str, fields: list[str], store: str, checkpoint: str) -> list[dict]:
    """Keep the smallest value of each field per key as rows arrive.

    The running minimum per key is Spark's state; only keys that are new or
    whose minimum changed in a batch are written to the log.
    """
    merge, schema = _smallest(key, fields), first_seen_schema(stream, key, fields)

    def handle(batch: DataFrame, batch_id: int) -> None:
        delta_log.write_batch(batch, store, batch_id)

    progress = each_batch(merge(stream), checkpoint, handle, "update")
    delta_log.compact(stream.sparkSession, store, schema, merge)
    return progress


def read_first_seen(spark: SparkSession, store: str, key: str, fields: list[str], schema: str) -> DataFrame:
    return _smallest(key, fields)(delta_log.read_log(spark, store, schema))


# ------------------------------------------------------------------- counts

CHANGES = "wid bigint, unit_kind string, level string, id string, n bigint"


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("wid", "unit_kind", "level", "id").agg(F.sum("n").alias("n"))


def count_members(stream: DataFrame, person: DataFrame, affil: DataFrame, store: str, checkpoint: str, kind: str = "Department", level: str = "department") -> list[dict]:
    """Maintain the counts of every work from a stream of (wid, pid), repeats included.

    Which (work, person) rows are known is Spark's state (``dropDuplicates``);
    what is new in a batch changes the counts of its works by sums, so no work
    is counted again and no former batch is read.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        delta_log.write_batch(work_changes(batch, affil, kind, level), store, batch_id)

    # Unknown people never enter the state, as in the membership of a batch.
    new = stream.select("wid", "pid").join(person.select("pid", "is_ext"), "pid").dropDuplicates(["wid", "pid"])
    progress = each_batch(new, checkpoint, handle)
    delta_log.compact(stream.sparkSession, store, CHANGES, _summed)
    return progress


def read_cells(spark: SparkSession, store: str) -> DataFrame:
    """Current cells of works with company, as ``work_cells`` gives them."""
    return cells_of(_summed(delta_log.read_log(spark, store, CHANGES)))


def _batch_path(store: str, batch_id: int) -> str:
    return f"{store}/batch={batch_id}"


def anchor_split_writer(store: str) -> Callable[[DataFrame, int], None]:
    """Fan every row out to its unit and college folders.

    ``rebalance`` keeps the number of files low and splits a hot anchor.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        keys = F.filter(
            F.array(unit_anchor_key(F.col("unit_id")), college_anchor(F.col("college"))), lambda k: k.isNotNull()
        )
        (
            batch.withColumn("anchor", F.explode(keys)).hint("rebalance", "anchor")
            .write.mode("overwrite").partitionBy("anchor").parquet(_batch_path(store, batch_id))
        )

    return handle
