"""A table as a log of changes, one folder per micro-batch.

A batch writes only its own folder and overwrites it when it is replayed, so
nothing is counted twice; a folder without its success file is not read.
``compact`` sums runs of batches into one folder: the newest folders are merged
while the older neighbour is not more than twice as large, so a change is
rewritten about log2(n) times and the log holds about log2(n) folders.  A
merged folder is used once it is whole; ``vacuum`` deletes what it replaces.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Merge = Callable[[DataFrame], DataFrame]
RUN = re.compile(r"run=(\d+)-(\d+)$")


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _found(spark: SparkSession, log: str) -> list[tuple[int, int, int]]:
    """(first batch, last batch, bytes) of all whole folders."""
    fs, path = _folder(spark, log)
    if not fs.exists(path):
        return []
    out = []
    for status in fs.listStatus(path):
        run = RUN.search(status.getPath().toString())
        if run and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            out.append((int(run[1]), int(run[2]), fs.getContentSummary(status.getPath()).getLength()))
    return sorted(out)


def live(spark: SparkSession, log: str) -> list[tuple[int, int, int]]:
    """The folders that make up the log: of overlapping ones the longest."""
    found = _found(spark, log)
    return [r for r in found if not any(o != r and o[0] <= r[0] and r[1] <= o[1] for o in found)]


def _path(log: str, first: int, last: int) -> str:
    return f"{log}/run={first}-{last}"


def write_batch(changes: DataFrame, log: str, batch_id: int) -> None:
    spark = changes.sparkSession
    if any(first <= batch_id <= last and first < last for first, last, _ in live(spark, log)):
        return  # merged before, so the batch was whole: this is a replay
    changes.write.mode("overwrite").parquet(_path(log, batch_id, batch_id))


def read_log(spark: SparkSession, log: str, schema: str) -> DataFrame:
    """All changes, not yet merged; no rows if there is no log."""
    paths = [_path(log, first, last) for first, last, _ in live(spark, log)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def compact(spark: SparkSession, log: str, schema: str, merge: Merge) -> int:
    """Merge the newest folders as described above; returns how many folders were merged."""
    runs = live(spark, log)
    take, size = 1, runs[-1][2] if runs else 0
    while take < len(runs) and runs[-take - 1][2] <= 2 * size:
        size += runs[-take - 1][2]
        take += 1
    if take == 1:
        return 0
    first, last = runs[-take][0], runs[-1][1]
    rows = spark.read.schema(schema).parquet(*[_path(log, a, b) for a, b, _ in runs[-take:]])
    merge(rows).write.mode("overwrite").parquet(_path(log, first, last))
    return take


def vacuum(spark: SparkSession, log: str) -> int:
    """Delete folders that a merged one has replaced; no reader of them must be running."""
    kept = live(spark, log)
    gone = [r for r in _found(spark, log) if r not in kept]
    for first, last, _ in gone:
        fs, path = _folder(spark, _path(log, first, last))
        fs.delete(path, True)
    return len(gone)
