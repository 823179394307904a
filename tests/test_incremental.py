"""Streams against batch results: replays, crashes, flat cost per batch, bounded logs."""

import pytest
from pyspark.sql import functions as F

from jointwork.operators import counts as c
from jointwork.plans.fixture import Tables
from jointwork.streaming import delta_log, incremental as inc

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_log_merges_geometrically_and_survives_half_written_folders(spark, tmp_path):
    log, schema = str(tmp_path / "log"), "k bigint, n bigint"
    merge = lambda df: df.groupBy("k").agg(F.sum("n").alias("n"))
    assert delta_log.read_log(spark, log, schema).count() == 0 and delta_log.compact(spark, log, schema, merge) == 0
    most = 0
    for b in range(12):
        delta_log.write_batch(spark.range(40).select(F.col("id").alias("k"), F.lit(1).cast("bigint").alias("n")), log, b)
        delta_log.compact(spark, log, schema, merge)
        most = max(most, len(delta_log.live(spark, log)))
    assert most <= 4
    assert {r["n"] for r in merge(delta_log.read_log(spark, log, schema)).collect()} == {12}
    delta_log.write_batch(spark.range(40).selectExpr("id AS k", "7L AS n"), log, 3)  # the replay of a batch that was merged
    assert {r["n"] for r in merge(delta_log.read_log(spark, log, schema)).collect()} == {12}
    spark.range(9).selectExpr("id AS k", "1L AS n").write.parquet(f"{log}/run=12-12")
    (tmp_path / "log" / "run=12-12" / "_SUCCESS").unlink()  # a crash while the batch was written
    assert {r["n"] for r in merge(delta_log.read_log(spark, log, schema)).collect()} == {12}
    delta_log.write_batch(spark.range(9).selectExpr("id AS k", "1L AS n"), log, 12)
    assert delta_log.vacuum(spark, log) > 0
    assert sum(r["n"] for r in delta_log.read_log(spark, log, schema).collect()) == 12 * 40 + 9


def test_counts_equal_batch_after_a_crash(spark, tmp_path, monkeypatch):
    """The third batch fails after its changes were written; the restart replays it."""
    t = Tables(spark, SF)
    src, store, ckpt = (str(tmp_path / n) for n in ("src", "log", "ck"))
    # Repeated rows, within a batch and across batches, and unknown people.
    t.matches.union(t.matches.limit(500)).union(spark.range(5).selectExpr("id AS wid", "999999L AS pid")).repartition(6).write.parquet(src)
    arriving = lambda: inc.file_stream(spark, src, t.matches.schema, files_per_trigger=1)
    write = delta_log.write_batch

    def fails_once(changes, log, batch_id):
        write(changes, log, batch_id)
        if batch_id == 2:
            raise RuntimeError("lost")

    monkeypatch.setattr(delta_log, "write_batch", fails_once)
    with pytest.raises(Exception, match="lost"):
        inc.count_members(arriving(), t.person, t.affil, store, ckpt)
    monkeypatch.setattr(delta_log, "write_batch", write)
    inc.count_members(arriving(), t.person, t.affil, store, ckpt)
    want = rows(c.unit_pairs(t.member, t.affil, "Department", "department"))
    assert rows(c.pairs_long(inc.read_cells(spark, store))) == want
    again = inc.count_members(arriving(), t.person, t.affil, store, ckpt)  # nothing new
    assert sum(p["numInputRows"] for p in again) == 0 and rows(c.pairs_long(inc.read_cells(spark, store))) == want


def test_a_batch_costs_as_much_late_as_early(spark, tmp_path):
    """Equal batches read equal input, write equal changes and look up equally many keys, whatever went before."""
    t = Tables(spark, SF)
    src, store, ckpt = (str(tmp_path / n) for n in ("src", "log", "ck"))
    people = t.person.select("pid")
    for b in range(5):  # works of their own in each file
        spark.range(b * 200, b * 200 + 200).withColumnRenamed("id", "wid").crossJoin(people).coalesce(1).write.mode("append").parquet(src)
    sizes = []
    schema = "wid bigint, pid bigint"
    progress = []
    handle = delta_log.write_batch

    def measured(changes, log, batch_id):
        handle(changes, log, batch_id)
        sizes.append(delta_log._found(spark, log)[-1][2])

    delta_log.write_batch = measured
    try:
        progress = inc.count_members(inc.file_stream(spark, src, spark.createDataFrame([], schema).schema, 1), t.person, t.affil, store, ckpt)
    finally:
        delta_log.write_batch = handle
    full = [p for p in progress if p["numInputRows"]]
    assert len(full) == 5 and len({p["numInputRows"] for p in full}) == 1
    assert len({p["stateOperators"][0]["numRowsUpdated"] for p in full}) == 1
    assert max(sizes) <= 1.2 * min(sizes)
    assert len(delta_log.live(spark, store)) <= 2


def test_first_seen_restarts_and_logs_only_changes(spark, tmp_path):
    src, store, ckpt = (str(tmp_path / n) for n in ("src", "log", "ck"))
    schema = "k bigint, y int, name string"
    batches = [[(1, 5, "b"), (2, 3, None), (2, 4, "x")], [(1, 7, "c"), (1, 4, "z"), (3, 1, "q")], [(2, 9, "y"), (1, 5, "b")], [(None, 1, "n"), (3, 1, "a")]]
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        arriving = inc.file_stream(spark, src, spark.createDataFrame([], schema).schema, 1)
        inc.first_seen(arriving, "k", ["y", "name"], store, ckpt)
        seen = [r for b in batches[: i + 1] for r in b]
        want = [(k, min(y for q, y, _ in seen if q == k), min((n for q, _, n in seen if q == k and n is not None), default=None)) for k in {r[0] for r in seen}]
        assert rows(inc.read_first_seen(spark, store, "k", ["y", "name"], schema)) == sorted(want, key=str)
    assert len(delta_log.live(spark, store)) <= 3
