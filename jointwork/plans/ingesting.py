"""Incremental ingest: streams over the given tables, compared with batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from jointwork.operators import counts as c
from jointwork.operators.skew import shared_dir
from jointwork.plans.registry import register
from jointwork.streaming import incremental as inc


def landing(t, df, name, files=6):
    """Land a table as several files so that the stream takes several batches."""
    path = shared_dir(t.spark, f"landing-{name}")
    df.repartition(files).write.mode("overwrite").parquet(path)
    return path


def stream(t, df, name):
    return inc.file_stream(t.spark, landing(t, df, name), df.schema, files_per_trigger=2)


@register("incremental_ingest", "SELECT l_orderkey AS wid, l_suppkey AS pid, l_linenumber FROM lineitem")
def _(t):
    src = t.read("lineitem").select(F.col("l_orderkey").alias("wid"), F.col("l_suppkey").alias("pid"), "l_linenumber")
    out, ckpt = shared_dir(t.spark, "ingested"), shared_dir(t.spark, "ckpt")
    inc.ingest(stream(t, src, "lines"), out, ckpt)
    return t.spark.read.schema(src.schema).parquet(out)


@register("incremental_first_seen", """SELECT wid, MIN(pub_year) AS pub_year, MIN(work_type) AS work_type, MIN(title) AS title FROM (
  SELECT w.* FROM fx_work_all w JOIN lineitem ON w.wid = l_orderkey) GROUP BY wid""")
def _(t):
    src = t.read("lineitem").select(F.col("l_orderkey").alias("wid")).join(t.work_all, "wid").select("wid", "pub_year", "work_type", "title")
    return first_seen(t, src, "works", "wid", ["pub_year", "work_type", "title"])


def first_seen(t, src, name, key, fields):
    store = shared_dir(t.spark, f"first-seen-{name}")
    arriving = stream(t, src, name)
    inc.first_seen(arriving, key, fields, store, shared_dir(t.spark, "ckpt"))
    return inc.read_first_seen(t.spark, store, key, fields, inc.first_seen_schema(arriving, key, fields))


@register("incremental_counts", "SELECT unit_kind, level, id, category, wid, pairs FROM fx_pairs WHERE unit_kind = 'Department' AND level = 'department'")
def _(t):
    store = shared_dir(t.spark, "changes")
    inc.count_members(stream(t, t.matches, "matches"), t.person, t.affil, store, shared_dir(t.spark, "ckpt"))
    return c.pairs_long(inc.read_cells(t.spark, store))


@register("anchor_split", """SELECT anchor, COUNT(*) AS n_rows, COUNT(DISTINCT wid) AS works FROM (
  SELECT concat('U', CAST(unit_id AS STRING)) AS anchor, wid FROM fx_intl
  UNION ALL SELECT concat('C', college), wid FROM fx_intl WHERE college IS NOT NULL) GROUP BY anchor""")
def _(t):
    store = shared_dir(t.spark, "anchors")
    rows = t.intl.select("wid", "pid", "unit_id", "college", "country")
    inc.each_batch(stream(t, rows, "intl"), shared_dir(t.spark, "ckpt"), inc.anchor_split_writer(store))
    back = t.spark.read.parquet(store)
    return back.groupBy("anchor").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("wid").alias("works"))


@register("incremental_events", """SELECT user_id, COUNT(DISTINCT event_type) AS n_types, COUNT(DISTINCT event_id) AS n_events,
CAST(MIN(year(ts)) AS INT) AS first_year FROM events GROUP BY user_id""")
def _(t):
    """The same log over the event table: (event, user) membership."""
    src = t.read("events").select("event_id", "user_id", "event_type", F.year("ts").alias("y"))
    seen = first_seen(t, src, "events", "event_id", ["user_id", "event_type", "y"])
    return seen.groupBy("user_id").agg(
        F.count_distinct("event_type").alias("n_types"), F.count(F.lit(1)).alias("n_events"), F.min("y").alias("first_year")
    )
