"""Building blocks that keep hot groups spread over many tasks."""

from __future__ import annotations

import atexit
import itertools
import re
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

TILE = 256
CHUNK = 5000


def shared_base(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` or else the context's checkpoint folder.  A local
    temporary folder, removed at exit, serves only a ``local`` master; on a
    cluster without a shared folder this raises, as each executor would write
    to its own disk.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not re.match(r"local(\[[^\]]*\])?$", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _local:
        _local[sc.applicationId] = tempfile.mkdtemp(prefix="jointwork-")
        atexit.register(shutil.rmtree, _local[sc.applicationId], ignore_errors=True)
    return _local[sc.applicationId]


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate table in the shared folder."""
    path = f"{shared_base(spark)}/{name}-{spark.sparkContext.applicationId}-{next(_serial)}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def drop_intermediate(spark: SparkSession) -> int:
    """Delete this application's intermediate tables; call it when results are written."""
    paths = _made.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    return len(paths)


_local: dict[str, str] = {}
_made: dict[str, list[str]] = {}
_serial = itertools.count(1)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_base(df.sparkSession))
    return df.checkpoint()


def by_work(df: DataFrame) -> DataFrame:
    """A side of a join that has rows for every work: it meets the other by sort and merge, never by broadcast.

    The planner goes by the size of compressed files and of the columns left,
    which says little about the rows: some ten megabytes of Parquet would be
    sent to the driver as millions of them.
    """
    return df.hint("merge")


def pair_up(
    rows: DataFrame,
    group: str | list[str],
    ident: str,
    size: str,
    ordered: bool = False,
    focal: Column | None = None,
    tile: int = TILE,
    partner: Column | None = None,
) -> DataFrame:
    """All pairs of rows that share ``group``, both sides renamed ``_l`` / ``_r``.

    ``size`` holds the number of rows of the group (members carry it from
    ingest), so no counting pass is needed.  A group of at most ``tile`` rows
    is gathered by one shuffle and paired where it lies, so its pairs stay
    together by ``group`` and later groupings that include it need no shuffle.
    A larger one is cut into t tiles by the hash of ``ident`` and its pairs
    become t*t join keys: each key meets at most about tile*tile pairs, so a
    work with very many people is spread over many tasks and none of its pairs
    is dropped.
    """
    keys = [group] if isinstance(group, str) else group
    cols = [c for c in rows.columns if c not in (*keys, size)]
    few = F.coalesce(F.col(size) <= tile, F.lit(True))
    order = (
        F.col(ident + "_l") != F.col(ident + "_r")
        if ordered
        else F.col(ident + "_l") < F.col(ident + "_r")
    )
    small, large = rows.filter(few), rows.filter(~few)
    return _pairs_in_place(small, keys, cols, focal, partner).filter(order).unionByName(
        _pairs_by_tile(large, keys, cols, ident, size, focal, tile, partner).filter(order)
    )


def _pairs_in_place(rows: DataFrame, keys: list[str], cols: list[str], focal: Column | None, partner: Column | None) -> DataFrame:
    """Pairs of groups that are known to be short: one array per group, unfolded on both sides."""
    flags = {"_left": focal, "_right": partner}
    entry = F.struct(*cols, *[cond.alias(name) for name, cond in flags.items() if cond is not None])
    met = rows.groupBy(*keys).agg(F.collect_list(entry).alias("_all"))
    side = lambda name: F.col("_all") if flags[name] is None else F.filter("_all", lambda x: x[name])
    one = met.select(*keys, F.explode(side("_left")).alias("_l"), "_all")
    two = one.select(*keys, "_l", F.explode(side("_right")).alias("_r"))
    return two.select(*keys, *[F.col(f"_l.{c}").alias(c + "_l") for c in cols], *[F.col(f"_r.{c}").alias(c + "_r") for c in cols])


def _pairs_by_tile(
    rows: DataFrame, keys: list[str], cols: list[str], ident: str, size: str, focal: Column | None, tile: int, partner: Column | None
) -> DataFrame:
    t = F.greatest(F.ceil(F.col(size) / F.lit(float(tile))), F.lit(1)).cast("int")
    mine = F.pmod(F.xxhash64(F.col(ident)), t).cast("int")
    every = F.explode(F.sequence(F.lit(0), t - 1))

    def side(frame, suffix, own, other):
        return frame.select(
            F.struct(*keys).alias("_g"),
            *[F.col(c).alias(c + suffix) for c in cols],
            mine.alias(own),
            every.alias(other),
        )

    lhs = side(rows if focal is None else rows.filter(focal), "_l", "_tl", "_tr")
    rhs = side(rows if partner is None else rows.filter(partner), "_r", "_tr", "_tl")
    return lhs.join(by_work(rhs), ["_g", "_tl", "_tr"]).select("_g.*", *[c + "_l" for c in cols], *[c + "_r" for c in cols])


def chunk_no(ident: Column, size: Column, chunk: int = CHUNK) -> Column:
    """Chunk number of a row so that a group of ``size`` rows is split evenly.

    md5 is used because every engine computes it the same way, which keeps
    the split reproducible outside Spark.
    """
    parts = F.greatest(F.ceil(size / F.lit(float(chunk))), F.lit(1)).cast("bigint")
    digest = F.conv(F.substring(F.md5(ident.cast("string")), 1, 8), 16, 10).cast("bigint")
    # A group of one part needs no digest: most groups are that small, and md5 costs more than the rest.
    return F.when((parts == 1) & ident.isNotNull(), F.lit(0).cast("bigint")).otherwise(F.pmod(digest, parts).cast("bigint"))


def dense_index(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """0-based dense position in a global order, without a one-task sort.

    Rows are range-partitioned and sorted inside each partition; only the row
    count per partition (one small row per task) is accumulated and sent back
    to the tasks.  The ranged
    rows are checkpointed because the range bounds are sampled: reading them
    twice must not produce two different partitionings.
    """
    ranged = cut_lineage(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_mid", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_mid", 33))
        .withColumn("_pos", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_mid")
    )
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (
        ranged.join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_offset") + F.col("_pos")).cast("bigint"))
        .drop("_part", "_pos", "_offset")
    )
