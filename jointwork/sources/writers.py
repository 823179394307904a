"""Writers: columnar store, per-anchor files, long CSV, quoted downloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from jointwork.operators.skew import shared_dir


def write_by(df: DataFrame, path: str, by: str, fmt: str = "parquet", mode: str = "overwrite", **options) -> None:
    """One folder per value of ``by``.

    The rebalance hint groups rows by value so that few files are written,
    and lets AQE split a value that is far larger than the others.
    """
    df.hint("rebalance", by).write.mode(mode).options(**options).partitionBy(by).format(fmt).save(path)


def anchor_index(written: DataFrame, anchors: DataFrame) -> DataFrame:
    """Which anchors were written: key, label, kind, unit type and id, folder, rows.

    ``anchors`` as ``anchor_list`` gives them; ``written`` is the table read back.
    """
    n = written.groupBy(F.col("anchor").alias("key")).agg(F.count(F.lit(1)).alias("n_rows"))
    return n.join(anchors, "key").select("key", "label", "kind", "unit_type", "unit_id", F.concat(F.lit("anchor="), "key").alias("file"), "n_rows")


def write_csv(df: DataFrame, path: str, encoding: str = "UTF-8", compression: str = "none") -> None:
    """Quoted CSV with a header; readers know ``compression`` by the files' ending."""
    out = df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("encoding", encoding)
    out.option("compression", compression).csv(path)


def write_download(df: DataFrame, path: str) -> None:
    """Every field quoted, quotes doubled."""
    (
        df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("quote", '"').option("escape", '"')
        .csv(path)
    )


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write once as Parquet in the shared folder and read back.

    Used where a result is read several times: it survives lost executors,
    keeps column pruning and gives later joins real sizes to plan with.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
