"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors' Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[2]
    archive = os.path.join(tempfile.mkdtemp(prefix="jointwork-"), "jointwork.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted((root / "jointwork").rglob("*.py")):
            out.write(file, file.relative_to(root))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def register(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
