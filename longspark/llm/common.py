"""Helpers that several corpus operators share."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A frame of at most so many narrow rows (keys and a few numbers) may be broadcast.
BROADCAST_ROWS = 500_000

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    # plain instead of vectored reads: those keep direct buffers of a column chunk's size in every I/O thread
    return spark.read.option("parquet.hadoop.vectored.io.enabled", "false").parquet(f"{folder}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; other letters stay as they are."""
    return F.translate(text, UPPER, LOWER)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only where a count proves the bound; beyond it Spark shuffles.

    ``df`` should be a written frame: the count runs when this is called.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python in batches of 1,000 rows, for memory's sake; smaller settings stay."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= 1000:
        spark.conf.set(name, "1000")


def worker_cache(name: str, build: Callable[[], Any]) -> Any:
    """An object that a Python worker keeps from task to task; the two used last are kept."""
    holder = sys.modules.setdefault("_corpus_worker_cache", types.ModuleType("_corpus_worker_cache"))
    kept = holder.__dict__.setdefault("kept", {})
    kept[name] = kept.pop(name) if name in kept else build()
    while len(kept) > 2:
        del kept[next(iter(kept))]
    return kept[name]
