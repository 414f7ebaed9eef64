"""Collecting planned results and publishing derived tables."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longspark.operators.audit import content_hash
from longspark.operators.checks import check_unique
from longspark.schema import METRIC_KEY


def collect_metrics(rows: DataFrame, plan: DataFrame, *, cell: str = "cell_id") -> tuple[DataFrame, DataFrame]:
    """Metric rows of exactly the planned cells, in key order, and the findings against them.

    Findings: ``unplanned`` cells that have rows and ``duplicate`` metric keys. ``require_clean``
    turns findings into an error.
    """
    kept = rows.join(plan.select(cell), cell, "left_semi")
    unplanned = rows.join(plan.select(cell), cell, "left_anti").select(
        F.lit("unplanned").alias("finding"), F.col(cell).alias("subject")
    )
    key = [c for c in METRIC_KEY if c in rows.columns]
    twice = check_unique(kept, key).select(
        F.lit("duplicate").alias("finding"), F.concat_ws("|", *[F.col(c).cast("string") for c in key]).alias("subject")
    )
    return kept.orderBy(*key), unplanned.distinct().unionByName(twice)


def require_clean(findings: DataFrame) -> None:
    shown = findings.limit(5).collect()
    if shown:
        raise ValueError("; ".join(f"{r[0]}: {r[1]}" for r in shown))


def union_metrics(frames: list[DataFrame], order: list[str]) -> DataFrame:
    """Union of tables with differing columns, absent ones null, sorted."""
    if not frames:
        raise ValueError("nothing to union")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames).orderBy(*order)


#: Rows of a table that is written as one file at most.
SMALL_ROWS = 100_000


def _published(spark: SparkSession, root: str) -> DataFrame | None:
    """What has been published so far: (number, generation); None if nothing."""
    try:
        return spark.read.schema("number BIGINT, generation STRING").json(f"{root.rstrip('/')}/published")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _latest(spark: SparkSession, root: str):
    log = _published(spark, root)
    return None if log is None else log.orderBy(F.desc("number"), F.desc("generation")).first()


def publish_tables(tables: dict[str, DataFrame], root: str, generation: str) -> None:
    """Write all tables of one generation, then add it to the list of what is published.

    Readers take the entry with the highest number. Entries are only ever added, each by the commit of one
    file: at any time a reader finds the last generation or the one before, and all of it.
    """
    spark = next(iter(tables.values())).sparkSession
    base = f"{root.rstrip('/')}/generation={generation}"
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{base}/{name}")
    last = _latest(spark, root)
    entry = {"number": 0 if last is None else last.number + 1, "generation": generation, "tables": sorted(tables)}
    rows = spark.range(1).select(F.lit(json.dumps(entry)).alias("value"))
    rows.coalesce(1).write.mode("append").text(f"{root.rstrip('/')}/published")


def read_published(spark: SparkSession, root: str, name: str) -> DataFrame:
    last = _latest(spark, root)
    if last is None:
        raise ValueError(f"nothing is published in {root}")
    return spark.read.parquet(f"{root.rstrip('/')}/generation={last.generation}/{name}")


def write_once(df: DataFrame, path: str) -> bool:
    """Write a table that may never change: True when written, False when already there.

    The same content is accepted again; other content at the path is an error.
    """
    spark = df.sparkSession
    try:
        there = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        df.write.mode("errorifexists").parquet(path)
        return True
    if sorted(there.columns) != sorted(df.columns):
        raise ValueError(f"{path} holds a table with other columns")
    columns = sorted(df.columns)
    if content_hash(there, columns).first() != content_hash(df, columns).first():
        raise ValueError(f"{path} already holds other content")
    return False


def write_tables(df: DataFrame, path: str, order: list[str], *, small: bool = False) -> None:
    """A sorted table: one CSV file if ``small``, else sorted Parquet files.

    A table of more than ``SMALL_ROWS`` rows is not small: an error.
    """
    if small:
        if df.limit(SMALL_ROWS + 1).count() > SMALL_ROWS:
            raise ValueError(f"more than {SMALL_ROWS} rows for one file")
        df.orderBy(*order).coalesce(1).write.csv(path, header=True)
    else:
        df.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)
