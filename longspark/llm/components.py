"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longspark.session import materialize


def _with_least(pairs: DataFrame) -> DataFrame:
    """Add ``m``, the least of ``u`` and its partners ``v``.

    The least is combined before the shuffle and written, so that both sides of the join are plain
    scans whose exchange Spark can split where one ``u`` has very many partners.
    """
    least = materialize(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    return pairs.join(least, "u")


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """One row per node of ``edges`` with the least node of its component: (node, component).

    Nulls and loops are left out, repeated edges and either direction are fine; no edges give no
    rows. The number of rounds grows with the logarithm of the longest path.
    """
    edges = edges.select(F.col(left).alias("u"), F.col(right).alias("v"))
    edges = materialize(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    before = _mark(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u <> v").distinct())
        small = _with_least(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            small.select("u", F.col("m").alias("v"))
        )
        edges = materialize(small.where("u <> v").distinct())
        after = _mark(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
