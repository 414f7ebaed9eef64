"""Exact grouped quantiles with linear interpolation, safe for heavy groups.

The built-in exact percentile holds the distinct values of a group in one buffer. Groups whose
values fit are aggregated that way; a heavier group is ordered in chunks and only the two
neighbouring order statistics of each quantile are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longspark.operators.scan import Run, add_chunks, largest_group, running, same_keys

# Values of one group that an aggregation buffer may hold; a task holds many groups at once.
MAX_BUFFERED = 100_000


def quantiles(
    df: DataFrame,
    by: list[str],
    wanted: dict[str, tuple[str, float]],
    *,
    extra: list[Column] | None = None,
    max_rows: int = MAX_BUFFERED,
    group_bound: int | None = None,
) -> DataFrame:
    """One row per group: ``wanted`` maps a name to (column, probability); ``extra`` aggregates ride along.

    ``group_bound`` is a proven bound on the rows of a group; within ``max_rows`` it spares the
    job that sizes the groups.
    """
    extra = list(extra or [])
    keys = by or ["_all"]
    base = df if by else df.withColumn("_all", F.lit(0))
    largest = group_bound
    if largest is None:
        largest = largest_group(base, keys)
    if largest <= max_rows:
        exact = [F.percentile(c, F.lit(p)).alias(n) for n, (c, p) in wanted.items()]
        out = base.groupBy(*keys).agg(*exact, *extra)
        return out if by else out.drop("_all")

    out = base.groupBy(*keys).agg(*extra, F.count(F.lit(1)).alias("_n"))
    for column in dict.fromkeys(c for c, _ in wanted.values()):
        probs = {n: p for n, (c, p) in wanted.items() if c == column}
        part = _ordered(base, keys, column, probs, max_rows)
        condition = same_keys(out, part, keys, keys)
        names = [n for n in out.columns]
        out = out.join(part, condition, "left").select(
            *[out[n] for n in names], *[part[n] for n in probs]
        )
    out = out.drop("_n")
    return out if by else out.drop("_all")


def _ordered(
    df: DataFrame, keys: list[str], column: str, probs: dict[str, float], max_rows: int
) -> DataFrame:
    # equal values collapse into one counted row first, so a repeated value is never ordered
    counted = (
        df.where(F.col(column).isNotNull())
        .groupBy(*keys, F.col(column).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    cut, chunk = add_chunks(counted, keys, "_v", max_rows=max_rows)
    runs = {"_upto": Run("sum", F.col("_c")), "_after": Run("sum", F.col("_c"), inclusive=False, reverse=True)}
    placed = running(cut, keys, ["_v"], runs, chunk=chunk)
    total = F.col("_upto") + F.coalesce(F.col("_after"), F.lit(0))
    aggs = []
    for name, p in probs.items():
        spot = F.lit(p) * (total - 1)
        low, high = F.floor(spot), F.ceil(spot)

        def at(rank: Column) -> Column:
            inside = (F.col("_upto") - F.col("_c") <= rank) & (rank < F.col("_upto"))
            return F.max(F.when(inside, F.col("_v")))

        # the sum that the built-in percentile takes, so that both give the same bits
        between = F.max(high - spot) * at(low) + F.max(spot - low) * at(high)
        aggs.append(F.when(F.max(low) == F.max(high), at(low)).otherwise(between).alias(name))
    return placed.groupBy(*keys).agg(*aggs)
