"""Running aggregates that survive a heavy key.

A window puts all rows of one key in one task. Here a key may be cut into consecutive
chunks: windows run inside a chunk, each chunk is summarised once, and the summaries of the
earlier chunks are carried in. Results do not depend on the cut.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from longspark.session import materialize

# Rows of one key that one task may order; larger keys are cut.
MAX_ROWS = 2_000_000
# Heavy keys that a broadcast may hold; with more of them Spark chooses the join.
MAX_BROADCAST_KEYS = 500_000


@dataclass(frozen=True)
class Run:
    """One running aggregate: ``sum``, ``count``, ``min``, ``max`` or ``last`` (skips nulls)."""

    kind: str
    value: Column | None = None
    inclusive: bool = True
    reverse: bool = False


def _over(kind: str, value: Column, window) -> Column:
    if kind == "last":
        return F.last(value, ignorenulls=True).over(window)
    return getattr(F, kind)(value).over(window)


def _merge(kind: str, local: Column, carried: Column) -> Column:
    if kind == "sum":
        return F.when(
            local.isNotNull() | carried.isNotNull(),
            F.coalesce(local, F.lit(0)) + F.coalesce(carried, F.lit(0)),
        )
    if kind == "min":
        return F.least(local, carried)
    if kind == "max":
        return F.greatest(local, carried)
    return F.coalesce(local, carried)


def _normalised(run: Run) -> tuple[str, Column]:
    if run.kind == "count":
        value = F.lit(1) if run.value is None else F.when(run.value.isNotNull(), 1).otherwise(0)
        return "sum", value.cast("bigint")
    return run.kind, run.value


def _ordering(order: list[str], reverse: bool) -> list[Column]:
    return [F.col(c).desc() if reverse else F.col(c).asc() for c in order]


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    specs: dict[str, Run],
    *,
    chunk: str | None = None,
) -> DataFrame:
    """Add one column per spec; ``order`` must be unique inside a key.

    An exclusive run sees strictly earlier rows (strictly later ones when reversed). ``sum``
    and ``count`` over no rows give 0 for ``count`` and null for ``sum``.
    """
    part = [*keys, chunk] if chunk else list(keys)
    if not part:
        raise ValueError("give keys or a chunk column: a global window is one task")
    locals_: list[Column] = []
    kinds: dict[str, str] = {}
    for name, run in specs.items():
        kind, value = _normalised(run)
        kinds[name] = kind
        end = 0 if run.inclusive else -1
        window = (
            Window.partitionBy(*part)
            .orderBy(*_ordering(order, run.reverse))
            .rowsBetween(Window.unboundedPreceding, end)
        )
        out = _over(kind, value, window)
        if run.kind == "count" and not chunk:
            out = F.coalesce(out, F.lit(0).cast("bigint"))
        locals_.append(out.alias(name))
    local = df.select("*", *locals_)
    if not chunk:
        return local

    totals = df.groupBy(*part).agg(
        *[_chunk_total(run, order).alias(f"_t_{name}") for name, run in specs.items()]
    )
    carried: list[Column] = []
    for name, run in specs.items():
        window = (
            Window.partitionBy(*keys)
            .orderBy(F.col(chunk).desc() if run.reverse else F.col(chunk).asc())
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        carried.append(_over(kinds[name], F.col(f"_t_{name}"), window).alias(f"_c_{name}"))
    carry = totals.select(*part, *carried)
    # null keys are keys too
    carry = carry.withColumnsRenamed({c: f"_j_{c}" for c in part})
    merged = local.join(carry, same_keys(local, carry, part, [f"_j_{c}" for c in part]), "left")
    out = []
    for name, run in specs.items():
        column = _merge(kinds[name], F.col(name), F.col(f"_c_{name}"))
        if run.kind == "count":
            column = F.coalesce(column, F.lit(0).cast("bigint"))
        out.append(column.alias(name))
    return merged.select(*df.columns, *out)


def _chunk_total(run: Run, order: list[str]) -> Column:
    kind, value = _normalised(run)
    if kind != "last":
        return getattr(F, kind)(value)
    at = F.when(value.isNotNull(), F.struct(*order))
    return F.min_by(value, at) if run.reverse else F.max_by(value, at)


def largest_group(df: DataFrame, keys: list[str]) -> int:
    """Rows of the largest group: one map-side combined count."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return sizes.agg(F.max("_n")).first()[0] or 0


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], names: list[str]) -> Column:
    """Null-safe equality of the key columns of two frames."""
    out = F.lit(True)
    for a, b in zip(keys, names, strict=True):
        out = out & left[a].eqNullSafe(right[b])
    return out


def _cells(df: DataFrame, keys: list[str], order: list[str], rows: int, max_rows: int) -> DataFrame:
    """Deal rows into cells that follow (keys, order), and write them with their ``_cell`` number.

    The range partitioner samples keys and order together, so it cuts inside a heavy key, inside equal leading
    columns, and for every type that can be sorted. Once written, a row's cell is fixed.
    """
    count = max(1, ceil(2 * rows / max_rows))
    dealt = df.repartitionByRange(count, *keys, *order)
    return materialize(dealt.withColumn("_cell", F.spark_partition_id()))


def exact_starts(
    df: DataFrame, keys: list[str], order: list[str], rows: int, *, weight: str | None = None, max_rows: int = MAX_ROWS, name: str = "_start"
) -> DataFrame:
    """Add the exact number of rows (or sum of ``weight``) in front of each row inside its key.

    Counts per cell are added up over the cells before, and a window orders one cell at a time, so no task holds
    a key. Without ``weight`` rows with equal ``order`` have the same number in front of them; with it ``order`` must be
    unique. ``rows`` is the number of rows, for the number of cells.
    """
    celled = _cells(df, keys, order, rows, max_rows)
    amount = F.lit(1) if weight is None else F.col(weight)
    totals = celled.groupBy(*keys, "_cell").agg(F.sum(amount).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    names = [f"_key_{i}" for i in range(len(keys))]
    before = materialize(
        totals.select(
            *[F.col(k).alias(n) for k, n in zip(keys, names)],
            F.col("_cell").alias("_at"),
            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).cast("bigint").alias("_before"),
        )
    )
    inside = Window.partitionBy(*keys, "_cell").orderBy(*order)
    if weight is None:
        local = F.rank().over(inside) - 1
    else:
        local = F.coalesce(F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = celled.withColumn("_local", local.cast("bigint"))
    placed = placed.join(before, same_keys(placed, before, keys, names) & (F.col("_cell") == F.col("_at")))
    return placed.select(*df.columns, (F.col("_before") + F.col("_local")).alias(name))


def add_chunks(
    df: DataFrame,
    keys: list[str],
    order: str,
    *,
    ties: tuple[str, ...] = (),
    max_rows: int = MAX_ROWS,
    sized_by: DataFrame | None = None,
    group_bound: int | None = None,
) -> tuple[DataFrame, str | None]:
    """Cut keys with more than ``max_rows`` rows into chunks of ``max_rows`` rows, by exact position.

    The position of a row follows (``order``, ``ties``), which may have any type that sorts; rows that are equal in all of them stay
    together, so with a unique composite no chunk is longer. A row's chunk depends on the rows alone, not on how they
    are spread out.

    One aggregation over the key columns sizes the keys, on ``sized_by`` where a frame with at
    least as many rows per key is cheaper to count. Where no key is heavy the frame comes back
    unchanged with no chunk column, and a plain window is the right plan. A ``group_bound``
    proven before (``largest_group``) within ``max_rows`` spares the sizing. Only rows of heavy keys are
    ordered; those of other keys are chunk 0.
    """
    if group_bound is not None and group_bound <= max_rows:
        return df, None
    counted = df if sized_by is None else sized_by
    sizes = counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max_rows)
    heavy, rows = sizes.agg(F.count(F.lit(1)), F.sum("_n")).first()
    if not heavy:
        return df, None
    # the heavy and the other rows, the cells and the windows all read the rows: write them once
    df = materialize(df)
    names = [f"_heavy_{i}" for i in range(len(keys))]
    listed = materialize(sizes.select(*[F.col(k).alias(n) for k, n in zip(keys, names)]))
    listed = F.broadcast(listed) if heavy <= MAX_BROADCAST_KEYS else listed
    is_heavy = same_keys(df, listed, keys, names)
    large, small = df.join(listed, is_heavy, "left_semi"), df.join(listed, is_heavy, "left_anti")
    placed = exact_starts(large, keys, [order, *ties], rows, max_rows=max_rows)
    chunk = F.floor(F.col("_start") / max_rows).cast("bigint")
    cut = placed.select(*df.columns, chunk.alias("_chunk"))
    both = cut.unionByName(small.withColumn("_chunk", F.lit(0).cast("bigint")))
    # an explicit exchange: a join on the key alone would leave the heavy key in one task
    return both.repartition(*keys, "_chunk"), "_chunk"


def position(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    name: str,
    *,
    chunk: str | None = None,
) -> DataFrame:
    """1-based position of each row inside its key."""
    return running(df, keys, order, {name: Run("count")}, chunk=chunk)
