"""Training traces: best so far, patience stops, run summaries, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longspark.functions.numeric import all_of, finite
from longspark.operators.quantiles import quantiles
from longspark.operators.scan import MAX_ROWS, Run, add_chunks, running


def _cut(trace: DataFrame, keys: list[str], max_rows: int) -> tuple[DataFrame, str | None]:
    return add_chunks(trace, keys, "epoch", max_rows=max_rows)


def best_so_far(
    trace: DataFrame, keys: list[str], loss: str, *, shadow: str | None = None, max_rows: int = MAX_ROWS
) -> DataFrame:
    """Running best loss, its epoch and the epochs since; the same epoch for a shadow metric.

    A later equal loss does not count as an improvement.
    """
    cut, chunk = _cut(trace, keys, max_rows)
    cut = running(cut, keys, ["epoch"], {"_position": Run("count")}, chunk=chunk)
    runs = {"_best": Run("min", F.struct(F.col(loss).alias("loss"), F.col("_position").alias("position"), F.col("epoch").alias("epoch")))}
    if shadow:
        runs["_shadow"] = Run("min", F.struct(F.col(shadow).alias("loss"), F.col("epoch").alias("epoch")))
    out = running(cut, keys, ["epoch"], runs, chunk=chunk)
    out = out.withColumns(
        {
            "best_loss": F.col("_best.loss"),
            "best_epoch": F.col("_best.epoch"),
            "stale_epochs": F.col("_position") - F.col("_best.position"),
        }
    )
    if shadow:
        out = out.withColumn("shadow_epoch", F.col("_shadow.epoch"))
    return out.drop("_position", "_best", "_shadow", *([chunk] if chunk else []))


def patience_stop(trace: DataFrame, keys: list[str], patience: int) -> DataFrame:
    """First epoch whose stale count reaches the patience; null when none does."""
    if patience <= 0:
        raise ValueError("patience must be positive")
    hit = F.when(F.col("stale_epochs") >= patience, F.col("epoch"))
    return trace.groupBy(*keys).agg(F.min(hit).alias("patience_epoch"), F.max("epoch").alias("last_epoch"))


def run_summary(best: DataFrame, keys: list[str], loss: str, shadow: str, patience: int) -> DataFrame:
    """Per run: selected, shadow and stop epoch, and why it stopped.

    Only epochs up to the stop count, as in a run that ended there.
    """
    stops = patience_stop(best, keys, patience).withColumn(
        "stop_epoch", F.coalesce("patience_epoch", "last_epoch")
    )
    rows = best.join(stops, keys).where(F.col("epoch") <= F.col("stop_epoch"))
    reason = F.when(F.max("patience_epoch").isNotNull(), "patience_exhausted").otherwise("max_epochs_reached")
    return rows.groupBy(*keys).agg(
        F.min_by("epoch", F.struct(loss, "epoch")).alias("selected_checkpoint_epoch"),
        F.min_by("epoch", F.struct(shadow, "epoch")).alias("shadow_mae_checkpoint_epoch"),
        F.max("stop_epoch").alias("stop_epoch"),
        reason.alias("early_stop_reason"),
    )


def trace_check(
    trace: DataFrame,
    summaries: DataFrame,
    keys: list[str],
    fields: list[str],
    *,
    order: str,
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """Per run: increasing epochs, finite fields, and a summary that the trace supports."""
    cut, chunk = add_chunks(trace, keys, order, max_rows=max_rows)
    runs = {"_previous": Run("last", F.col("epoch"), inclusive=False)}
    cut = running(cut, keys, [order], runs, chunk=chunk)
    bad = ~all_of([finite(F.col(f).cast("double")) for f in fields])
    per_run = cut.groupBy(*keys).agg(
        F.count_if(F.col("epoch") <= F.col("_previous")).alias("not_increasing"),
        F.count_if(F.col("epoch") <= 0).alias("not_positive"),
        F.count_if(bad).alias("not_finite"),
        F.max("epoch").alias("_last"),
    )
    out = per_run.join(summaries, keys, "full")
    consistent = (
        (F.col("stop_epoch") <= F.col("_last"))
        & (F.col("selected_checkpoint_epoch") <= F.col("stop_epoch"))
        & (F.col("shadow_mae_checkpoint_epoch") <= F.col("stop_epoch"))
    )
    counts = [F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c) for c in ("not_increasing", "not_positive", "not_finite")]
    return out.select(*keys, *counts, F.coalesce(consistent, F.lit(False)).alias("consistent"))


def prefix_means(trace: DataFrame, keys: list[str], fields: list[str], *, epochs: int = 10) -> DataFrame:
    """Mean of each field over the first epochs of a run."""
    return trace.where(F.col("epoch") <= epochs).groupBy(*keys).agg(
        *[F.avg(f).alias(f"prefix_{f}") for f in fields]
    )


_SUMMARY = {
    "selected_epoch": "selected_checkpoint_epoch",
    "shadow_epoch": "shadow_mae_checkpoint_epoch",
    "stop_epoch": "stop_epoch",
}


def pair_mechanisms(
    effects: DataFrame,
    summaries: DataFrame,
    trace: DataFrame,
    keys: list[str],
    *,
    control: str,
    candidate: str,
    fields: list[str],
    epochs: int = 10,
) -> DataFrame:
    """Effects beside both sides' run summaries and early trace means, as differences."""
    cells = summaries.join(prefix_means(trace, [*keys, "variant"], fields, epochs=epochs), [*keys, "variant"])
    columns: dict[str, Column] = {name: F.col(c) for name, c in _SUMMARY.items()}
    columns["selection_shadow_gap"] = F.col("selected_checkpoint_epoch") - F.col("shadow_mae_checkpoint_epoch")
    columns["patience_exhausted"] = (F.col("early_stop_reason") == "patience_exhausted").cast("bigint")
    columns |= {f"prefix_{f}": F.col(f"prefix_{f}") for f in fields}
    sides = []
    for side, variant in (("control", control), ("candidate", candidate)):
        hit = F.col("variant") == variant
        sides += [F.max(F.when(hit, c)).alias(f"{side}_{name}") for name, c in columns.items()]
    wide = cells.groupBy(*keys).agg(*sides)
    out = effects.join(wide, keys)
    deltas = {f"delta_{n}": F.col(f"candidate_{n}") - F.col(f"control_{n}") for n in columns}
    return out.withColumns(deltas)


def checkpoint_gap(summaries: DataFrame, trace: DataFrame, keys: list[str], metric: str, *, control: str, candidate: str) -> DataFrame:
    """Metric at the selected epoch less that at the shadow epoch, per side, and the difference."""
    cell = [*keys, "variant"]
    at = trace.join(summaries.select(*cell, "selected_checkpoint_epoch", "shadow_mae_checkpoint_epoch"), cell)
    gap = F.max(F.when(F.col("epoch") == F.col("selected_checkpoint_epoch"), F.col(metric))) - F.max(
        F.when(F.col("epoch") == F.col("shadow_mae_checkpoint_epoch"), F.col(metric))
    )
    gaps = at.groupBy(*cell).agg(gap.alias("_gap"))
    out = gaps.groupBy(*keys).agg(
        F.max(F.when(F.col("variant") == control, F.col("_gap"))).alias("gap_control"),
        F.max(F.when(F.col("variant") == candidate, F.col("_gap"))).alias("gap_candidate"),
    )
    return out.withColumn("d_checkpoint", F.col("gap_candidate") - F.col("gap_control"))


def dispersion(summaries: DataFrame, trace: DataFrame, by: list[str], keys: list[str], fields: list[str]) -> DataFrame:
    """Mean, sd and interquartile range of epochs and trace means over the runs of a group."""
    means = trace.groupBy(*keys).agg(*[F.avg(f).alias(f"mean_{f}") for f in fields])
    runs = summaries.join(means, keys)
    names = ["selected_checkpoint_epoch", "stop_epoch", *[f"mean_{f}" for f in fields]]
    wanted = {}
    extra = [F.count(F.lit(1)).alias("runs")]
    for n in names:
        wanted[f"_{n}_q1"] = (n, 0.25)
        wanted[f"_{n}_q3"] = (n, 0.75)
        extra += [F.avg(n).alias(f"{n}_mean"), F.stddev_samp(n).alias(f"{n}_std")]
    extra += [
        F.count_if(F.col("early_stop_reason") == r).alias(f"{r}_count")
        for r in ("patience_exhausted", "max_epochs_reached")
    ]
    out = quantiles(runs, by, wanted, extra=extra)
    out = out.withColumns({f"{n}_iqr": F.col(f"_{n}_q3") - F.col(f"_{n}_q1") for n in names})
    return out.drop(*wanted)
