"""Summaries and pairings of a tidy metric table (one row per cell and metric)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longspark.functions.numeric import nan_to_null, oriented
from longspark.operators.quantiles import quantiles
from longspark.schema import BUNDLE, COVERAGE_TARGET


def metric_slice(df: DataFrame, **wanted: object) -> DataFrame:
    """Rows whose columns equal a value, or are in a list of values."""
    for name, value in wanted.items():
        test = F.col(name).isin(*value) if isinstance(value, (list, tuple)) else F.col(name) == value
        df = df.where(test)
    return df


def optional_filters(df: DataFrame, **wanted: object) -> DataFrame:
    """Like ``metric_slice``, but a filter on an absent column is skipped."""
    return metric_slice(df, **{k: v for k, v in wanted.items() if k in df.columns})


def summarize(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Mean, median, sd, min, max and count per key; rows with null keys form groups too.

    NaN counts as missing.
    """
    out = quantiles(
        df.withColumn(value, nan_to_null(F.col(value))),
        keys,
        {"median": (value, 0.5)},
        extra=[
            F.avg(value).alias("mean"),
            F.stddev_samp(value).alias("std"),
            F.min(value).alias("min"),
            F.max(value).alias("max"),
            F.count(value).alias("n"),
        ],
    )
    return out.select(*keys, "mean", "median", "std", "min", "max", "n")


def pivot_models(
    df: DataFrame, keys: list[str], models: list[str], *, column: str = "model", value: str = "value"
) -> DataFrame:
    """One column per named model; null where a model has no row."""
    return df.groupBy(*keys).agg(
        *[F.max(F.when(F.col(column) == m, F.col(value))).alias(m) for m in models]
    )


def paired_effects(wide: DataFrame, candidate: str, comparators: list[str]) -> DataFrame:
    """Comparator minus candidate, relative to the comparator, and who wins."""
    wins: list[Column] = []
    for c in comparators:
        delta = F.col(c) - F.col(candidate)
        wins.append(delta > 0)
        wide = (
            wide.withColumn(f"delta_vs_{c}", delta)
            .withColumn(f"relative_vs_{c}", F.try_divide(delta, F.col(c)))
            .withColumn(f"beats_{c}", delta > 0)
        )
    return wide.withColumn("beats_all", reduce(lambda a, b: a & b, wins))


def win_matrix(effects: DataFrame, keys: list[str], candidate: str, comparators: list[str]) -> DataFrame:
    aggs = [F.avg(m).alias(f"mean_{m}") for m in (candidate, *comparators)]
    aggs += [F.count_if(F.col(f"beats_{c}")).alias(f"wins_vs_{c}") for c in comparators]
    aggs += [F.avg(f"delta_vs_{c}").alias(f"mean_delta_vs_{c}") for c in comparators]
    aggs += [
        F.count_if(F.col("beats_all")).alias("wins_vs_all"),
        F.count(F.lit(1)).alias("n_bundles"),
    ]
    out = effects.groupBy(*keys).agg(*aggs)
    flags = [(F.col(f"mean_{candidate}") < F.col(f"mean_{c}")) for c in comparators]
    for c, flag in zip(comparators, flags, strict=True):
        out = out.withColumn(f"beats_{c}_on_mean", flag)
    return out.withColumn("beats_all_on_mean", reduce(lambda a, b: a & b, flags))


def gate_summary(df: DataFrame, keys: list[str], candidate: str, comparators: list[str]) -> DataFrame:
    """Mean per model and whether the candidate beats all; null when a comparator is missing."""
    out = df.groupBy(*keys).agg(
        *[
            F.avg(F.when(F.col("model") == m, nan_to_null(F.col("value")))).alias(m)
            for m in (candidate, *comparators)
        ]
    )
    missing = reduce(lambda a, b: a | b, [F.col(m).isNull() for m in (candidate, *comparators)])
    beats = reduce(lambda a, b: a & b, [F.col(candidate) < F.col(c) for c in comparators])
    return out.withColumn("beats_all", F.when(~missing, beats))


def gate_check(recorded: DataFrame, recomputed: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """Recorded flag against the recomputed one, null-safe."""
    again = recomputed.select(*keys, F.col(flag).alias(f"recomputed_{flag}"))
    out = recorded.select(*keys, flag).join(again, keys, "left")
    return out.withColumn("agrees", F.col(flag).eqNullSafe(F.col(f"recomputed_{flag}")))


def learning_curve(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    v = nan_to_null(F.col(value))
    return df.groupBy(*keys).agg(
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.count(v).alias("n")
    )


def mean_plot_data(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """The series behind a mean-and-band figure; a single value has a band of 0."""
    sd = F.coalesce(F.col("sd"), F.lit(0.0))
    return learning_curve(df, keys, value).select(
        *keys, "mean", "n", (F.col("mean") - sd).alias("low"), (F.col("mean") + sd).alias("high")
    )


def parameter_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    out = quantiles(
        df,
        keys,
        {"median_parameters": ("trainable_parameters", 0.5)},
        extra=[
            F.min("trainable_parameters").alias("minimum_parameters"),
            F.max("trainable_parameters").alias("maximum_parameters"),
            F.count(F.lit(1)).alias("n_rows"),
        ],
    )
    constant = F.col("minimum_parameters") == F.col("maximum_parameters")
    return out.withColumn("constant_parameter_count", constant)


def distinct_budgets(df: DataFrame) -> DataFrame:
    return df.select("n_train", "n_fit", "n_validation").distinct()


def calibration_summary(summary: DataFrame) -> DataFrame:
    """Likelihood and coverage rows, with the distance of mean coverage from its target."""
    rows = summary.where(F.col("metric").isin("nll", "coverage_90"))
    miss = F.when(F.col("metric") == "coverage_90", F.abs(F.col("mean") - COVERAGE_TARGET))
    return rows.withColumn("coverage_abs_error", miss)


def ablation_pairs(ablated: DataFrame, full: DataFrame, keys: list[str]) -> DataFrame:
    """Each ablated row beside its full-model row, with the benefit of the removed part.

    Positive benefit: removing the part made the metric worse. ``paired`` is false for an
    ablated row without its full-model row.
    """
    left = ablated.select(
        *keys,
        "ablation",
        F.col("value").alias("ablated_value"),
        F.col("trainable_parameters").alias("ablated_parameters"),
    )
    right = full.select(
        *keys,
        F.col("value").alias("full_value"),
        F.col("trainable_parameters").alias("full_parameters"),
    )
    gain = oriented(F.col("metric"), F.col("ablated_value"), F.col("full_value"))
    return (
        left.join(right, keys, "left")
        .withColumn("paired", F.col("full_value").isNotNull())
        .withColumn("raw_delta", F.col("ablated_value") - F.col("full_value"))
        .withColumn("benefit", gain)
    )


def ablation_summary(pairs: DataFrame, keys: list[str]) -> DataFrame:
    return quantiles(
        pairs,
        keys,
        {"median_delta": ("raw_delta", 0.5), "median_benefit": ("benefit", 0.5)},
        extra=[
            F.avg("raw_delta").alias("mean_delta"),
            F.stddev_samp("raw_delta").alias("sd_delta"),
            F.avg("benefit").alias("mean_benefit"),
            F.stddev_samp("benefit").alias("sd_benefit"),
            F.count(F.lit(1)).alias("n"),
        ],
    )


def headline_table(wins: DataFrame, keys: list[str], candidate: str, comparators: list[str], *, bundles: int) -> DataFrame:
    """Compact table of means and simultaneous wins, flagged where bundles are missing."""
    return wins.select(
        *keys,
        *[f"mean_{m}" for m in (candidate, *comparators)],
        "wins_vs_all",
        "beats_all_on_mean",
        (F.col("n_bundles") == bundles).alias("complete"),
    )


def oriented_effects(
    df: DataFrame,
    candidates: list[str],
    control: str,
    *,
    by: tuple[str, ...] = (),
    column: str = "model",
    pair: tuple[str, ...] = (*BUNDLE, "n_train", "metric"),
) -> DataFrame:
    """Paired effect per metric, positive when the candidate is better."""
    keys = [*by, *pair]
    base = df.where(F.col(column) == control).select(*keys, F.col("value").alias("control_value"))
    own = df.where(F.col(column).isin(*candidates)).select(
        *keys, F.col(column).alias("candidate"), F.col("value").alias("candidate_value")
    )
    out = own.join(base, keys)
    effect = oriented(F.col("metric"), F.col("control_value"), F.col("candidate_value"))
    return out.withColumn("effect", effect).withColumn("candidate_better", F.col("effect") > 0)


def effect_summary(effects: DataFrame, keys: list[str]) -> DataFrame:
    out = quantiles(
        effects,
        keys,
        {"median_effect": ("effect", 0.5)},
        extra=[
            F.avg("candidate_value").alias("candidate_mean"),
            F.avg("control_value").alias("control_mean"),
            F.avg("effect").alias("mean_effect"),
            F.stddev_samp("effect").alias("sd_effect"),
            F.count_if(F.col("effect") > 0).alias("wins"),
            F.count(F.lit(1)).alias("n"),
        ],
    )
    return out.withColumn("win_fraction", F.col("wins") / F.col("n"))


def metric_subset() -> Column:
    """Which extract of the results a row belongs to."""
    return (
        F.when(F.col("metric") == "latent_aligned_r2", "latent")
        .when(F.col("metric").startswith("event_"), "event")
        .when(F.col("site_or_shift") != "all", "site_shift")
        .when(F.col("n_train") < 40, "low_n")
        .otherwise("rest")
    )


def metric_subsets(df: DataFrame, value: str = "value") -> DataFrame:
    """Rows and mean of every extract and metric."""
    return df.groupBy(metric_subset().alias("subset"), "metric").agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")
    )


def locked_order(df: DataFrame, column: str, ranks: list[str], *then: str) -> DataFrame:
    """Sort by the declared order of a category; an undeclared category is an error."""
    rank = F.array_position(F.array(*[F.lit(r) for r in ranks]), F.col(column))
    checked = F.when(rank > 0, rank).otherwise(
        F.raise_error(F.concat(F.lit(f"unexpected {column}: "), F.col(column).cast("string")))
    )
    return df.withColumn(f"{column}_rank", checked.cast("bigint")).orderBy(f"{column}_rank", *then)
