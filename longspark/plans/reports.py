"""Whole analyses put together from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longspark.operators import gates, resample, variance
from longspark.schema import BUNDLE
from longspark.session import materialize


def confirm_report(
    df: DataFrame,
    candidate: str,
    comparators: list[str],
    *,
    by: tuple[str, ...] = (),
    resamples: int = 10_000,
    seed: int = 20260824,
    unit: str = "cohort_seed",
) -> DataFrame:
    """Per world and comparator: effect, bootstrap interval, sign test, Holm over the study."""
    study = list(by)
    mae = df.where(F.col("metric") == "mae")
    areas = gates.naulc(mae, [*study, "world", "model", *BUNDLE])
    pairs = materialize(gates.paired_naulc(areas, candidate, comparators, by=(*by, "world")))
    keys = [*study, "world", "comparator"]
    interval = resample.bootstrap_mean_ci(pairs, keys, unit, "effect", resamples=resamples, seed=seed)
    signs = resample.sign_test(pairs, keys, "effect").withColumn(
        "_tie", F.concat_ws("|", "world", "comparator")
    )
    # equal tests must tie whatever the last bits of their sums
    signs = signs.withColumn("p_value", F.round("p_value", 12))
    adjusted = resample.holm_adjust(signs, study, "p_value", "_tie").drop("_tie")
    return interval.join(adjusted, keys)


def array_analysis(
    effects: DataFrame,
    by: list[str],
    factors: dict[str, list],
    unit: str,
    *,
    value: str = "delta_mae",
    resamples: int = 10_000,
    seed: int = 20260827,
) -> DataFrame:
    """Variance components of every array and size, with bootstrap frequencies and classes."""
    keys = [*by, "n_train"]
    effects = materialize(effects.select(*keys, unit, *factors, value))
    components = variance.factor_ss_general(effects, keys, factors, value)
    frequencies = resample.bootstrap_dominance(
        effects, keys, unit, factors, value, resamples=resamples, seed=seed
    )
    classes = variance.factor_class(components, frequencies, keys)
    named = classes.select(*keys, "component", "largest_frequency", "factor_classification")
    out = components.join(named, [*keys, "component"], "left")
    return out.withColumn(
        "factor_classification", F.coalesce("factor_classification", F.lit("not_applicable"))
    )
