"""Variance shares of factors, two-way residuals, correlations and mechanism screens."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longspark.operators import matrices, resample
from longspark.operators.resample import drop_one_ss
from longspark.operators.scan import MAX_ROWS, Run, add_chunks, largest_group, running
from longspark.session import materialize

EPSILON = float(np.finfo(float).eps)
# Thresholds of the factor classes.
DOMINANCE_RATIO, DOMINANT_FREQUENCY, WEAK_FREQUENCY = 2.0, 0.80, 0.20
# Thresholds of the mechanism screen.
MIN_PEARSON, MIN_SPEARMAN, MAX_P, MIN_SAME_SIGN = 0.35, 0.30, 0.05, 0.80


def with_mean(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Add the mean of the row's group; aggregated and joined, so a heavy group spreads out."""
    if keys:
        return df.join(df.groupBy(*keys).agg(F.avg(value).alias(name)), keys)
    one = df.agg(F.avg(value).alias(name)).withColumn("_one", F.lit(1))
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(one), "_one").drop("_one")


def factor_levels(df: DataFrame, by: list[str], factors: list[str], value: str) -> DataFrame:
    """Mean and centred effect of every factor level."""
    level = F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).cast("string").alias("level")) for f in factors])
    long = df.select(*by, value, F.explode(level).alias("_l"))
    means = long.groupBy(*by, F.col("_l.factor").alias("factor"), F.col("_l.level").alias("level")).agg(
        F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n")
    )
    grand = df.groupBy(*by).agg(F.avg(value).alias("_grand"))
    return means.join(grand, by).withColumn("centered_effect", F.col("mean") - F.col("_grand")).drop("_grand")


def factor_ss(df: DataFrame, by: list[str], factors: list[str], value: str) -> DataFrame:
    """Sums of squares and shares of a balanced array: factors, then the residual."""
    levels = factor_levels(df, by, factors, value)
    total = df.groupBy(*by).agg(
        (F.var_pop(value) * F.count(F.lit(1))).alias("total_ss"), F.count(F.lit(1)).alias("_n")
    )
    square = F.col("n") * F.col("centered_effect") * F.col("centered_effect")
    main = levels.groupBy(*by, "factor").agg(F.sum(square).alias("sum_squares"))
    rest = main.groupBy(*by).agg(F.sum("sum_squares").alias("_main")).join(total, by)
    residual = rest.select(
        *by,
        F.lit("residual").alias("component"),
        F.greatest(F.lit(0.0), F.col("total_ss") - F.col("_main")).alias("sum_squares"),
        "total_ss",
    )
    parts = main.join(total, by).select(*by, F.col("factor").alias("component"), "sum_squares", "total_ss")
    share = F.when(F.col("total_ss") > 0, F.col("sum_squares") / F.col("total_ss")).otherwise(F.lit(0.0))
    return parts.unionByName(residual).withColumn("variance_share", share)


def factor_ss_general(df: DataFrame, by: list[str], factors: dict[str, list], value: str) -> DataFrame:
    """The same for an unbalanced table, by dropping each factor from a least-squares fit."""
    spans, columns = resample.dummy_columns(factors)
    equations = resample.normal_equations(df, by, columns, value)
    width = len(columns)

    # names the function itself: a module would be imported by the worker
    def solve(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in batches:
            frames = []
            for index, cross in enumerate(pdf["cross"]):
                ss, rest, total = drop_one_ss(np.asarray(cross, float), width, spans)
                out = pd.DataFrame({"component": [*ss, "residual"], "sum_squares": [*ss.values(), rest]})
                for key in by:
                    out[key] = pdf[key].iloc[index]
                out["total_ss"] = total
                out["variance_share"] = out["sum_squares"] / total if total > 0 else 0.0
                frames.append(out)
            yield pd.concat(frames) if frames else pd.DataFrame()

    keys = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in equations.schema if f.name in by)
    schema = f"{keys}component string, sum_squares double, total_ss double, variance_share double"
    return equations.mapInPandas(solve, schema)


def factor_class(components: DataFrame, frequencies: DataFrame, by: list[str]) -> DataFrame:
    """``dominant``, ``weak`` or ``unresolved`` per factor."""
    named = components.where(F.col("component") != "residual").join(
        frequencies.select(*by, F.col("factor").alias("component"), "largest_frequency"), [*by, "component"]
    )
    top = named.groupBy(*by).agg(
        F.sort_array(F.collect_list("variance_share"), asc=False).alias("_shares"),
        F.max("total_ss").alias("_total"),
    )
    out = named.join(top, by)
    share, freq = F.col("variance_share"), F.col("largest_frequency")
    first, second = F.col("_shares")[0], F.try_element_at("_shares", F.lit(2))
    least = F.element_at("_shares", -1)
    dominant = (
        (share == first)
        & (share > 0)
        & (share >= F.lit(DOMINANCE_RATIO) * F.coalesce(second, F.lit(0.0)))
        & (freq >= DOMINANT_FREQUENCY)
    )
    # numpy's default closeness: absolute 1e-8 plus relative 1e-5
    close = F.abs(share - least) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(least)
    weak = close & (freq <= WEAK_FREQUENCY)
    label = (
        F.when(F.col("_total") <= EPSILON, "unresolved")
        .when(weak, "weak")
        .when(dominant, "dominant")
        .otherwise("unresolved")
    )
    return out.withColumn("factor_classification", label).drop("_shares", "_total")


def n_shift(effects: DataFrame, keys: list[str], *, low: int = 5, high: int = 40, value: str = "delta_mae") -> DataFrame:
    """Effect at both sizes and their difference, for pairs that have both."""
    at = {n: F.max(F.when(F.col("n_train") == n, F.col(value))) for n in (low, high)}
    out = effects.groupBy(*keys).agg(at[low].alias("delta_low"), at[high].alias("delta_high"))
    return out.where(F.col("delta_low").isNotNull() & F.col("delta_high").isNotNull()).withColumn(
        "t", F.col("delta_high") - F.col("delta_low")
    )


def n_shift_summary(shifts: DataFrame, by: list[str]) -> DataFrame:
    return shifts.groupBy(*by).agg(
        F.avg("t").alias("mean_t"),
        F.count_if(F.col("t") > 0).alias("positive_t_count"),
        F.count("t").alias("pair_count"),
        F.avg("delta_low").alias("mean_delta_low"),
        F.avg("delta_high").alias("mean_delta_high"),
    )


def two_way_residuals(df: DataFrame, by: list[str], row: str, col: str, values: list[str]) -> DataFrame:
    """Value less its row mean and column mean, plus the grand mean."""
    aggs = {"_r_": [*by, row], "_c_": [*by, col], "_g_": by}
    out = df
    for prefix, keys in aggs.items():
        means = df.groupBy(*keys).agg(*[F.avg(v).alias(f"{prefix}{v}") for v in values])
        if keys:
            out = out.join(means, keys)
        else:
            out = out.withColumn("_one", F.lit(1)).join(F.broadcast(means.withColumn("_one", F.lit(1))), "_one").drop("_one")
    for v in values:
        rest = F.col(v) - F.col(f"_r_{v}") - F.col(f"_c_{v}") + F.col(f"_g_{v}")
        out = out.withColumn(f"{v}_residual", rest).drop(f"_r_{v}", f"_c_{v}", f"_g_{v}")
    return out


def context_demean(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return with_mean(df, keys, value, "_mean").withColumn(f"{value}_demeaned", F.col(value) - F.col("_mean")).drop("_mean")


def average_ranks(
    df: DataFrame,
    by: list[str],
    value: str,
    name: str,
    *,
    max_rows: int = MAX_ROWS,
    group_bound: int | None = None,
) -> DataFrame:
    """Rank of each value in its group; equal values share their average rank."""
    keys = by or ["_all"]
    base = df if by else df.withColumn("_all", F.lit(0))
    counts = base.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    cut, chunk = add_chunks(
        counts, keys, value, max_rows=max_rows, sized_by=base, group_bound=group_bound
    )
    cut = running(cut, keys, [value], {"_below": Run("sum", F.col("_c"), inclusive=False)}, chunk=chunk)
    rank = F.coalesce(F.col("_below"), F.lit(0)) + (F.col("_c") + 1) / F.lit(2.0)
    out = base.join(cut.select(*keys, value, rank.alias(name)), [*keys, value])
    return out if by else out.drop("_all")


def safe_corr(
    df: DataFrame,
    by: list[str],
    x: str,
    y: str,
    *,
    least: int = 3,
    eps: float = 0.0,
    group_bound: int | None = None,
) -> DataFrame:
    """Pearson and Spearman correlation; null for few rows or a constant side."""
    bound = largest_group(df, by) if group_bound is None else group_bound
    pearson = df.groupBy(*by).agg(*resample._corr_parts(x, y))
    pearson = pearson.select(*by, F.col("_n").alias("n"), resample.safe_pearson(least, eps).alias("pearson"))
    ranked = average_ranks(df.select(*by, x, y), by, x, "_rx", group_bound=bound)
    ranked = average_ranks(ranked, by, y, "_ry", group_bound=bound)
    spearman = ranked.groupBy(*by).agg(*resample._corr_parts("_rx", "_ry"))
    spearman = spearman.select(*by, resample.safe_pearson(least).alias("spearman"))
    return resample.beside(pearson, spearman, by)


def leave_one_out(
    df: DataFrame, by: list[str], row: str, col: str, x: str, y: str, *, group_bound: int | None = None
) -> DataFrame:
    """Residual correlation without each row label and without each column label.

    A matrix that fits in a row keeps its margins, from which a label is taken out; no cell is copied.
    """
    form = matrices.shape(df, by, row, col)
    if form.fits:
        return matrices.omitted_rows(matrices.gathered(df, by, row, col, [x, y]), by)
    bound = largest_group(df, by) if group_bound is None else group_bound
    parts = []
    for axis, label in (("context", row), ("model", col)):
        omitted = df.select(*by, F.col(label).alias("_omit")).distinct()
        # a matrix has few labels per axis; ranks without one label must be taken anew, so each
        # cell is repeated once per label it stays in for
        rows = df.join(omitted, by).where(F.col(label) != F.col("_omit"))
        tagged = rows.withColumn("omitted_axis", F.lit(axis)).withColumn(
            "omitted_level", F.col("_omit").cast("string")
        ).drop("_omit")
        parts.append(tagged)
    keys = [*by, "omitted_axis", "omitted_level"]
    both = parts[0].unionByName(parts[1])
    rest = two_way_residuals(both, keys, row, col, [x, y])
    return rounded_corr(rest, keys, f"{x}_residual", f"{y}_residual", group_bound=bound)


def rounded_corr(df: DataFrame, by: list[str], x: str, y: str, *, group_bound: int | None = None) -> DataFrame:
    """Correlations of residuals, whose last bits are noise: ties are taken at 12 decimals."""
    snapped = df.withColumns({c: F.round(F.col(c), 12) for c in (x, y)})
    return safe_corr(snapped, by, x, y, group_bound=group_bound)


def same_sign_fraction(loo: DataFrame, reference: DataFrame, by: list[str]) -> DataFrame:
    joined = loo.join(reference.select(*by, F.col("pearson").alias("_ref")), by)
    agree = F.avg(F.when(F.col("pearson").isNotNull(), (F.signum("pearson") == F.signum("_ref")).cast("double")))
    usable = F.max(F.col("_ref")).isNotNull() & (F.max("_ref") != 0)
    return joined.groupBy(*by, "omitted_axis").agg(
        F.when(usable, F.coalesce(agree, F.lit(0.0))).otherwise(F.lit(0.0)).alias("same_sign_fraction")
    )


def association_screen(
    pairs: DataFrame,
    by: list[str],
    row: str,
    col: str,
    outcome: str,
    primary: list[str],
    secondary: list[str] = (),
    *,
    resamples: int = 10_000,
    seed: int = 20260827,
) -> DataFrame:
    """Every mechanism against the outcome, with the screen's criteria.

    Mechanisms become rows first, so all studies and mechanisms go through each step together.
    """
    names = [*primary, *secondary]
    wide = pairs.select(*by, row, col, outcome, *[F.col(m).cast("double").alias(m) for m in names])
    long = materialize(wide.unpivot([*by, row, col, outcome], names, "mechanism", "x"))
    keys = [*by, "mechanism"]
    form = matrices.shape(long, keys, row, col)
    if form.fits:
        groups = materialize(matrices.gathered(long, keys, row, col, ["x", outcome]))
        found = matrices.screened(groups, keys)
        moved = matrices.permutation_counts(_residual_groups(groups), keys, resamples, seed)
        table = found.join(resample.with_p_value(moved, resamples).select(*keys, F.col("p_value").alias("permutation_p")), keys)
    else:
        table = _joined_screen(long, keys, row, col, outcome, resamples, seed, form.largest)
    family = F.when(F.col("mechanism").isin(*primary), "primary").otherwise("secondary")
    table = materialize(table.withColumn("family", family))
    first = resample.holm_adjust(
        table.where("family = 'primary'").select(*keys, "permutation_p"), list(by), "permutation_p", "mechanism",
        name="permutation_p_holm",
    ).select(*keys, "permutation_p_holm")
    table = table.join(first, keys, "left")
    passes = (
        (F.abs("pearson") >= MIN_PEARSON)
        & (F.abs("spearman") >= MIN_SPEARMAN)
        & (F.col("pearson") * F.col("spearman") > 0)
        & (F.col("permutation_p_holm") <= MAX_P)
        & (F.col("same_sign_context") >= MIN_SAME_SIGN)
        & (F.col("same_sign_model") >= MIN_SAME_SIGN)
    )
    return table.withColumn("passes", F.coalesce(passes, F.lit(False)))


def _residual_groups(groups: DataFrame) -> DataFrame:
    """Gathered matrices with their two-way residuals, rounded as ``rounded_corr`` does, in place of the values."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in frames:
            records = pdf.to_dict("records")
            for r in records:
                matrix = matrices.Matrix(r, 2)
                i = [matrix.rows.index(v) for v in r["_rows"]]
                j = [matrix.cols.index(v) for v in r["_cols"]]
                for k, m in enumerate(matrix.values):
                    rest = np.round(matrices.Margins(m).residuals(), 12)[i, j]
                    r[f"_v{k}"] = [None if np.isnan(v) else float(v) for v in rest]
            yield pd.DataFrame(records, columns=pdf.columns)

    return groups.mapInPandas(run, groups.schema)


def _joined_screen(
    long: DataFrame, keys: list[str], row: str, col: str, outcome: str, resamples: int, seed: int, bound: int
) -> DataFrame:
    """The screen's statistics for matrices that are too large for one row."""
    raw = safe_corr(long, keys, "x", outcome, group_bound=bound).select(
        *keys, F.col("pearson").alias("raw_pearson"), F.col("spearman").alias("raw_spearman")
    )
    demeaned = context_demean(context_demean(long, [*keys, row], "x"), [*keys, row], outcome)
    context = rounded_corr(
        demeaned, keys, "x_demeaned", f"{outcome}_demeaned", group_bound=bound
    ).select(
        *keys, F.col("pearson").alias("context_pearson"), F.col("spearman").alias("context_spearman")
    )
    rest = two_way_residuals(long, keys, row, col, ["x", outcome])
    rest = materialize(
        rest.withColumns({c: F.round(F.col(c), 12) for c in ("x_residual", f"{outcome}_residual")})
    )
    two_way = safe_corr(
        rest, keys, "x_residual", f"{outcome}_residual", group_bound=bound
    ).select(*keys, "pearson", "spearman")
    permuted = resample.crossed_permutation(
        rest,
        keys,
        row,
        col,
        "x_residual",
        f"{outcome}_residual",
        resamples=resamples,
        seed=seed,
        group_bound=bound,
    ).select(*keys, F.col("p_value").alias("permutation_p"))
    table = raw.join(context, keys).join(two_way, keys).join(permuted, keys)
    omitted = leave_one_out(long, keys, row, col, "x", outcome, group_bound=bound)
    same = same_sign_fraction(omitted, two_way, keys)
    same = same.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("omitted_axis") == a, F.col("same_sign_fraction"))).alias(f"same_sign_{a}")
            for a in ("context", "model")
        ]
    )
    return table.join(same, keys, "left")
