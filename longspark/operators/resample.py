"""Bootstraps, permutations and exact tests with replicates as rows.

A replicate's draw comes from a hash of (seed, replicate, slot). Replicates spread over tasks
like any other key, and a lost task redraws the same sample.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from longspark.functions.draws import draw, driver_draw
from longspark.functions.numeric import pearson
from longspark.operators import matrices
from longspark.operators.metrics import unpack
from longspark.operators.quantiles import quantiles
from longspark.operators.scan import MAX_ROWS, Run, add_chunks, largest_group, running
from longspark.session import materialize

# Values in one array of units, and replicates that one row of it works out.
BLOCK = 4096
REPLICATE_BLOCK = 250
# Fixed value: residual variation below this share of the total counts as none.
ZERO_SHARE = 1e-12


def number_units(
    df: DataFrame,
    by: list[str],
    unit: str,
    *,
    name: str = "k",
    max_rows: int = MAX_ROWS,
    group_bound: int | None = None,
) -> DataFrame:
    """Number the rows of each group 1..n by a unique ``unit`` of any type; add ``n``."""
    keys = by or ["_all"]
    base = df if by else df.withColumn("_all", F.lit(0))
    cut, chunk = add_chunks(base, keys, unit, max_rows=max_rows, group_bound=group_bound)
    runs = {name: Run("count"), "_after": Run("count", inclusive=False, reverse=True)}
    out = running(cut, keys, [unit], runs, chunk=chunk).withColumn("n", F.col(name) + F.col("_after"))
    extra = ["_after", *([chunk] if chunk else []), *([] if by else ["_all"])]
    return out.drop(*extra)


def replicates(df: DataFrame, count: int) -> DataFrame:
    if count <= 0:
        raise ValueError("the number of replicates must be positive")
    return df.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(count))))


def _block_counts(seed: int, block: int, n: int, number: int, first: int, count: int) -> np.ndarray:
    """How many of a group's ``n`` draws fall into block ``number`` of its units, for replicates from ``first``.

    The draws are split in two over and over, each time by a binomial number that hangs on the place alone, so all blocks of a group agree
    and their counts are multinomial.
    """
    low, high, counts = 0, -(-n // block), np.full(count, n)
    while high - low > 1:
        middle = (low + high) // 2
        left, whole = (middle - low) * block, min(n, high * block) - low * block
        rng = np.random.Generator(np.random.Philox(key=driver_draw(seed, "split", n, first, low, high)))
        into = rng.binomial(counts, left / whole)
        counts, low, high = (into, low, middle) if number < middle else (counts - into, middle, high)
    return counts


def _drawn_sums(seed: int, block: int, resamples: int, by: list[str]):
    """For arrays of units and runs of replicates: sum and number of the values drawn, a row each replicate."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        kept: dict = {}

        def slots(n: int, first: int, count: int) -> np.ndarray:
            # groups of one size share their draws
            if (n, first) not in kept:
                while len(kept) > 7:
                    del kept[next(iter(kept))]
                drawn = [driver_draw(seed, r, k) % n for r in range(first, first + count) for k in range(1, n + 1)]
                kept[n, first] = np.array(drawn, np.int64).reshape(count, n)
            return kept[n, first]

        for pdf in frames:
            for record in pdf.to_dict("records"):
                values = np.array([np.nan if v is None else v for v in record["_values"]], float)
                n, number, first = int(record["n"]), int(record["_block"]), int(record["_first"])
                count = min(REPLICATE_BLOCK, resamples - first + 1)
                if n <= block:
                    picked = values[slots(n, first, count)]
                    known = ~np.isnan(picked)
                    sums, sizes = np.where(known, picked, 0.0).sum(1), known.sum(1)
                else:
                    counts = _block_counts(seed, block, n, number, first, count)
                    rng = np.random.Generator(np.random.Philox(key=driver_draw(seed, "block", n, first, number)))
                    sums, sizes = np.zeros(count), np.zeros(count, np.int64)
                    for r, m in enumerate(counts):
                        picked = values[rng.integers(0, len(values), m)]
                        known = ~np.isnan(picked)
                        sums[r], sizes[r] = picked[known].sum(), known.sum()
                out = pd.DataFrame({"replicate": np.arange(first, first + count), "_s": sums, "_n": sizes})
                for k in by:
                    out[k] = record[k]
                yield out

    return run


def bootstrap_means(
    df: DataFrame,
    by: list[str],
    unit: str,
    value: str,
    *,
    resamples: int = 10_000,
    seed: int = 20260824,
    block: int = BLOCK,
) -> DataFrame:
    """Mean of each resample: n units drawn with replacement from the group.

    Units travel once, as arrays of up to ``block`` values; an array and a run of replicates add up their own draws. Of a
    group with more units each block first gets its multinomial share of the draws. No draw becomes a row.
    """
    if resamples <= 0:
        raise ValueError("the number of replicates must be positive")
    bound = largest_group(df, by)
    units = number_units(df.select(*by, unit, value), by, unit, group_bound=bound)
    number = F.floor((F.col("k") - 1) / block).cast("bigint")
    packed = units.groupBy(*by, number.alias("_block")).agg(
        F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("k", F.col(value).cast("double").alias("v")))).alias("_units")
    )
    packed = packed.select(*by, "_block", "n", F.col("_units.v").alias("_values"))
    firsts = F.explode(F.sequence(F.lit(1), F.lit(resamples), F.lit(REPLICATE_BLOCK)))
    rows = packed.withColumn("_first", firsts).repartition(*by, "_block", "_first")
    keys = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*by).schema)
    sums = rows.mapInPandas(_drawn_sums(seed, block, resamples, by), f"{keys}replicate int, _s double, _n long")
    found = sums.groupBy(*by, "replicate").agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))
    return found.select(*by, "replicate", F.when(F.col("_n") > 0, F.col("_s") / F.col("_n")).alias("mean"))


def bootstrap_mean_ci(
    df: DataFrame, by: list[str], unit: str, value: str, *, resamples: int = 10_000, seed: int = 20260824
) -> DataFrame:
    """Observed mean and the 2.5 and 97.5 percentiles of the resampled means."""
    # sized, numbered and averaged: written once
    df = materialize(df.select(*by, unit, value))
    means = bootstrap_means(df, by, unit, value, resamples=resamples, seed=seed)
    ci = quantiles(
        means,
        by,
        {"ci_lower": ("mean", 0.025), "ci_upper": ("mean", 0.975)},
        extra=[F.count(F.lit(1)).alias("resamples")],
        group_bound=resamples,
    )
    observed = df.groupBy(*by).agg(F.avg(value).alias("mean_effect"), F.count(value).alias("units"))
    return beside(observed, ci, by)


def beside(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Join on the study keys; without keys the left side is one row."""
    if by:
        return left.join(right, by)
    one = F.lit(1)
    return right.withColumn("_one", one).join(F.broadcast(left.withColumn("_one", one)), "_one").drop("_one")


def cluster_bootstrap(
    df: DataFrame, by: list[str], cluster: str, value: str, *, resamples: int = 10_000, seed: int = 20260827
) -> DataFrame:
    """The same interval with whole clusters as units, each by its mean."""
    means = df.groupBy(*by, cluster).agg(F.avg(value).alias(value))
    return bootstrap_mean_ci(means, by, cluster, value, resamples=resamples, seed=seed)


def _label_numbers(cells: DataFrame, by: list[str], label: str, name: str, bound: int) -> DataFrame:
    labels = number_units(cells.select(*by, label).distinct(), by, label, name=name, group_bound=bound)
    return labels.withColumnRenamed("n", f"n_{name}")


def _matrix(
    cells: DataFrame, by: list[str], row: str, col: str, values: list[str], bound: int | None = None
) -> DataFrame:
    # a group has at most as many labels as cells
    bound = largest_group(cells, by) if bound is None else bound
    rows = _label_numbers(cells, by, row, "i", bound)
    cols = _label_numbers(cells, by, col, "j", bound)
    return (
        cells.select(*by, row, col, *values)
        .join(rows, [*by, row])
        .join(cols, [*by, col])
        .select(*by, "i", "j", "n_i", "n_j", *values)
    )


def residual_ss(df: DataFrame, keys: list[str], row: str, col: str, values: list[str]) -> DataFrame:
    """Sums of squares of two-way residuals of a complete matrix, per key.

    Margins are aggregated, not windowed: ``ss`` is the total about the mean less the row and
    column parts. A remainder below ``ZERO_SHARE`` of the total is set to 0.
    """
    axes = F.array(
        F.struct(F.lit(0).alias("axis"), F.col(row).cast("bigint").alias("slot")),
        F.struct(F.lit(1).alias("axis"), F.col(col).cast("bigint").alias("slot")),
    )
    marked = df.select(*keys, *values, F.explode(axes).alias("_a"))
    margin_aggs = [F.count(F.lit(1)).alias("_n")]
    for v in values:
        margin_aggs += [F.sum(v).alias(f"_s_{v}"), F.sum(F.col(v) * F.col(v)).alias(f"_q_{v}")]
    margins = marked.groupBy(*keys, F.col("_a.axis").alias("_axis"), F.col("_a.slot").alias("_slot")).agg(
        *margin_aggs
    )
    on_rows = F.col("_axis") == 0
    aggs: list[Column] = [F.sum(F.when(on_rows, F.col("_n"))).alias("cells")]
    for v in values:
        square = F.col(f"_s_{v}") * F.col(f"_s_{v}") / F.col("_n")
        aggs += [
            F.sum(F.when(on_rows, F.col(f"_s_{v}"))).alias(f"_sum_{v}"),
            F.sum(F.when(on_rows, F.col(f"_q_{v}"))).alias(f"_sq_{v}"),
            F.sum(F.when(on_rows, square)).alias(f"_r_{v}"),
            F.sum(F.when(~on_rows, square)).alias(f"_c_{v}"),
        ]
    out = margins.groupBy(*keys).agg(*aggs)
    columns = [F.col("cells")]
    for v in values:
        middle = F.col(f"_sum_{v}") * F.col(f"_sum_{v}") / F.col("cells")
        total = F.col(f"_sq_{v}") - middle
        rest = F.col(f"_sq_{v}") - F.col(f"_r_{v}") - F.col(f"_c_{v}") + middle
        columns += [
            (F.col(f"_sum_{v}") / F.col("cells")).alias(f"mean_{v}"),
            F.when(rest <= F.lit(ZERO_SHARE) * total, F.lit(0.0)).otherwise(rest).alias(f"ss_{v}"),
        ]
    return out.select(*keys, *columns)


def residual_sd_ratio(df: DataFrame, keys: list[str], row: str, col: str, standard: str, forced: str) -> DataFrame:
    """Sample sd of the forced residuals over that of the standard ones; null if that is 0."""
    ss = residual_ss(df, keys, row, col, [standard, forced])

    def sd(v: str) -> Column:
        return F.sqrt(F.col(f"ss_{v}") / (F.col("cells") - 1))

    return ss.select(
        *keys,
        "cells",
        sd(standard).alias("standard_sd"),
        sd(forced).alias("forced_sd"),
        F.when(F.col(f"ss_{standard}") > 0, sd(forced) / sd(standard)).alias("ratio"),
    )


def crossed_bootstrap(
    pairs: DataFrame,
    by: list[str],
    row: str,
    col: str,
    *,
    standard: str = "delta_standard",
    forced: str = "delta_forced",
    effect: str = "g",
    resamples: int = 10_000,
    seed: int = 20260827,
) -> DataFrame:
    """Resample rows and columns of the matrix independently.

    Intervals of the mean effect and of the residual sd ratio, which is recomputed inside each
    replicate with its own margins; the ratio interval is null unless every replicate is valid.
    """
    form = matrices.shape(pairs, by, row, col)
    if form.fits and form.complete:
        groups = matrices.gathered(pairs, by, row, col, [standard, forced, effect])
        stats = matrices.crossed_resamples(groups, by, resamples, seed, ZERO_SHARE)
        stats = stats.withColumnsRenamed({"mean": f"mean_{effect}", "ratio": "_ratio"})
    else:
        stats = _joined_resamples(pairs, by, row, col, standard, forced, effect, resamples, seed)
    out = quantiles(
        stats,
        by,
        {
            "mean_ci_lower": (f"mean_{effect}", 0.025),
            "mean_ci_upper": (f"mean_{effect}", 0.975),
            "ratio_ci_lower": ("_ratio", 0.025),
            "ratio_ci_upper": ("_ratio", 0.975),
        },
        extra=[F.count(F.lit(1)).alias("resamples"), F.count("_ratio").alias("valid_replicates")],
        group_bound=resamples,
    )
    whole = F.col("valid_replicates") == F.col("resamples")
    return out.withColumns({c: F.when(whole, F.col(c)) for c in ("ratio_ci_lower", "ratio_ci_upper")})


def _joined_resamples(
    pairs: DataFrame, by: list[str], row: str, col: str, standard: str, forced: str, effect: str, resamples: int, seed: int
) -> DataFrame:
    """The replicates of matrices that are too large for one row or have holes: a row for each slot."""
    cells = _matrix(pairs, by, row, col, [standard, forced, effect])
    slots = replicates(cells.select(*by, F.col("i").alias("si"), F.col("j").alias("sj"), "n_i", "n_j"), resamples)
    picked = slots.select(
        *by,
        "replicate",
        "si",
        "sj",
        (draw(seed, F.col("replicate"), "row", F.col("si")) % F.col("n_i") + 1).alias("i"),
        (draw(seed, F.col("replicate"), "column", F.col("sj")) % F.col("n_j") + 1).alias("j"),
    )
    sampled = picked.join(cells.drop("n_i", "n_j"), [*by, "i", "j"])
    stats = residual_ss(sampled, [*by, "replicate"], "si", "sj", [standard, forced, effect])
    ratio = F.when(F.col(f"ss_{standard}") > 0, F.sqrt(F.col(f"ss_{forced}") / F.col(f"ss_{standard}")))
    return stats.withColumn("_ratio", ratio)


def sign_test(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """One-sided exact binomial test of more wins than losses; ties are dropped."""
    out = df.groupBy(*by).agg(
        F.count_if(F.col(value) > 0).alias("wins"),
        F.count_if(F.col(value) < 0).alias("losses"),
        F.count_if(F.col(value) == 0).alias("ties"),
    )
    out = out.withColumn("n", F.col("wins") + F.col("losses"))
    # walk k = n, n-1, ..., wins; c is ln C(n, k)
    start = F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("p"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] + F.exp(acc["c"] - F.col("n") * F.lit(math.log(2.0)))
        following = acc["c"] + F.log(k / (F.col("n") - k + 1))
        return F.struct(following.alias("c"), p.alias("p"))

    order = F.when(F.col("n") > 0, F.sequence(F.col("n"), F.col("wins"), F.lit(-1).cast("bigint")))
    order = F.filter(order, lambda k: k >= F.col("wins"))
    walked = F.aggregate(F.transform(order, lambda k: k.cast("double")), start, step, lambda a: a["p"])
    return out.withColumn("p_value", F.when(F.col("n") == 0, F.lit(1.0)).otherwise(F.least(walked, F.lit(1.0))))


def holm_adjust(
    df: DataFrame, by: list[str], p_value: str, tie: str, *, name: str = "holm_p_value", max_rows: int = MAX_ROWS
) -> DataFrame:
    """Holm-adjusted p-values inside each family; equal p-values are ordered by ``tie``."""
    keys = by or ["_all"]
    base = df if by else df.withColumn("_all", F.lit(0))
    cut, chunk = add_chunks(base, keys, p_value, ties=(tie,), max_rows=max_rows)
    runs = {"_remaining": Run("count", reverse=True)}
    cut = running(cut, keys, [p_value, tie], runs, chunk=chunk)
    cut = cut.withColumn("_scaled", F.col("_remaining") * F.col(p_value))
    cut = running(cut, keys, [p_value, tie], {name: Run("max", F.col("_scaled"))}, chunk=chunk)
    drop = ["_remaining", "_scaled", *([chunk] if chunk else []), *([] if by else ["_all"])]
    return cut.withColumn(name, F.least(F.col(name), F.lit(1.0))).drop(*drop)


def _permuted(cells: DataFrame, by: list[str], axis: str, resamples: int, seed: int) -> DataFrame:
    """For each replicate a random bijection of the axis labels."""
    labels = replicates(cells.select(*by, axis).distinct(), resamples)
    order = Window.partitionBy(*by, "replicate").orderBy("_draw", axis)
    labels = labels.withColumn("_draw", draw(seed, F.col("replicate"), axis, F.col(axis)))
    return labels.select(*by, "replicate", axis, F.row_number().over(order).cast("bigint").alias(f"p_{axis}"))


def crossed_permutation(
    cells: DataFrame,
    by: list[str],
    row: str,
    col: str,
    x: str,
    y: str,
    *,
    resamples: int = 10_000,
    seed: int = 20260827,
    group_bound: int | None = None,
) -> DataFrame:
    """Permutation p-value of the correlation of two residual matrices.

    Row and column labels of ``x`` are permuted independently. The p-value is
    ``(exceedances + 1) / (resamples + 1)``, and 1 where the correlation is undefined.
    """
    form = matrices.shape(cells, by, row, col)
    if form.fits:
        groups = matrices.gathered(cells, by, row, col, [x, y])
        return with_p_value(matrices.permutation_counts(groups, by, resamples, seed), resamples)
    return _joined_permutation(cells, by, row, col, x, y, resamples, seed, group_bound)


def with_p_value(counted: DataFrame, resamples: int) -> DataFrame:
    p = (F.col("exceedances") + 1) / F.lit(float(resamples + 1))
    return counted.withColumn("p_value", F.when(F.col("observed").isNull(), F.lit(1.0)).otherwise(p))


def _joined_permutation(
    cells: DataFrame, by: list[str], row: str, col: str, x: str, y: str, resamples: int, seed: int, group_bound: int | None
) -> DataFrame:
    """The same for matrices that are too large for one row: a row for each cell of each replicate."""
    matrix = _matrix(cells, by, row, col, [x, y], group_bound)
    observed = matrix.groupBy(*by).agg(*_corr_parts(x, y))
    observed = observed.select(*by, safe_pearson().alias("observed"))
    slots = replicates(matrix.select(*by, "i", "j", y), resamples)
    slots = slots.join(_permuted(matrix, by, "i", resamples, seed), [*by, "replicate", "i"])
    slots = slots.join(_permuted(matrix, by, "j", resamples, seed), [*by, "replicate", "j"])
    source = matrix.select(*by, F.col("i").alias("p_i"), F.col("j").alias("p_j"), x)
    stats = slots.join(source, [*by, "p_i", "p_j"]).groupBy(*by, "replicate").agg(*_corr_parts(x, y))
    stats = stats.select(*by, safe_pearson().alias("_r"))
    joined = beside(observed, stats, by)
    # the identical arrangement may differ in the last bits of its sum
    hit = F.abs("_r") >= F.abs("observed") - F.lit(1e-12)
    out = joined.groupBy(*by).agg(F.max("observed").alias("observed"), F.count_if(hit).alias("exceedances"))
    return with_p_value(out, resamples)


def _corr_parts(x: str, y: str) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("_n"),
        pearson(x, y).alias("_corr"),
        (F.max(x) - F.min(x)).alias("_px"),
        (F.max(y) - F.min(y)).alias("_py"),
    ]


def safe_pearson(least: int = 3, eps: float = 0.0) -> Column:
    usable = (F.col("_n") >= least) & (F.col("_px") > eps) & (F.col("_py") > eps)
    return F.when(usable, F.col("_corr"))


def bootstrap_dominance(
    df: DataFrame,
    by: list[str],
    unit: str,
    factors: dict[str, list],
    value: str,
    *,
    resamples: int = 10_000,
    seed: int = 20260827,
) -> DataFrame:
    """How often each factor has the largest main-effect sum of squares over resamples.

    A resample is unbalanced and may lose a level, so effects come from dropping the factor out
    of a least-squares fit; effects under ``ZERO_SHARE`` of the total count as none, and the first factor wins a tie. Groups of up to ``BLOCK`` units
    travel once, and runs of replicates weigh their products; of larger groups Spark aggregates the normal equations of every
    resample. Only small matrices are solved in Python.
    """
    if resamples <= 0:
        raise ValueError("the number of replicates must be positive")
    names = list(factors)
    spans, columns = dummy_columns(factors)
    bound = largest_group(df, by)
    units = number_units(df.select(*by, unit, *names, value), by, unit, group_bound=bound)
    if bound <= BLOCK:
        line = F.array(*columns, F.col(value).cast("double"))
        packed = units.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("k", line.alias("line")))).alias("_units"))
        packed = packed.select(*by, F.col("_units.line").alias("_lines"))
        firsts = F.explode(F.sequence(F.lit(1), F.lit(resamples), F.lit(REPLICATE_BLOCK)))
        rows = packed.withColumn("_first", firsts).repartition(*by, "_first")
        found = rows.mapInPandas(_dominance_counts(seed, resamples, by, names, spans, len(columns)), _winner_fields(df, by))
    else:
        slots = replicates(units.select(*by, "k", "n"), resamples)
        picked = slots.select(
            *by, "replicate", (draw(seed, F.col("replicate"), F.col("k")) % F.col("n") + 1).alias("k")
        )
        rows = picked.join(units.drop("n"), [*by, "k"])
        equations = normal_equations(rows, [*by, "replicate"], columns, value)
        found = equations.mapInPandas(_dominance_winners(by, names, spans, len(columns)), _winner_fields(df, by))
    counted = found.groupBy(*by).agg(
        F.sum("wins").alias("resamples"), *[F.sum(F.when(F.col("largest") == f, F.col("wins")).otherwise(0)).alias(f) for f in names]
    )
    long = counted.unpivot([*by, "resamples"], names, "factor", "largest_count")
    return long.withColumn("largest_frequency", F.col("largest_count") / F.col("resamples"))


def _winner_fields(df: DataFrame, by: list[str]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*by).schema) + "largest string, wins long"


def _largest(cross: np.ndarray, names: list[str], width: int, spans: dict[str, range]) -> list[str]:
    """The factor with the largest effect of each matrix of a stack."""
    effects, _, total = drop_one_stack(cross, width, spans)
    table = np.stack([np.where(effects[f] <= ZERO_SHARE * total, 0.0, effects[f]) for f in names], 1)
    return [names[i] for i in table.argmax(1)]


def _dominance_counts(seed: int, resamples: int, by: list[str], names: list[str], spans: dict[str, range], width: int):
    def run(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in frames:
            out = []
            for record in pdf.to_dict("records"):
                lines = np.array([list(u) for u in record["_lines"]], float)
                n, first = len(lines), int(record["_first"])
                count = min(REPLICATE_BLOCK, resamples - first + 1)
                drawn = [driver_draw(seed, r, k) % n for r in range(first, first + count) for k in range(1, n + 1)]
                weights = np.zeros((count, n))
                np.add.at(weights, (np.repeat(np.arange(count), n), np.array(drawn, np.int64)), 1.0)
                products = (lines[:, :, None] * lines[:, None, :]).reshape(n, -1)
                largest = _largest((weights @ products).reshape(count, width + 1, width + 1), names, width, spans)
                out += [[*[record[k] for k in by], f, largest.count(f)] for f in names]
            yield pd.DataFrame(out, columns=[*by, "largest", "wins"])

    return run


def _dominance_winners(by: list[str], names: list[str], spans: dict[str, range], width: int):
    def run(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in frames:
            out = pdf[by].copy()
            cross = np.stack([unpack(np.asarray(c, float), width + 1) for c in pdf["cross"]]) if len(pdf) else np.zeros((0, width + 1, width + 1))
            out["largest"], out["wins"] = _largest(cross, names, width, spans) if len(pdf) else [], 1
            yield out

    return run


def dummy_columns(factors: dict[str, list]) -> tuple[dict[str, range], list[Column]]:
    """Indicator columns of all but the first level; column 0 is the intercept."""
    columns = [F.lit(1.0)]
    spans = {}
    for name, levels in factors.items():
        start = len(columns)
        columns += [F.when(F.col(name) == v, 1.0).otherwise(0.0) for v in levels[1:]]
        spans[name] = range(start, len(columns))
    return spans, columns


def normal_equations(df: DataFrame, keys: list[str], columns: list[Column], value: str) -> DataFrame:
    """Sums of products of the design columns and the value, upper triangle in row order."""
    named = df.select(*keys, *[c.alias(f"_d{i}") for i, c in enumerate(columns)], F.col(value).alias(f"_d{len(columns)}"))
    size = len(columns) + 1
    products = [
        F.sum(F.col(f"_d{i}") * F.col(f"_d{j}")).alias(f"_p{i}_{j}") for i in range(size) for j in range(i, size)
    ]
    out = named.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *products)
    packed = F.array(*[F.col(f"_p{i}_{j}") for i in range(size) for j in range(i, size)])
    return out.select(*keys, "n", packed.alias("cross"))


def drop_one_stack(cross: np.ndarray, width: int, spans: dict[str, range]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Main-effect sums of squares, residual and total of each matrix of normal equations in a stack."""
    gram, right, square = cross[:, :width, :width], cross[:, :width, width], cross[:, width, width]

    def sse(keep: list[int]) -> np.ndarray:
        b = right[:, keep]
        inverse = np.linalg.pinv(gram[:, keep][:, :, keep], rcond=1e-10, hermitian=True)
        return np.maximum(0.0, square - np.einsum("ri,rij,rj->r", b, inverse, b))

    everything = list(range(width))
    full = sse(everything)
    effects = {name: np.maximum(0.0, sse([i for i in everything if i not in span]) - full) for name, span in spans.items()}
    return effects, full, sse([0])


def drop_one_ss(cross: np.ndarray, width: int, spans: dict[str, range]) -> tuple[dict[str, float], float, float]:
    """The same of one matrix, given as its upper triangle."""
    effects, full, total = drop_one_stack(unpack(cross, width + 1)[None], width, spans)
    return {f: float(v[0]) for f, v in effects.items()}, float(full[0]), float(total[0])
