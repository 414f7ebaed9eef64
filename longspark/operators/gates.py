"""Learning-curve areas, paired gates and candidate selection, for many studies at once.

Every function takes ``by``, the columns that tell studies apart, and gives one decision per
study. Expected counts are arguments; a study without them does not pass.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from longspark.functions.numeric import all_of, finite
from longspark.operators.quantiles import quantiles
from longspark.schema import BUNDLE, COVERAGE_TARGET, TRAIN_SIZES
from longspark.session import materialize

# Scale of the median absolute deviation, smallest usable median.
MAD_SCALE = 1.4826
NEAR_ZERO_MEDIAN = 1e-12


def naulc(df: DataFrame, keys: list[str], *, sizes: tuple[int, ...] = TRAIN_SIZES, value: str = "value") -> DataFrame:
    """Trapezoid of the value over ln(n), divided by the width, per key.

    Null unless every size has exactly one finite value.
    """
    n, v = F.col("n_train"), F.col(value)
    aggs = []
    for s in sizes:
        aggs += [
            F.max(F.when(n == s, v)).alias(f"_v{s}"),
            F.count(F.when(n == s, 1)).alias(f"_n{s}"),
        ]
    out = df.groupBy(*keys).agg(*aggs)
    area: Column = F.lit(0.0)
    for a, b in zip(sizes, sizes[1:]):
        width = math.log(b) - math.log(a)
        area = area + (F.col(f"_v{a}") + F.col(f"_v{b}")) / F.lit(2.0) * F.lit(width)
    usable = all_of([(F.col(f"_n{s}") == 1) & finite(F.col(f"_v{s}")) for s in sizes])
    span = math.log(sizes[-1]) - math.log(sizes[0])
    return out.select(*keys, F.when(usable, area / F.lit(span)).alias("naulc"))


def paired_naulc(
    areas: DataFrame,
    candidate: str,
    comparators: list[str],
    *,
    by: tuple[str, ...] = ("world",),
    column: str = "model",
) -> DataFrame:
    """Candidate and comparator areas of one bundle side by side, with the effect."""
    keys = [*by, *BUNDLE]
    own = areas.where(F.col(column) == candidate).select(*keys, F.col("naulc").alias("naulc_candidate"))
    other = areas.where(F.col(column).isin(*comparators)).select(
        *keys, F.col(column).alias("comparator"), F.col("naulc").alias("naulc_comparator")
    )
    effect = F.col("naulc_comparator") - F.col("naulc_candidate")
    return (
        other.join(own, keys)
        .withColumn("effect", effect)
        .withColumn("relative", F.when(F.col("naulc_comparator") > 0, effect / F.col("naulc_comparator")))
    )


def development_gate(
    pairs: DataFrame,
    keys: list[str],
    *,
    min_relative_effect: float | str,
    bundles: int = 5,
    wins_required: int = 4,
) -> DataFrame:
    """Mean gain above zero, enough wins, and a relative gain of at least the threshold."""
    threshold = (
        F.max(min_relative_effect)
        if isinstance(min_relative_effect, str)
        else F.lit(float(min_relative_effect))
    )
    out = quantiles(
        pairs,
        keys,
        {"median_improvement": ("effect", 0.5)},
        extra=[
            F.count("effect").alias("pairs"),
            F.count_if(F.col("effect") > 0).alias("wins"),
            F.avg("effect").alias("mean_improvement"),
            F.stddev_samp("effect").alias("sd_improvement"),
            F.avg("relative").alias("mean_relative_improvement"),
            F.avg("naulc_candidate").alias("candidate_mean_aulc"),
            F.avg("naulc_comparator").alias("control_mean_aulc"),
            threshold.alias("_threshold"),
        ],
    )
    passed = (
        (F.col("pairs") == bundles)
        & (F.col("mean_improvement") > 0)
        & (F.col("wins") >= wins_required)
        & (F.col("mean_relative_improvement") >= F.col("_threshold"))
    )
    return (
        out.withColumn("win_fraction", F.col("wins") / F.lit(float(bundles)))
        .withColumn("passed", F.coalesce(passed, F.lit(False)))
        .drop("_threshold")
    )


def noise_floor(
    df: DataFrame,
    groups: list[str],
    *,
    by: tuple[str, ...] = (),
    configured: float = 0.0,
    replicates: int = 5,
    value: str = "value",
) -> DataFrame:
    """75th percentile over groups of the robust relative standard error.

    ``locked_threshold`` is the larger of the configured effect and the floor. A group with a
    median near zero or a wrong number of rows makes the floor of its study null.
    """
    keys = list(dict.fromkeys([*by, *groups]))
    df = materialize(df.select(*keys, value))
    medians = quantiles(
        df, keys, {"median": (value, 0.5)}, extra=[F.count(value).alias("_rows")]
    )
    away = df.join(medians, keys).withColumn("_away", F.abs(F.col(value) - F.col("median")))
    spread = quantiles(
        away,
        keys,
        {"mad": ("_away", 0.5)},
        extra=[F.max("median").alias("median"), F.max("_rows").alias("_rows")],
    )
    usable = (F.abs("median") > NEAR_ZERO_MEDIAN) & (F.col("_rows") == replicates)
    error = F.lit(MAD_SCALE) * F.col("mad") / (F.abs("median") * F.lit(math.sqrt(replicates)))
    errors = spread.withColumn("_error", F.when(usable, error))
    out = quantiles(
        errors,
        list(by),
        {"noise_floor": ("_error", 0.75)},
        extra=[F.count_if(F.col("_error").isNull()).alias("_bad"), F.count(F.lit(1)).alias("n_groups")],
    )
    floor = F.when(F.col("_bad") == 0, F.col("noise_floor"))
    return (
        out.withColumn("noise_floor", floor)
        .withColumn("locked_threshold", F.greatest(F.lit(float(configured)), F.col("noise_floor")))
        .drop("_bad")
    )


def select_candidate(gates: DataFrame, by: list[str], *, tie_tolerance: float = 0.005) -> DataFrame:
    """Mark the selected row of each study.

    Among the passing rows the least mean area wins. When the relative gains of the best two
    differ by less than the tolerance, fewer parameters win, then the area, then the name.
    """
    passing = gates.where("passed")
    order = Window.partitionBy(*by).orderBy("candidate_mean_aulc", "candidate")
    top = passing.withColumn("_rank", F.row_number().over(order)).where("_rank <= 2")

    def ranked(rank: int, column: str) -> Column:
        return F.max(F.when(F.col("_rank") == rank, F.col(column)))

    best = top.groupBy(*by).agg(
        ranked(1, "candidate").alias("_best"),
        (F.abs(ranked(1, "mean_relative_improvement") - ranked(2, "mean_relative_improvement"))).alias("_gap"),
    )
    small = passing.groupBy(*by).agg(
        F.min_by("candidate", F.struct("trainable_parameters", "candidate_mean_aulc", "candidate")).alias("_small")
    )
    chosen = best.join(small, by).select(
        *by,
        F.when(F.col("_gap") < tie_tolerance, F.col("_small")).otherwise(F.col("_best")).alias("_chosen"),
    )
    return gates.join(chosen, by, "left").withColumn(
        "selected", F.coalesce(F.col("candidate") == F.col("_chosen"), F.lit(False))
    ).drop("_chosen")


def select_stage(
    df: DataFrame,
    control: str,
    candidates: list[str],
    *,
    by: tuple[str, ...] = ("world",),
    column: str = "variant",
    min_relative_effect: float = 0.0,
    bundles: int = 5,
    wins_required: int = 4,
) -> DataFrame:
    """Gate table of a stage: areas, pairs with the control, gates, selection."""
    keys = list(by)
    areas = naulc(df, [*keys, column, *BUNDLE])
    paired = _against_control(areas, control, candidates, keys, column)
    gates = development_gate(
        paired,
        [*keys, "candidate"],
        min_relative_effect=min_relative_effect,
        bundles=bundles,
        wins_required=wins_required,
    )
    parameters = df.groupBy(*keys, F.col(column).alias("candidate")).agg(
        F.max("trainable_parameters").alias("trainable_parameters")
    )
    return select_candidate(gates.join(parameters, [*keys, "candidate"]), keys)


def _against_control(areas: DataFrame, control: str, candidates: list[str], keys: list[str], column: str) -> DataFrame:
    pair = [*keys, *BUNDLE]
    base = areas.where(F.col(column) == control).select(*pair, F.col("naulc").alias("naulc_comparator"))
    own = areas.where(F.col(column).isin(*candidates)).select(
        *pair, F.col(column).alias("candidate"), F.col("naulc").alias("naulc_candidate")
    )
    effect = F.col("naulc_comparator") - F.col("naulc_candidate")
    return (
        own.join(base, pair)
        .withColumn("effect", effect)
        .withColumn("relative", F.when(F.col("naulc_comparator") > 0, effect / F.col("naulc_comparator")))
    )


def paired_metric_wins(
    df: DataFrame,
    winner: str,
    loser: str,
    *,
    by: tuple[str, ...] = ("world", "metric"),
    column: str = "model",
    bundles: int = 5,
    wins_required: int = 4,
) -> DataFrame:
    """Whether ``winner`` is lower on average and in enough bundles; coverage by its miss."""
    keys = [*by, *BUNDLE]
    means = df.groupBy(*keys).agg(
        F.avg(F.when(F.col(column) == winner, F.col("value"))).alias("_w"),
        F.avg(F.when(F.col(column) == loser, F.col("value"))).alias("_l"),
    )
    means = means.where(F.col("_w").isNotNull() & F.col("_l").isNotNull())

    def scored(c: str) -> Column:
        miss = F.abs(F.col(c) - F.lit(COVERAGE_TARGET))
        return F.when(F.col("metric") == "coverage_90", miss).otherwise(F.col(c))

    out = means.groupBy(*by).agg(
        F.count(F.lit(1)).alias("pairs"),
        F.count_if(scored("_w") < scored("_l")).alias("wins"),
        F.avg(scored("_w")).alias("winner_mean"),
        F.avg(scored("_l")).alias("loser_mean"),
    )
    ok = (
        (F.col("pairs") == bundles)
        & (F.col("winner_mean") < F.col("loser_mean"))
        & (F.col("wins") >= wins_required)
    )
    return out.withColumn("ok", ok)


def select_uncertainty(
    df: DataFrame,
    *,
    baseline: str,
    candidates: tuple[str, str],
    tolerance: float,
    by: tuple[str, ...] = (),
    column: str = "model",
    bundles: int = 5,
    wins_required: int = 4,
    worlds_required: int = 2,
) -> DataFrame:
    """Pick a probabilistic variant: close enough in area in all worlds, and calibrated in enough.

    One row per study and candidate, with ``selected``; no selected row means the baseline.
    """
    study = list(by)
    df = materialize(df.where(F.col("metric").isin("mae", "nll", "coverage_90")))
    areas = naulc(df.where(F.col("metric") == "mae"), [*study, "world", column, *BUNDLE])
    mean = areas.groupBy(*study, "world", column).agg(F.avg("naulc").alias("_area"))
    base = mean.where(F.col(column) == baseline).select(*study, "world", F.col("_area").alias("_base"))
    own = mean.where(F.col(column).isin(*candidates)).join(base, [*study, "world"])
    admissible = own.groupBy(*study, F.col(column).alias("candidate")).agg(
        F.bool_and(F.col("_area") <= F.lit(1.0 + tolerance) * F.col("_base")).alias("admissible")
    )
    scored = df.where(F.col("metric").isin("nll", "coverage_90"))
    sides = []
    for a, b in (candidates, candidates[::-1]):
        wins = paired_metric_wins(
            scored,
            a,
            b,
            by=(*by, "world", "metric"),
            column=column,
            bundles=bundles,
            wins_required=wins_required,
        )
        both = wins.groupBy(*study, "world").agg(
            (F.count_if(F.col("ok")) == 2).alias("_both")
        )
        sides.append(
            both.groupBy(*study).agg(
                F.lit(a).alias("candidate"), F.count_if(F.col("_both")).alias("world_wins")
            )
        )
    world_wins = sides[0].unionByName(sides[1])
    parameters = df.groupBy(*study, F.col(column).alias("candidate")).agg(
        F.max("trainable_parameters").alias("trainable_parameters")
    )
    keys = [*study, "candidate"]
    out = admissible.join(world_wins, keys, "left").join(parameters, keys, "left")
    counted = F.when(F.col("admissible"), F.coalesce(F.col("world_wins"), F.lit(0))).otherwise(F.lit(0))
    out = out.withColumn("world_wins", counted.cast("bigint"))
    eligible = F.col("admissible") & (F.col("world_wins") >= worlds_required)
    # two candidates per study at most
    order = F.when(eligible, F.struct("world_wins", -F.col("trainable_parameters"), F.col("candidate") == candidates[0]))
    window = Window.partitionBy(*study) if study else Window.partitionBy(F.lit(1))
    best = F.max_by("candidate", order).over(window)
    return out.withColumn("selected", F.coalesce(eligible & (F.col("candidate") == best), F.lit(False)))


def timing_audit(strict: DataFrame, inclusive: DataFrame, *, by: tuple[str, ...] = ("world",)) -> DataFrame:
    """Inclusive minus strict area per bundle, summarised per study."""
    keys = [*by, *BUNDLE]
    joined = strict.select(*keys, F.col("naulc").alias("_s")).join(
        inclusive.select(*keys, F.col("naulc").alias("_i")), keys
    )
    rows = joined.withColumn("delta", F.col("_i") - F.col("_s"))
    return quantiles(
        rows,
        list(by),
        {"median_delta": ("delta", 0.5)},
        extra=[F.avg("delta").alias("mean_delta"), F.count("delta").alias("n_bundles")],
    )


def _effect_gate(rows: DataFrame, keys: list[str], bundles: int, wins_required: int) -> DataFrame:
    out = rows.groupBy(*keys).agg(
        F.count("effect").alias("pairs"),
        F.avg("effect").alias("mean_effect"),
        F.count_if(F.col("effect") > 0).alias("wins"),
    )
    passed = (F.col("pairs") == bundles) & (F.col("mean_effect") > 0) & (F.col("wins") >= wins_required)
    return out.withColumn("passed", F.coalesce(passed, F.lit(False)))


def early_n_gate(
    df: DataFrame,
    candidate: str,
    comparators: list[str],
    *,
    by: tuple[str, ...] = ("world",),
    sizes: tuple[int, ...] = (5, 10, 20),
    bundles: int = 10,
    wins_required: int = 8,
) -> DataFrame:
    """Per small size: paired MAE against every comparator; all must pass."""
    keys = [*by, "n_train", *BUNDLE]
    rows = df.where((F.col("metric") == "mae") & F.col("n_train").isin(*sizes))
    wide = rows.groupBy(*keys).agg(
        *[F.max(F.when(F.col("model") == m, F.col("value"))).alias(m) for m in (candidate, *comparators)]
    )
    aggs, flags = [], []
    for c in comparators:
        effect = F.col(c) - F.col(candidate)
        aggs += [
            F.count(effect).alias(f"_n_{c}"),
            F.avg(effect).alias(f"{c}_mean_effect"),
            F.count_if(effect > 0).alias(f"{c}_wins"),
        ]
        passed = (
            (F.col(f"_n_{c}") == bundles)
            & (F.col(f"{c}_mean_effect") > 0)
            & (F.col(f"{c}_wins") >= wins_required)
        )
        flags.append((f"{c}_passed", F.coalesce(passed, F.lit(False))))
    out = wide.groupBy(*by, "n_train").agg(*aggs)
    for name, flag in flags:
        out = out.withColumn(name, flag)
    return out.withColumn("passed", all_of([F.col(n) for n, _ in flags])).drop(
        *[f"_n_{c}" for c in comparators]
    )


def primary_gate(
    df: DataFrame,
    candidate: str,
    comparators: list[str],
    *,
    by: tuple[str, ...] = (),
    bundles: int = 10,
    wins_required: int = 8,
    worlds_required: int = 2,
) -> DataFrame:
    """World summaries per comparator, with the headline decision of the study on each row."""
    study = list(by)
    mae = materialize(df.where(F.col("metric") == "mae"))
    areas = naulc(mae, [*study, "world", "model", *BUNDLE])
    pairs = paired_naulc(areas, candidate, comparators, by=(*by, "world"))
    keys = [*study, "world", "comparator"]
    summary = quantiles(
        pairs,
        keys,
        {"median_effect": ("effect", 0.5)},
        extra=[
            F.count("effect").alias("pairs"),
            F.avg("effect").alias("mean_effect"),
            F.stddev_samp("effect").alias("sd_effect"),
            F.count_if(F.col("effect") > 0).alias("wins"),
            (F.avg("relative") * 100.0).alias("mean_relative_improvement_pct"),
        ],
    )
    passed = (
        (F.col("pairs") == bundles) & (F.col("mean_effect") > 0) & (F.col("wins") >= wins_required)
    )
    summary = summary.withColumn("win_fraction", F.col("wins") / F.lit(float(bundles))).withColumn(
        "passed", F.coalesce(passed, F.lit(False))
    )
    shared = summary.groupBy(*study, "world").agg(
        (F.bool_and("passed") & (F.count(F.lit(1)) == len(comparators))).alias("_shared")
    )
    early = early_n_gate(
        mae, candidate, comparators, by=(*by, "world"), bundles=bundles, wins_required=wins_required
    )
    early = early.groupBy(*study, "world").agg(F.bool_or("passed").alias("_early"))
    worlds = shared.join(early, [*study, "world"], "left")
    early_shared = F.coalesce(F.bool_or(F.col("_shared") & F.col("_early")), F.lit(False))
    names = F.array_join(
        F.sort_array(F.collect_set(F.when(F.col("_shared"), F.col("world")))), ","
    )
    head = worlds.groupBy(*study).agg(
        F.count_if(F.col("_shared")).alias("shared_worlds"),
        names.alias("shared_passing_worlds"),
        early_shared.alias("early_n_passed"),
    )
    head = head.withColumn(
        "headline_passed", (F.col("shared_worlds") >= worlds_required) & F.col("early_n_passed")
    )
    if study:
        return summary.join(head, study)
    one = F.lit(1)
    return summary.withColumn("_one", one).join(head.withColumn("_one", one), "_one").drop("_one")


def site_degradation(
    df: DataFrame, *, by: tuple[str, ...] = ("world",), sites: tuple[str, str] = ("site_0", "site_1")
) -> DataFrame:
    """Per bundle, size and model: how much each metric worsens from the first site to the second.

    ``consistent`` is false where a metric is present for one site only.
    """
    keys = [*by, *BUNDLE, "n_train", "model"]
    near, far = sites
    aggs = []
    for m in ("mae", "nll", "coverage_90"):
        for name, site in (("0", near), ("1", far)):
            hit = (F.col("metric") == m) & (F.col("site_or_shift") == site)
            aggs.append(F.max(F.when(hit, F.col("value"))).alias(f"{m}_site_{name}"))
    out = df.where(F.col("site_or_shift").isin(near, far)).groupBy(*keys).agg(*aggs)
    mae = F.col("mae_site_1") - F.col("mae_site_0")
    out = out.withColumns(
        {
            "mae_absolute_degradation": mae,
            "mae_relative_degradation": F.when(F.col("mae_site_0") > 0, mae / F.col("mae_site_0")),
            "nll_absolute_degradation": F.col("nll_site_1") - F.col("nll_site_0"),
            "ce90_site_0": F.abs(F.col("coverage_90_site_0") - COVERAGE_TARGET),
            "ce90_site_1": F.abs(F.col("coverage_90_site_1") - COVERAGE_TARGET),
        }
    )
    both = [
        F.col(f"{m}_site_0").isNull() == F.col(f"{m}_site_1").isNull() for m in ("nll", "coverage_90")
    ]
    return out.withColumn(
        "ce90_absolute_degradation", F.col("ce90_site_1") - F.col("ce90_site_0")
    ).withColumn("consistent", all_of([*both, F.col("mae_site_0").isNotNull() & F.col("mae_site_1").isNotNull()]))


def site_gate(
    degradation: DataFrame,
    candidate: str,
    comparators: list[str],
    *,
    by: tuple[str, ...] = ("world",),
    bundles: int = 10,
    wins_required: int = 8,
) -> DataFrame:
    """Whether the candidate degrades less across sites than each comparator."""
    keys = [*by, *BUNDLE, "n_train"]
    value = F.col("mae_absolute_degradation")
    own = degradation.where(F.col("model") == candidate).select(*keys, value.alias("_c"))
    other = degradation.where(F.col("model").isin(*comparators)).select(
        *keys, F.col("model").alias("comparator"), value.alias("_k")
    )
    gain = F.col("_k") - F.col("_c")
    out = other.join(own, keys).groupBy(*by, "n_train", "comparator").agg(
        F.count(gain).alias("pairs"),
        F.avg("_c").alias("candidate_mean_degradation"),
        F.avg("_k").alias("comparator_mean_degradation"),
        F.avg(gain).alias("mean_advantage"),
        F.count_if(gain > 0).alias("wins"),
    )
    passed = (
        (F.col("pairs") == bundles)
        & (F.col("candidate_mean_degradation") < F.col("comparator_mean_degradation"))
        & (F.col("wins") >= wins_required)
    )
    return out.withColumn("win_fraction", F.col("wins") / F.lit(float(bundles))).withColumn("passed", passed)


def misspecification(
    areas: DataFrame,
    candidate: str,
    comparators: list[str],
    *,
    by: tuple[str, ...] = ("world",),
) -> DataFrame:
    """Per bundle: the best control and the candidate's relative excess over it."""
    keys = [*by, *BUNDLE]
    wide = areas.groupBy(*keys).agg(
        *[F.max(F.when(F.col("model") == m, F.col("naulc"))).alias(m) for m in (candidate, *comparators)]
    )
    best = F.least(*[F.col(c) for c in comparators])
    named = F.coalesce(*[F.when(F.col(c) == best, F.lit(c)) for c in comparators])
    return wide.withColumn("best_control", named).withColumn("best_naulc", best).withColumn(
        "relative_excess",
        F.when(F.col("best_naulc") > 0, (F.col(candidate) - F.col("best_naulc")) / F.col("best_naulc")),
    )


def misspecification_summary(
    rows: DataFrame, *, by: tuple[str, ...] = ("world",), tolerance: float = 0.05, bundles: int = 10
) -> DataFrame:
    out = quantiles(
        rows,
        list(by),
        {"median_relative_excess": ("relative_excess", 0.5)},
        extra=[
            F.avg("relative_excess").alias("mean_relative_excess"),
            F.count("relative_excess").alias("pairs"),
        ],
    )
    return out.withColumn(
        "passed", (F.col("pairs") == bundles) & (F.col("mean_relative_excess") <= tolerance)
    )


def verify_gate(
    recorded: DataFrame, recomputed: DataFrame, keys: list[str], numbers: list[str], flags: list[str], *, atol: float = 1e-12
) -> DataFrame:
    """Recorded against recomputed values: numbers within ``atol``, flags equal, rows on both sides."""
    left = recorded.select(*keys, *[F.col(c).alias(f"_r_{c}") for c in (*numbers, *flags)], F.lit(True).alias("_r"))
    right = recomputed.select(*keys, *[F.col(c).alias(f"_c_{c}") for c in (*numbers, *flags)], F.lit(True).alias("_c"))
    out = left.join(right, keys, "full")
    same = [
        F.col(f"_r_{c}").eqNullSafe(F.col(f"_c_{c}"))
        | F.coalesce(F.abs(F.col(f"_r_{c}") - F.col(f"_c_{c}")) <= atol, F.lit(False))
        for c in numbers
    ]
    same += [F.col(f"_r_{c}").eqNullSafe(F.col(f"_c_{c}")) for c in flags]
    gap = F.greatest(*[F.abs(F.col(f"_r_{c}") - F.col(f"_c_{c}")) for c in numbers], F.lit(0.0))
    status = (
        F.when(F.col("_c").isNull(), "unexpected")
        .when(F.col("_r").isNull(), "missing")
        .when(reduce(lambda a, b: a & b, same), "verified")
        .otherwise("differs")
    )
    return out.select(*keys, gap.alias("max_abs_gap"), status.alias("status"))


def stage_timings(invocations: DataFrame) -> DataFrame:
    """Invocation count and wall time per stage."""
    return invocations.groupBy("stage").agg(
        F.count(F.lit(1)).alias("invocation_count"),
        F.sum("wall_time_seconds").alias("wall_time_seconds"),
    )


def execution_failures(invocations: DataFrame) -> DataFrame:
    """One row per failure of every invocation."""
    return invocations.select(
        "invocation_number", "stage", F.explode("failures").alias("f")
    ).select("invocation_number", "stage", F.col("f.type").alias("type"), F.col("f.message").alias("message"))


def run_completeness(plan: DataFrame, completed: DataFrame, status: DataFrame, *, by: tuple[str, ...] = ()) -> DataFrame:
    """Cells and shards: expected, completed, failed, cancelled, incomplete.

    ``plan`` has ``shard_id, cell_id``; ``completed`` has ``cell_id``; ``status`` has
    ``shard_id, state`` for shards that failed or were cancelled.
    """
    done = completed.select("cell_id", F.lit(1).alias("_done")).distinct()
    shards = (
        plan.join(done, "cell_id", "left")
        .groupBy(*by, "shard_id")
        .agg(F.count(F.lit(1)).alias("_cells"), F.count("_done").alias("_done"))
        .join(status, "shard_id", "left")
    )
    full = F.col("_done") == F.col("_cells")
    out = shards.groupBy(*by).agg(
        F.count(F.lit(1)).alias("expected_shards"),
        F.count_if(full).alias("completed_shards"),
        F.count_if(~full & F.coalesce(F.col("state") == "failed", F.lit(False))).alias("failed_shards"),
        F.count_if(~full & F.coalesce(F.col("state") == "cancelled", F.lit(False))).alias("cancelled_shards"),
        F.count_if(~full & F.col("state").isNull()).alias("incomplete_shards"),
        F.sum("_cells").alias("expected_cells"),
        F.sum("_done").alias("completed_cells"),
    )
    return out.withColumn(
        "percent_complete", F.lit(100.0) * F.col("completed_cells") / F.col("expected_cells")
    )
