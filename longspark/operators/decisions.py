"""Paired tables of staged studies and the decisions drawn from them, one row per study."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longspark.functions.numeric import pearson
from longspark.operators.variance import EPSILON
from longspark.session import materialize

PROBE_SIZES = (5, 10, 20)
FINAL_SIZE = 40


def _side(column: str, variant: str, value: str) -> Column:
    return F.max(F.when(F.col(column) == variant, F.col(value)))


def paired_table(
    df: DataFrame,
    summaries: DataFrame,
    keys: list[str],
    *,
    control: str,
    candidate: str,
    error: str = "mae",
    score: str = "latent_aligned_r2",
) -> DataFrame:
    """Error and score differences of a pair, its winner, and both sides' epochs.

    ``df`` has ``variant, metric, value``; keys include the seeds and ``n_train``.
    """
    cells = {}
    for metric in (error, score):
        for side, variant in (("control", control), ("candidate", candidate)):
            hit = (F.col("metric") == metric) & (F.col("variant") == variant)
            cells[f"{side}_{metric}"] = F.max(F.when(hit, F.col("value")))
    out = df.groupBy(*keys).agg(*[c.alias(n) for n, c in cells.items()])
    delta = F.col(f"control_{error}") - F.col(f"candidate_{error}")
    out = out.withColumns(
        {
            "delta_mae": delta,
            "delta_r2": F.col(f"candidate_{score}") - F.col(f"control_{score}"),
            "winner": F.when(delta > 0, candidate).when(delta < 0, control).otherwise("tie"),
            "bundle": F.concat_ws("-", *[F.col(c).cast("string") for c in ("cohort_seed", "subset_seed", "model_seed")]),
        }
    )
    epochs = []
    for side, variant in (("control", control), ("candidate", candidate)):
        for name, column in (
            ("selected_epoch", "selected_checkpoint_epoch"),
            ("shadow_epoch", "shadow_mae_checkpoint_epoch"),
            ("stop_epoch", "stop_epoch"),
        ):
            epochs.append(_side("variant", variant, column).alias(f"{side}_{name}"))
    wide = summaries.groupBy(*keys).agg(*epochs)
    return out.join(wide, keys)


def reproduction_class(table: DataFrame, by: list[str], *, wins_required: int = 4, losing_wins: int = 2) -> DataFrame:
    """``reproduced`` when small sizes gain nothing and the final size gains with enough wins."""
    final = F.col("n_train") == FINAL_SIZE
    aggs = [
        F.avg(F.when(F.col("n_train") == n, F.col("delta_mae"))).alias(f"mean_delta_n{n}")
        for n in (*PROBE_SIZES, FINAL_SIZE)
    ]
    aggs += [
        F.count_if(final & (F.col("delta_mae") > 0)).alias("final_wins"),
        F.count_if(final).alias("final_bundles"),
    ]
    out = table.groupBy(*by).agg(*aggs)
    small = F.greatest(*[F.col(f"mean_delta_n{n}") for n in PROBE_SIZES]) <= 0
    gains = (F.col(f"mean_delta_n{FINAL_SIZE}") > 0) & (F.col("final_wins") >= wins_required)
    fails = (F.col(f"mean_delta_n{FINAL_SIZE}") <= 0) | (F.col("final_wins") <= losing_wins)
    label = F.when(small & gains, "reproduced").when(fails, "not_reproduced").otherwise("ambiguous")
    return out.withColumn("classification", label)


def array_overlap(left: DataFrame, right: DataFrame, by: list[str], keys: list[str], *, value: str = "delta_mae") -> DataFrame:
    """How far two designs agree on the combinations they share."""
    both = left.select(*by, *keys, F.col(value).alias("_a")).join(
        right.select(*by, *keys, F.col(value).alias("_b")), [*by, *keys]
    )
    gap = F.abs(F.col("_a") - F.col("_b"))
    spread = [(F.max(c) - F.min(c)) > EPSILON for c in ("_a", "_b")]
    usable = (F.count(F.lit(1)) >= 2) & spread[0] & spread[1]
    return both.groupBy(*by).agg(
        F.count(F.lit(1)).alias("overlap_pair_count"),
        F.avg(gap).alias("mean_absolute_difference"),
        F.max(gap).alias("maximum_absolute_difference"),
        F.when(usable, pearson("_a", "_b")).alias("pearson_correlation"),
    )


def array_agreement(classes: DataFrame, by: list[str], *, design: str = "design", designs: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Whether the dominant factors of two designs agree: required at the final size, equal at 5."""
    dominant = F.max(F.when(F.col("factor_classification") == "dominant", F.col("component")))
    found = classes.groupBy(*by, design, "n_train").agg(F.coalesce(dominant, F.lit("none")).alias("_d"))
    cells = {}
    for d in designs:
        for n in (PROBE_SIZES[0], FINAL_SIZE):
            hit = (F.col(design) == d) & (F.col("n_train") == n)
            cells[f"dominant_{d}_n{n}"] = F.max(F.when(hit, F.col("_d")))
    out = found.groupBy(*by).agg(*[c.alias(n) for n, c in cells.items()])
    a, b = designs
    final = (F.col(f"dominant_{a}_n{FINAL_SIZE}") != "none") & (
        F.col(f"dominant_{a}_n{FINAL_SIZE}") == F.col(f"dominant_{b}_n{FINAL_SIZE}")
    )
    first = F.col(f"dominant_{a}_n{PROBE_SIZES[0]}") == F.col(f"dominant_{b}_n{PROBE_SIZES[0]}")
    return out.withColumn("evidence", F.when(final & first, "sufficient").otherwise("insufficient"))


def checkpoint_state(gaps: DataFrame, by: list[str]) -> DataFrame:
    """``strengthened``, ``weakened`` or ``unresolved`` from the checkpoint gaps."""
    out = gaps.groupBy(*by).agg(
        F.avg("d_checkpoint").alias("mean_d"),
        F.count_if(F.col("d_checkpoint") > 0).alias("positive_d"),
        F.count_if(F.col("gap_candidate") > 0).alias("positive_candidate_gap"),
        F.count(F.lit(1)).alias("bundles"),
    )
    state = (
        F.when((F.col("mean_d") > 0) & (F.col("positive_d") >= 4) & (F.col("positive_candidate_gap") >= 4), "strengthened")
        .when((F.col("mean_d") <= 0) & (F.col("positive_d") <= 2), "weakened")
        .otherwise("unresolved")
    )
    return out.withColumn("checkpoint_state", state)


def factor_states(classes: DataFrame, by: list[str], factors: list[str]) -> DataFrame:
    """Per factor: strengthened when dominant and never weak, weakened the other way round."""

    def has(factor: str, label: str) -> Column:
        return F.bool_or((F.col("component") == factor) & (F.col("factor_classification") == label))

    def state(factor: str) -> Column:
        strong, weak = has(factor, "dominant"), has(factor, "weak")
        return F.when(strong & ~weak, "strengthened").when(weak & ~strong, "weakened").otherwise("unresolved")

    return classes.groupBy(*by).agg(*[state(f).alias(f"state_{f}") for f in factors])


def interaction_ambiguity(components: DataFrame, frequencies: DataFrame, by: list[str]) -> DataFrame:
    """True when at some size the residual outweighs every factor, or no factor leads often."""
    share = F.col("variance_share")
    named = F.col("component") != "residual"
    per_size = components.groupBy(*by, "n_train").agg(
        F.max(F.when(~named, share)).alias("_residual"), F.max(F.when(named, share)).alias("_named")
    )
    lead = frequencies.groupBy(*by, "n_train").agg(F.max("largest_frequency").alias("_lead"))
    joined = per_size.join(lead, [*by, "n_train"])
    return joined.groupBy(*by).agg(
        F.bool_or((F.col("_residual") > F.col("_named")) | (F.col("_lead") < 0.80)).alias("interaction_ambiguity")
    )


def sample_complexity_state(shift: DataFrame, *, classification: str, ambiguous: str, pairs: int = 25, wins: int = 20) -> DataFrame:
    """``strong``, ``partial``, ``absent`` or ``unresolved`` from the size shift of a study."""
    label, unclear = F.col(classification), F.col(ambiguous)
    strong = (
        (F.col("mean_delta_low") <= 0)
        & (F.col("mean_delta_high") > 0)
        & (F.col("mean_t") > 0)
        & (F.col("positive_t_count") >= wins)
        & (F.col("ci_lower") > 0)
    )
    partial = (label == "reproduced") & (F.col("mean_t") > 0)
    state = (
        F.when(unclear | (label == "ambiguous"), "unresolved")
        .when((label == "not_reproduced") | (F.col("mean_t") <= 0), "absent")
        .when(F.col("pair_count") != pairs, "unresolved")
        .when(strong, "strong")
        .when(partial & ((F.col("positive_t_count") < wins) | (F.col("ci_lower") <= 0)), "partial")
        .otherwise("unresolved")
    )
    return shift.withColumn("sample_complexity_state", state)


def disconnect_state(table: DataFrame, by: list[str]) -> DataFrame:
    """Whether the error improves without the score improving, at the final size."""
    final = table.where(F.col("n_train") == FINAL_SIZE)
    out = final.groupBy(*by).agg(
        F.avg("delta_mae").alias("mean_delta_mae"),
        F.avg("delta_r2").alias("mean_delta_r2"),
        F.count_if(F.col("delta_mae") > 0).alias("mae_wins"),
        F.count_if(F.col("delta_r2") > 0).alias("r2_wins"),
    )
    better = (F.col("mean_delta_mae") > 0) & (F.col("mae_wins") >= 4)
    state = (
        F.when(better & (F.col("mean_delta_r2") <= 0) & (F.col("r2_wins") <= 2), "strengthened")
        .when(better & (F.col("mean_delta_r2") > 0) & (F.col("r2_wins") >= 4), "weakened")
        .otherwise("unresolved")
    )
    return out.withColumn("disconnect_state", state)


def route(states: DataFrame) -> DataFrame:
    """The follow-ups a study triggers, in order; the first is next, none means STOP.

    Columns: interaction_ambiguity, checkpoint_state, state_model, state_subset, state_cohort,
    sample_complexity_state, disconnect_state.
    """

    def strong(c: str) -> Column:
        return F.col(c) == "strengthened"

    # Follow-up names.
    steps = [
        (F.col("interaction_ambiguity"), "D2B"),
        (strong("checkpoint_state"), "D4_CHECKPOINT"),
        (strong("state_model"), "D4_OPTIMIZATION"),
        (strong("state_subset") | strong("state_cohort"), "D4_DATA_REGIME"),
        (F.col("sample_complexity_state").isin("strong", "partial") | strong("disconnect_state"), "D4_CAPACITY_TIME"),
    ]
    triggered = F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in steps]))
    return states.withColumn("triggered", triggered).withColumn(
        "next_stage", F.coalesce(F.try_element_at("triggered", F.lit(1)), F.lit("STOP"))
    )


def stability_rows(df: DataFrame, summaries: DataFrame, keys: list[str], *, control: str, candidate: str) -> DataFrame:
    """Paired effect of every pair with both sides' selected and stop epochs."""
    effects = df.groupBy(*keys).agg(
        _side("variant", control, "value").alias("control_mae"),
        _side("variant", candidate, "value").alias("candidate_mae"),
    )
    epochs = [
        _side("variant", v, c).alias(f"{s}_{n}")
        for s, v in (("control", control), ("candidate", candidate))
        for n, c in (("selected_epoch", "selected_checkpoint_epoch"), ("stop_epoch", "stop_epoch"))
    ]
    out = effects.join(summaries.groupBy(*keys).agg(*epochs), keys)
    return out.withColumn("delta_mae", F.col("control_mae") - F.col("candidate_mae"))


def margin_summary(effects: DataFrame, by: list[str], value: str = "delta_mae") -> DataFrame:
    """Mean, median, sd and count of the effect per margin label."""
    from longspark.operators.quantiles import quantiles

    return quantiles(
        effects,
        by,
        {"median_delta": (value, 0.5)},
        extra=[
            F.avg(value).alias("mean_delta"),
            F.stddev_samp(value).alias("sd_delta"),
            F.count(value).alias("n"),
        ],
    )


def stability_class(
    effects: DataFrame, interval: DataFrame, by: list[str], *, row: str, col: str, value: str = "delta_mae"
) -> DataFrame:
    """``stable``, ``fragile`` or ``ambiguous``; ``interval`` carries the cluster bootstrap."""
    from longspark.operators.resample import beside

    overall = effects.groupBy(*by).agg(F.avg(value).alias("delta_overall"))
    out = overall
    for label, name in ((col, "positive_models"), (row, "positive_contexts")):
        means = effects.groupBy(*by, label).agg(F.avg(value).alias("_m"))
        out = beside(out, means.groupBy(*by).agg(F.count_if(F.col("_m") > 0).alias(name)), by)
    out = beside(out, interval.select(*by, "ci_lower", "ci_upper"), by)
    stable = (
        (F.col("delta_overall") > 0)
        & (F.col("positive_models") >= 8)
        & (F.col("positive_contexts") >= 4)
        & (F.col("ci_lower") > 0)
    )
    fragile = (F.col("delta_overall") <= 0) | (F.col("positive_models") <= 5) | (F.col("positive_contexts") <= 2)
    label = F.when(stable, "stable").when(fragile, "fragile").otherwise("ambiguous")
    return out.withColumn("classification", label).withColumn(
        "next_stage", F.when(label == "stable", "D4_CAPACITY_TIME").otherwise("STOP")
    )


def interaction_pairs(
    df: DataFrame, keys: list[str], *, control: str, candidate: str, standard: str, forced: str
) -> DataFrame:
    """Four values of a pair (variant x policy) and their differences."""
    cells = []
    for v, vn in ((control, "control"), (candidate, "candidate")):
        for p, pn in ((standard, "standard"), (forced, "forced")):
            hit = (F.col("variant") == v) & (F.col("policy") == p)
            cells.append(F.max(F.when(hit, F.col("value"))).alias(f"mae_{vn}_{pn}"))
    out = df.groupBy(*keys).agg(*cells)
    out = out.withColumns(
        {
            "delta_standard": F.col("mae_control_standard") - F.col("mae_candidate_standard"),
            "delta_forced": F.col("mae_control_forced") - F.col("mae_candidate_forced"),
            "h_candidate": F.col("mae_candidate_standard") - F.col("mae_candidate_forced"),
            "h_control": F.col("mae_control_standard") - F.col("mae_control_forced"),
        }
    )
    return out.withColumn("g", F.col("delta_forced") - F.col("delta_standard"))


def interaction_stats(
    pairs: DataFrame, by: list[str], row: str, col: str, *, resamples: int = 10_000, seed: int = 20260827
) -> DataFrame:
    """Mean interaction, sd ratio, positive counts, and the crossed bootstrap's intervals."""
    from longspark.operators.resample import beside, crossed_bootstrap, residual_sd_ratio

    pairs = materialize(pairs.select(*by, row, col, "delta_standard", "delta_forced", "g"))
    out = pairs.groupBy(*by).agg(F.avg("g").alias("mean_g"), F.count_if(F.col("g") > 0).alias("positive_pairs"))
    for label, name in ((row, "positive_contexts"), (col, "positive_models")):
        means = pairs.groupBy(*by, label).agg(F.avg("g").alias("_m"))
        out = beside(out, means.groupBy(*by).agg(F.count_if(F.col("_m") > 0).alias(name)), by)
    ratio = residual_sd_ratio(pairs, by, row, col, "delta_standard", "delta_forced").select(*by, "ratio")
    boot = crossed_bootstrap(pairs, by, row, col, resamples=resamples, seed=seed)
    return beside(beside(out, ratio, by), boot, by)


def interaction_class(stats: DataFrame) -> DataFrame:
    """Effect and heterogeneity, effect only, or not established; invalid replicates fail closed."""
    effect = (
        (F.col("mean_g") > 0)
        & (F.col("mean_ci_lower") > 0)
        & (F.col("positive_contexts") >= 4)
        & (F.col("positive_models") >= 8)
    )
    calmer = (
        (F.col("valid_replicates") == F.col("resamples"))
        & (F.col("ratio") < 1)
        & (F.col("ratio_ci_upper") < 1)
    )
    label = (
        F.when(~F.coalesce(effect, F.lit(False)), "not_established")
        .when(F.coalesce(calmer, F.lit(False)), "effect_and_heterogeneity")
        .otherwise("effect_only")
    )
    return stats.withColumn("classification", label)
