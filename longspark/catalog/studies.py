"""Queries over a tidy metric table derived from ``lineitem``."""

from __future__ import annotations

from pyspark.sql import functions as F

from longspark.catalog.fixtures import R, r6, rounded, table
from longspark.catalog.registry import query
from longspark.operators import gates, tidy
from longspark.schema import BUNDLE

SIZES = [5, 10, 20, 40]
MODELS = ["candidate", "control_a", "control_b"]
CONTROLS = MODELS[1:]
METRICS = ["mae", "rmse", "nll", "coverage_90", "event_brier", "latent_aligned_r2"]
KEYS = ["world", "n_train", "model", "ablation", "site_or_shift", "cohort_seed", "subset_seed", "model_seed"]


def study(spark, sf):
    """Metric rows: every line item scores its tax as a forecast of its discount.

    World, bundle, size, model, ablation and site come from the item's keys and flags.
    """
    at = F.col("l_partkey") % 4
    size = F.element_at(F.array(*map(F.lit, SIZES)), (at + 1).cast("int")).cast("bigint")
    model = F.element_at(F.array(*map(F.lit, MODELS)), (F.col("l_linenumber") % 3 + 1).cast("int"))
    unit = F.col("l_suppkey") % 10
    site = F.concat(F.lit("site_"), (F.col("l_orderkey") % 2).cast("string"))
    rows = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("world"),
        size.alias("n_train"),
        model.alias("model"),
        F.when(F.col("l_linestatus") == "F", "none").otherwise("no_jump").alias("ablation"),
        F.explode(F.array(F.lit("all"), site)).alias("site_or_shift"),
        (unit + 401).alias("cohort_seed"),
        (unit + 501).alias("subset_seed"),
        (unit + 601).alias("model_seed"),
        ((F.col("l_discount") - F.col("l_tax")) * 1.0471975511965976).alias("e"),
        (F.col("l_quantity") / 51.37).alias("q"),
    )
    e = F.col("e")
    agg = rows.groupBy(*KEYS).agg(
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.lit(0.5) * e * e / F.lit(0.0025) - F.lit(2.0)).alias("nll"),
        F.avg((F.abs(e) <= 0.0759).cast("double")).alias("coverage_90"),
        F.avg((F.col("q") - 0.5) * (F.col("q") - 0.5)).alias("event_brier"),
        F.avg("q").alias("latent_aligned_r2"),
    )
    factor = (
        F.when(F.col("model") == "candidate", 0.8).when(F.col("model") == "control_a", 1.0).otherwise(1.02)
        * (F.lit(1.0) + F.lit(2.0) / F.col("n_train"))
        * F.when(F.col("ablation") == "none", 1.0).otherwise(1.05)
    )
    scaled = agg.withColumns({m: F.col(m) * factor for m in ("mae", "rmse")})
    tidy_rows = scaled.unpivot(KEYS, METRICS, "metric", "value")
    held = F.greatest(F.lit(1), F.floor(F.col("n_train") / 5)).cast("bigint")
    parameters = F.when(F.col("model") == "candidate", 4804).when(
        F.col("model") == "control_a", 4713
    ).otherwise(4850) - F.when(F.col("ablation") == "none", 0).otherwise(60)
    return tidy_rows.withColumns(
        {
            "n_validation": held,
            "n_fit": F.col("n_train") - held,
            "seed": F.col("subset_seed"),
            "split": F.lit("test"),
            "trainable_parameters": parameters.cast("bigint"),
            "backend": F.lit("spark"),
            "benchmark": F.when(F.col("site_or_shift") == "all", "low_n").otherwise("observation_shift"),
        }
    )


_FACTOR = (
    "(CASE model WHEN 'candidate' THEN 0.8::DOUBLE WHEN 'control_a' THEN 1.0::DOUBLE ELSE 1.02::DOUBLE END"
    " * (1.0::DOUBLE + 2.0::DOUBLE / n_train) * CASE ablation WHEN 'none' THEN 1.0::DOUBLE ELSE 1.05::DOUBLE END)"
)
STUDY = f"""st0 AS (SELECT l_returnflag AS world, CAST(([5, 10, 20, 40])[l_partkey % 4 + 1] AS BIGINT) AS n_train,
 (['candidate', 'control_a', 'control_b'])[l_linenumber % 3 + 1] AS model,
 CASE l_linestatus WHEN 'F' THEN 'none' ELSE 'no_jump' END AS ablation,
 unnest(['all', 'site_' || (l_orderkey % 2)]) AS site_or_shift, 401 + l_suppkey % 10 AS cohort_seed,
 501 + l_suppkey % 10 AS subset_seed, 601 + l_suppkey % 10 AS model_seed, (l_discount - l_tax) * 1.0471975511965976::DOUBLE AS e,
 l_quantity / 51.37::DOUBLE AS q FROM lineitem),
st1 AS (SELECT * REPLACE (mae * {_FACTOR} AS mae, rmse * {_FACTOR} AS rmse) FROM
 (SELECT world, n_train, model, ablation, site_or_shift, cohort_seed, subset_seed, model_seed,
 avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse,
 avg(0.5::DOUBLE * e * e / 0.0025::DOUBLE - 2.0::DOUBLE) AS nll,
 avg(CASE WHEN abs(e) <= 0.0759::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS coverage_90,
 avg((q - 0.5::DOUBLE) * (q - 0.5::DOUBLE)) AS event_brier, avg(q) AS latent_aligned_r2 FROM st0 GROUP BY ALL)),
study AS (SELECT u.*, greatest(1, n_train // 5) AS n_validation, n_train - greatest(1, n_train // 5) AS n_fit,
 subset_seed AS seed, 'test' AS split, CAST(CASE model WHEN 'candidate' THEN 4804 WHEN 'control_a' THEN 4713 ELSE 4850 END
 - CASE ablation WHEN 'none' THEN 0 ELSE 60 END AS BIGINT) AS trainable_parameters, 'spark' AS backend,
 CASE site_or_shift WHEN 'all' THEN 'low_n' ELSE 'observation_shift' END AS benchmark
 FROM (UNPIVOT st1 ON mae, rmse, nll, coverage_90, event_brier, latent_aligned_r2 INTO NAME metric VALUE value) u)"""
FULL = f"{STUDY}, fullm AS (SELECT * FROM study WHERE site_or_shift = 'all' AND ablation = 'none')"
MAE = f"{FULL}, mae AS (SELECT * FROM fullm WHERE metric = 'mae')"


def full(spark, sf):
    return tidy.metric_slice(study(spark, sf), site_or_shift="all", ablation="none")


def mae(spark, sf):
    return tidy.metric_slice(full(spark, sf), metric="mae")


def _stats(v: str) -> str:
    return (
        f"{R(f'avg({v})')} AS mean, {R(f'median({v})')} AS median, {R(f'stddev_samp({v})')} AS std,"
        f" {R(f'min({v})')} AS min, {R(f'max({v})')} AS max, count({v}) AS n"
    )


_STATS = ["mean", "median", "std", "min", "max"]

ALL_KEYS = [
    "model", "ablation", "n_train", "n_fit", "n_validation", "seed", "cohort_seed", "subset_seed",
    "model_seed", "split", "site_or_shift", "metric", "world", "benchmark",
]


@query(
    "metric_slice",
    f"WITH {STUDY} SELECT world, n_train, model, cohort_seed, {R('value')} AS value FROM study"
    " WHERE benchmark = 'low_n' AND site_or_shift = 'all' AND ablation = 'none' AND metric = 'mae' AND n_train IN (5, 10, 20, 40)",
)
def _(spark, sf):
    out = tidy.metric_slice(
        study(spark, sf),
        benchmark="low_n",
        site_or_shift="all",
        ablation="none",
        metric="mae",
        n_train=SIZES,
    )
    return rounded(out.select("world", "n_train", "model", "cohort_seed", "value"), "value")


@query(
    "optional_filters",
    f"WITH {STUDY} SELECT count(*) AS n, {R('sum(value)')} AS total FROM study WHERE site_or_shift = 'all'",
)
def _(spark, sf):
    out = tidy.optional_filters(study(spark, sf), site_or_shift="all", absent_column="x")
    return rounded(out.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), "total")


@query(
    "summarize",
    "SELECT l_suppkey, l_returnflag, " + _stats("l_extendedprice") + " FROM lineitem GROUP BY 1, 2",
)
def _(spark, sf):
    out = tidy.summarize(table(spark, sf, "lineitem"), ["l_suppkey", "l_returnflag"], "l_extendedprice")
    return rounded(out, *_STATS)


_SUMMARY_KEYS = ["world", "n_train", "model", "site_or_shift", "metric"]
_ALL_SUMMARY = f"SELECT world, n_train, model, site_or_shift, metric, {_stats('value')} FROM study WHERE ablation = 'none' GROUP BY 1, 2, 3, 4, 5"


def _all_summary(spark, sf):
    return tidy.summarize(tidy.metric_slice(study(spark, sf), ablation="none"), _SUMMARY_KEYS)


@query("all_metric_summary", f"WITH {STUDY} {_ALL_SUMMARY}")
def _(spark, sf):
    return rounded(_all_summary(spark, sf), *_STATS)


@query("primary_mae", f"WITH {MAE} SELECT world, n_train, model, {_stats('value')} FROM mae GROUP BY 1, 2, 3")
def _(spark, sf):
    return rounded(tidy.summarize(mae(spark, sf), ["world", "n_train", "model"]), *_STATS)


_WIDE_KEYS = ["world", "n_train", *BUNDLE]
_WK = ", ".join(_WIDE_KEYS)
WIDE = f"{MAE}, wide AS (SELECT {_WK}, " + ", ".join(
    f"any_value(value) FILTER (WHERE model = '{m}') AS {m}" for m in MODELS
) + f" FROM mae GROUP BY {_WK})"


def wide(spark, sf):
    return tidy.pivot_models(mae(spark, sf), _WIDE_KEYS, MODELS)


@query("pivot_models", f"WITH {WIDE} SELECT {_WK}, " + ", ".join(f"{R(m)} AS {m}" for m in MODELS) + " FROM wide")
def _(spark, sf):
    return rounded(wide(spark, sf), *MODELS)


EFFECTS = f"{WIDE}, eff AS (SELECT *, " + ", ".join(
    f"{c} - candidate AS delta_vs_{c}, ({c} - candidate) / {c} AS relative_vs_{c}, {c} - candidate > 0 AS beats_{c}"
    for c in CONTROLS
) + ", candidate < control_a AND candidate < control_b AS beats_all FROM wide)"


def effects(spark, sf):
    return tidy.paired_effects(wide(spark, sf), "candidate", CONTROLS)


_EFF_NUM = [*MODELS, *[f"{k}_vs_{c}" for c in CONTROLS for k in ("delta", "relative")]]


@query(
    "paired_effects",
    f"WITH {EFFECTS} SELECT {_WK}, " + ", ".join(f"{R(c)} AS {c}" for c in _EFF_NUM)
    + ", beats_control_a, beats_control_b, beats_all FROM eff",
)
def _(spark, sf):
    return rounded(effects(spark, sf), *_EFF_NUM)


WINS = f"{EFFECTS}, win AS (SELECT world, n_train, " + ", ".join(
    [f"avg({m}) AS mean_{m}" for m in MODELS]
    + [f"count(*) FILTER (WHERE beats_{c}) AS wins_vs_{c}, avg(delta_vs_{c}) AS mean_delta_vs_{c}" for c in CONTROLS]
) + (
    ", count(*) FILTER (WHERE beats_all) AS wins_vs_all, count(*) AS n_bundles,"
    " avg(candidate) < avg(control_a) AS beats_control_a_on_mean, avg(candidate) < avg(control_b) AS beats_control_b_on_mean,"
    " avg(candidate) < avg(control_a) AND avg(candidate) < avg(control_b) AS beats_all_on_mean FROM eff GROUP BY 1, 2)"
)
_WIN_NUM = [*[f"mean_{m}" for m in MODELS], *[f"mean_delta_vs_{c}" for c in CONTROLS]]


def wins(spark, sf):
    return tidy.win_matrix(effects(spark, sf), ["world", "n_train"], "candidate", CONTROLS)


@query(
    "win_matrix",
    f"WITH {WINS} SELECT * REPLACE (" + ", ".join(f"{R(c)} AS {c}" for c in _WIN_NUM) + ") FROM win",
)
def _(spark, sf):
    return rounded(wins(spark, sf), *_WIN_NUM)


# one world lacks a comparator, so its flag is unknown
_GATE = (
    f"{MAE}, gate AS (SELECT world, n_train, avg(value) FILTER (WHERE model = 'candidate') AS candidate,"
    " avg(value) FILTER (WHERE model = 'control_a') AS control_a,"
    " avg(value) FILTER (WHERE model = 'control_b' AND world <> 'N') AS control_b FROM mae GROUP BY 1, 2)"
)


def _gate(spark, sf):
    rows = mae(spark, sf).where(~((F.col("world") == "N") & (F.col("model") == "control_b")))
    return tidy.gate_summary(rows, ["world", "n_train"], "candidate", CONTROLS)


@query(
    "gate_summary",
    f"WITH {_GATE} SELECT world, n_train, "
    + ", ".join(f"CASE WHEN {m} IS NULL THEN NULL ELSE {R(m)} END AS {m}" for m in MODELS)
    + ", CASE WHEN control_b IS NULL THEN NULL ELSE candidate < control_a AND candidate < control_b END AS beats_all FROM gate",
)
def _(spark, sf):
    return rounded(_gate(spark, sf), *MODELS)


@query(
    "gate_check",
    f"WITH {_GATE}, rec AS (SELECT world, n_train, CASE WHEN control_b IS NULL THEN NULL ELSE candidate < control_a AND candidate < control_b END AS f FROM gate),"
    " again AS (SELECT world, n_train, avg(value) FILTER (WHERE model = 'candidate') < avg(value) FILTER (WHERE model = 'control_a')"
    " AND avg(value) FILTER (WHERE model = 'candidate') < avg(value) FILTER (WHERE model = 'control_b') AS g FROM mae GROUP BY 1, 2)"
    " SELECT world, n_train, f AS beats_all, g AS recomputed_beats_all, f IS NOT DISTINCT FROM g AS agrees"
    " FROM rec LEFT JOIN again USING (world, n_train)",
)
def _(spark, sf):
    again = tidy.gate_summary(mae(spark, sf), ["world", "n_train"], "candidate", CONTROLS)
    return tidy.gate_check(_gate(spark, sf), again, ["world", "n_train"], "beats_all")


@query(
    "learning_curve",
    f"WITH {MAE} SELECT world, model, n_train, {R('avg(value)')} AS mean, {R('stddev_samp(value)')} AS sd,"
    " count(value) AS n FROM mae GROUP BY 1, 2, 3",
)
def _(spark, sf):
    return rounded(tidy.learning_curve(mae(spark, sf), ["world", "model", "n_train"]), "mean", "sd")


@query(
    "mean_plot_data",
    f"WITH {MAE} SELECT model, n_train, {R('avg(value)')} AS mean, count(value) AS n,"
    f" {R('avg(value) - coalesce(stddev_samp(value), 0)')} AS low, {R('avg(value) + coalesce(stddev_samp(value), 0)')} AS high"
    " FROM mae GROUP BY 1, 2",
)
def _(spark, sf):
    return rounded(tidy.mean_plot_data(mae(spark, sf), ["model", "n_train"]), "mean", "low", "high")


@query(
    "parameter_counts",
    f"WITH {STUDY} SELECT model, min(trainable_parameters) AS minimum_parameters, max(trainable_parameters) AS maximum_parameters,"
    f" {R('median(trainable_parameters)')} AS median_parameters, count(*) AS n_rows,"
    " min(trainable_parameters) = max(trainable_parameters) AS constant_parameter_count FROM study GROUP BY 1",
)
def _(spark, sf):
    return rounded(tidy.parameter_counts(study(spark, sf), ["model"]), "median_parameters")


@query("distinct_budgets", f"WITH {STUDY} SELECT DISTINCT n_train, n_fit, n_validation FROM study")
def _(spark, sf):
    return tidy.distinct_budgets(study(spark, sf))


@query(
    "calibration_summary",
    f"WITH {STUDY}, s AS (SELECT world, n_train, model, site_or_shift, metric, avg(value) AS m FROM study WHERE ablation = 'none' GROUP BY ALL)"
    f" SELECT world, n_train, model, site_or_shift, metric, {R('m')} AS mean,"
    f" CASE WHEN metric = 'coverage_90' THEN {R('abs(m - 0.9::DOUBLE)')} END AS coverage_abs_error"
    " FROM s WHERE metric IN ('nll', 'coverage_90')",
)
def _(spark, sf):
    out = tidy.calibration_summary(_all_summary(spark, sf))
    return rounded(
        out.select(*_SUMMARY_KEYS, "mean", "coverage_abs_error"), "mean", "coverage_abs_error"
    )


@query(
    "metric_subsets",
    f"WITH {STUDY} SELECT CASE WHEN metric = 'latent_aligned_r2' THEN 'latent' WHEN metric LIKE 'event_%' THEN 'event'"
    " WHEN site_or_shift <> 'all' THEN 'site_shift' WHEN n_train < 40 THEN 'low_n' ELSE 'rest' END AS subset,"
    f" metric, count(*) AS n, {R('avg(value)')} AS mean FROM study GROUP BY 1, 2",
)
def _(spark, sf):
    out = tidy.metric_subsets(study(spark, sf))
    return rounded(out, "mean")


def _oriented(metric: str, control: str, cand: str) -> str:
    return (
        f"CASE WHEN {metric} IN ('mae', 'rmse', 'nll', 'event_brier') THEN {control} - {cand}"
        f" WHEN {metric} = 'latent_aligned_r2' THEN {cand} - {control}"
        f" ELSE abs({control} - 0.9::DOUBLE) - abs({cand} - 0.9::DOUBLE) END"
    )


_AK = ", ".join(ALL_KEYS)
_ABL = (
    f"{STUDY}, ab AS (SELECT a.*, f.value AS full_value, f.trainable_parameters AS full_parameters FROM study a LEFT JOIN study f ON "
    + " AND ".join(f"a.{k} = f.{k}" for k in ALL_KEYS if k != "ablation")
    + " AND f.ablation = 'none' WHERE a.ablation <> 'none'),"
    f" ap AS (SELECT *, value - full_value AS raw_delta, {_oriented('metric', 'value', 'full_value')} AS benefit FROM ab)"
)
_PAIR_KEYS = [k for k in ALL_KEYS if k != "ablation"]


def _ablations(spark, sf):
    rows = study(spark, sf)
    return tidy.ablation_pairs(
        rows.where(F.col("ablation") != "none"), rows.where(F.col("ablation") == "none"), _PAIR_KEYS
    )


@query(
    "ablation_pairs",
    f"WITH {_ABL} SELECT world, n_train, model, site_or_shift, cohort_seed, metric, ablation,"
    f" {R('value')} AS ablated_value, trainable_parameters AS ablated_parameters, CASE WHEN full_value IS NULL THEN NULL ELSE {R('full_value')} END AS full_value,"
    f" full_parameters, full_value IS NOT NULL AS paired, CASE WHEN full_value IS NULL THEN NULL ELSE {R('raw_delta')} END AS raw_delta,"
    f" CASE WHEN full_value IS NULL THEN NULL ELSE {R('benefit')} END AS benefit FROM ap",
)
def _(spark, sf):
    out = _ablations(spark, sf).select(
        "world", "n_train", "model", "site_or_shift", "cohort_seed", "metric", "ablation",
        "ablated_value", "ablated_parameters", "full_value", "full_parameters", "paired", "raw_delta", "benefit",
    )
    return rounded(out, "ablated_value", "full_value", "raw_delta", "benefit")


@query(
    "ablation_summary",
    f"WITH {_ABL} SELECT ablation, metric, world, n_train, {R('avg(raw_delta)')} AS mean_delta, {R('median(raw_delta)')} AS median_delta,"
    f" {R('stddev_samp(raw_delta)')} AS sd_delta, {R('avg(benefit)')} AS mean_benefit, {R('median(benefit)')} AS median_benefit,"
    f" {R('stddev_samp(benefit)')} AS sd_benefit, count(*) AS n FROM ap GROUP BY 1, 2, 3, 4",
)
def _(spark, sf):
    out = tidy.ablation_summary(_ablations(spark, sf), ["ablation", "metric", "world", "n_train"])
    return rounded(out, *[f"{a}_{b}" for a in ("mean", "median", "sd") for b in ("delta", "benefit")])


@query(
    "headline_table",
    f"WITH {WINS} SELECT world, n_train, " + ", ".join(f"{R('mean_' + m)} AS mean_{m}" for m in MODELS)
    + ", wins_vs_all, beats_all_on_mean, n_bundles = 10 AS complete FROM win",
)
def _(spark, sf):
    out = tidy.headline_table(wins(spark, sf), ["world", "n_train"], "candidate", CONTROLS, bundles=10)
    return rounded(out, *[f"mean_{m}" for m in MODELS])


_ORIENTED = (
    f"{FULL}, oe AS (SELECT c.world, c.cohort_seed, c.subset_seed, c.model_seed, c.n_train, c.metric, c.model AS candidate,"
    f" c.value AS candidate_value, k.value AS control_value, {_oriented('c.metric', 'k.value', 'c.value')} AS effect"
    " FROM fullm c JOIN fullm k USING (world, cohort_seed, subset_seed, model_seed, n_train, metric)"
    " WHERE k.model = 'control_b' AND c.model <> 'control_b')"
)


def oriented(spark, sf):
    return tidy.oriented_effects(full(spark, sf), ["candidate", "control_a"], "control_b", by=("world",))


@query(
    "oriented_effects",
    f"WITH {_ORIENTED} SELECT * REPLACE ({R('candidate_value')} AS candidate_value, {R('control_value')} AS control_value,"
    f" {R('effect')} AS effect), effect > 0 AS candidate_better FROM oe",
)
def _(spark, sf):
    return rounded(oriented(spark, sf), "candidate_value", "control_value", "effect")


@query(
    "effect_summary",
    f"WITH {_ORIENTED} SELECT world, candidate, n_train, metric, {R('avg(candidate_value)')} AS candidate_mean,"
    f" {R('avg(control_value)')} AS control_mean, {R('avg(effect)')} AS mean_effect, {R('median(effect)')} AS median_effect,"
    f" {R('stddev_samp(effect)')} AS sd_effect, count(*) FILTER (WHERE effect > 0) AS wins, count(*) AS n,"
    f" {R('count(*) FILTER (WHERE effect > 0) / count(*)::DOUBLE')} AS win_fraction FROM oe GROUP BY 1, 2, 3, 4",
)
def _(spark, sf):
    out = tidy.effect_summary(oriented(spark, sf), ["world", "candidate", "n_train", "metric"])
    return rounded(
        out, "candidate_mean", "control_mean", "mean_effect", "median_effect", "sd_effect", "win_fraction"
    )


@query(
    "locked_order",
    f"WITH {MAE} SELECT world, n_train, model, cohort_seed, {R('value')} AS value,"
    " CASE world WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END::BIGINT AS world_rank FROM mae",
)
def _(spark, sf):
    rows = mae(spark, sf).select("world", "n_train", "model", "cohort_seed", "value")
    return rounded(tidy.locked_order(rows, "world", ["R", "A", "N"], "n_train", "model", "cohort_seed"), "value")
