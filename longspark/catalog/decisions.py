"""Queries over traces, staged pairs and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from longspark.catalog.fixtures import R, rounded, sql_draw, table
from longspark.catalog.gates import _B, PAIRS
from longspark.catalog.registry import query
from longspark.catalog.statistics import (
    _CROSSED, _SHIFT, _SIGN, AR, CLASSES, CX, FACTORS, LEVELS, REPS, SCALE, _boot, _error, _resid,
    arrays, classes, components, interaction, shifts,
)
from longspark.catalog.studies import FULL, full
from longspark.operators import decisions, resample, traces, variance
from longspark.plans import reports
from longspark.session import materialize

PATIENCE = 3
RUN = ["context", "model_seed", "variant"]
PAIR = ["context", "model_seed"]
FIELDS = ["gradient_l2_norm", "parameter_l2_norm", "displacement"]

_E = f"abs(l_discount - l_tax) * {SCALE}::DOUBLE"
_TRACE_VALUES = (
    f"avg({_E}) AS core_loss, avg(l_tax * {SCALE}::DOUBLE) AS validation_mae, avg(l_quantity / 51.37::DOUBLE) AS gradient_l2_norm,"
    " avg(l_extendedprice / 51370.0::DOUBLE) AS parameter_l2_norm, avg(l_discount * 0.733::DOUBLE) AS displacement"
)
_VARIANT = "CASE l_linestatus WHEN 'F' THEN 'control' ELSE 'candidate' END"


def _trace_sql(name: str, keys: str, exprs: str) -> str:
    return f"{name} AS (SELECT {exprs}, month(l_shipdate)::BIGINT AS epoch, {_TRACE_VALUES} FROM lineitem GROUP BY {keys}, epoch)"


TR = _trace_sql("tr", "context, model_seed, variant", f"l_suppkey % 5 AS context, l_partkey % 10 AS model_seed, {_VARIANT} AS variant")


def _best_sql(trace: str, run: str) -> str:
    """CTEs bs (best so far) and sm (run summaries)."""
    w = f"(PARTITION BY {run} ORDER BY epoch)"
    return (
        f"b0 AS (SELECT *, row_number() OVER {w} AS pos, min(core_loss) OVER {w} AS best_loss, min(validation_mae) OVER {w} AS best_mae FROM {trace}),"
        f" b1 AS (SELECT *, CASE WHEN core_loss = best_loss AND (lag(best_loss) OVER {w} IS NULL OR core_loss < lag(best_loss) OVER {w}) THEN epoch END AS be,"
        f" CASE WHEN core_loss = best_loss AND (lag(best_loss) OVER {w} IS NULL OR core_loss < lag(best_loss) OVER {w}) THEN pos END AS bp,"
        f" CASE WHEN validation_mae = best_mae AND (lag(best_mae) OVER {w} IS NULL OR validation_mae < lag(best_mae) OVER {w}) THEN epoch END AS se FROM b0),"
        f" bs AS (SELECT * EXCLUDE (be, bp, se), last_value(be IGNORE NULLS) OVER {w} AS best_epoch, pos - last_value(bp IGNORE NULLS) OVER {w} AS stale_epochs,"
        f" last_value(se IGNORE NULLS) OVER {w} AS shadow_epoch FROM b1),"
        f" stp AS (SELECT {run}, min(epoch) FILTER (WHERE stale_epochs >= {PATIENCE}) AS patience_epoch, max(epoch) AS last_epoch FROM bs GROUP BY {run}),"
        f" sm AS (SELECT {run}, arg_min(epoch, [core_loss, epoch]) AS selected_checkpoint_epoch, arg_min(epoch, [validation_mae, epoch]) AS shadow_mae_checkpoint_epoch,"
        " any_value(coalesce(patience_epoch, last_epoch)) AS stop_epoch,"
        " CASE WHEN any_value(patience_epoch) IS NOT NULL THEN 'patience_exhausted' ELSE 'max_epochs_reached' END AS early_stop_reason"
        f" FROM bs JOIN stp USING ({run}) WHERE epoch <= coalesce(patience_epoch, last_epoch) GROUP BY {run})"
    )


TRACE = f"{TR}, {_best_sql('tr', 'context, model_seed, variant')}"


def _aggregated_trace(spark, sf, keys: dict):
    q = F.avg(F.col("l_quantity") / 51.37)
    return (
        table(spark, sf, "lineitem")
        .groupBy(*[c.alias(n) for n, c in keys.items()], F.month("l_shipdate").cast("bigint").alias("epoch"))
        .agg(
            F.avg(_error()).alias("core_loss"),
            F.avg(F.col("l_tax") * SCALE).alias("validation_mae"),
            q.alias("gradient_l2_norm"),
            F.avg(F.col("l_extendedprice") / 51370.0).alias("parameter_l2_norm"),
            F.avg(F.col("l_discount") * 0.733).alias("displacement"),
        )
    )


def trace(spark, sf):
    return materialize(_trace(spark, sf))


def _trace(spark, sf):
    return _aggregated_trace(
        spark,
        sf,
        {
            "context": F.col("l_suppkey") % 5,
            "model_seed": F.col("l_partkey") % 10,
            "variant": F.when(F.col("l_linestatus") == "F", "control").otherwise("candidate"),
        },
    )


def best(spark, sf):
    return traces.best_so_far(trace(spark, sf), RUN, "core_loss", shadow="validation_mae")


def summaries(spark, sf):
    return traces.run_summary(best(spark, sf), RUN, "core_loss", "validation_mae", PATIENCE)


@query(
    "best_so_far",
    f"WITH {TRACE} SELECT context, model_seed, variant, epoch, {R('best_loss')} AS best_loss, best_epoch, stale_epochs, shadow_epoch FROM bs",
)
def _(spark, sf):
    return rounded(best(spark, sf).select(*RUN, "epoch", "best_loss", "best_epoch", "stale_epochs", "shadow_epoch"), "best_loss")


@query("patience_stop", f"WITH {TRACE} SELECT * FROM stp")
def _(spark, sf):
    return traces.patience_stop(best(spark, sf), RUN, PATIENCE)


@query("run_summary", f"WITH {TRACE} SELECT * FROM sm")
def _(spark, sf):
    return summaries(spark, sf)


# the trace of each user: an event is an epoch, its value the loss; one field divides by zero
_UT = (
    "ut AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos,"
    " CASE WHEN event_type = 'error' THEN event_id - 3 ELSE event_id END AS epoch, CASE WHEN event_type = 'view' AND value < 2 THEN 'NaN'::DOUBLE ELSE value END AS loss FROM events)"
)


@query(
    "trace_check",
    f"WITH {_UT}, g AS (SELECT *, lag(epoch) OVER (PARTITION BY user_id ORDER BY event_id) AS pe FROM ut),"
    " s AS (SELECT user_id, max(event_id) AS stop_epoch, min(event_id) AS sel FROM events GROUP BY 1)"
    " SELECT g.user_id, count(*) FILTER (WHERE epoch <= pe) AS not_increasing, count(*) FILTER (WHERE epoch <= 0) AS not_positive,"
    " count(*) FILTER (WHERE isnan(loss)) AS not_finite, max(epoch) >= any_value(stop_epoch) AS consistent FROM g JOIN s USING (user_id) GROUP BY 1",
)
def _(spark, sf):
    e = table(spark, sf, "events")
    rows = e.select(
        "user_id",
        "event_id",
        F.when(F.col("event_type") == "error", F.col("event_id") - 3).otherwise(F.col("event_id")).alias("epoch"),
        F.when((F.col("event_type") == "view") & (F.col("value") < 2), float("nan")).otherwise(F.col("value")).alias("loss"),
    )
    ends = e.groupBy("user_id").agg(
        F.max("event_id").alias("stop_epoch"),
        F.min("event_id").alias("selected_checkpoint_epoch"),
        F.min("event_id").alias("shadow_mae_checkpoint_epoch"),
    )
    return traces.trace_check(rows, ends, ["user_id"], ["loss"], order="event_id")


_EFF = (
    f"{TRACE}, ef AS (SELECT context, model_seed, avg(validation_mae) FILTER (WHERE variant = 'control') AS control_mae,"
    " avg(validation_mae) FILTER (WHERE variant = 'candidate') AS candidate_mae,"
    " avg(validation_mae) FILTER (WHERE variant = 'control') - avg(validation_mae) FILTER (WHERE variant = 'candidate') AS delta_mae FROM tr GROUP BY 1, 2)"
)


def cell_values(spark, sf):
    return trace(spark, sf).groupBy(*RUN).agg(F.avg("validation_mae").alias("value"))


def stability(spark, sf):
    return decisions.stability_rows(
        cell_values(spark, sf), summaries(spark, sf), PAIR, control="control", candidate="candidate"
    )


def _sides(expr: str, name: str) -> str:
    return ", ".join(
        f"max({expr}) FILTER (WHERE variant = '{v}') AS {v}_{name}" for v in ("control", "candidate")
    )


@query(
    "stability_rows",
    f"WITH {_EFF}, ss AS (SELECT context, model_seed, {_sides('selected_checkpoint_epoch', 'selected_epoch')}, {_sides('stop_epoch', 'stop_epoch')} FROM sm GROUP BY 1, 2)"
    f" SELECT context, model_seed, {R('control_mae')} AS control_mae, {R('candidate_mae')} AS candidate_mae, {R('delta_mae')} AS delta_mae,"
    " control_selected_epoch, candidate_selected_epoch, control_stop_epoch, candidate_stop_epoch FROM ef JOIN ss USING (context, model_seed)",
)
def _(spark, sf):
    return rounded(stability(spark, sf), "control_mae", "candidate_mae", "delta_mae")


def _margin(label: str) -> str:
    return (
        f"SELECT '{label}' AS margin, {label} AS label, {R('median(delta_mae)')} AS median_delta, {R('avg(delta_mae)')} AS mean_delta,"
        f" {R('stddev_samp(delta_mae)')} AS sd_delta, count(delta_mae) AS n FROM ef GROUP BY 2"
    )


@query("stability_analysis", f"WITH {_EFF} {_margin('model_seed')} UNION ALL {_margin('context')}")
def _(spark, sf):
    rows = stability(spark, sf)
    parts = [
        decisions.margin_summary(rows, [c]).select(
            F.lit(c).alias("margin"), F.col(c).alias("label"), "median_delta", "mean_delta", "sd_delta", "n"
        )
        for c in ("model_seed", "context")
    ]
    return rounded(parts[0].unionByName(parts[1]), "median_delta", "mean_delta", "sd_delta")


_DISP = ["selected_checkpoint_epoch", "stop_epoch", *[f"mean_{f}" for f in FIELDS]]


@query(
    "dispersion",
    f"WITH {TRACE}, mt AS (SELECT context, model_seed, variant, " + ", ".join(f"avg({f}) AS mean_{f}" for f in FIELDS)
    + " FROM tr GROUP BY 1, 2, 3) SELECT context, variant, count(*) AS runs, "
    + ", ".join(
        f"{R(f'avg({n})')} AS {n}_mean, {R(f'stddev_samp({n})')} AS {n}_std, {R(f'quantile_cont({n}, 0.75) - quantile_cont({n}, 0.25)')} AS {n}_iqr"
        for n in _DISP
    )
    + ", " + ", ".join(f"count(*) FILTER (WHERE early_stop_reason = '{r}') AS {r}_count" for r in ("patience_exhausted", "max_epochs_reached"))
    + " FROM sm JOIN mt USING (context, model_seed, variant) GROUP BY 1, 2",
)
def _(spark, sf):
    out = traces.dispersion(summaries(spark, sf), trace(spark, sf), ["context", "variant"], RUN, FIELDS)
    return rounded(out, *[f"{n}_{s}" for n in _DISP for s in ("mean", "std", "iqr")])


_STABLE = (
    f"{_EFF}, cl AS (SELECT 1 AS one, model_seed, avg(delta_mae) AS d FROM ef GROUP BY 2), {_boot('cl', 'one', 'model_seed', 'd', 20260827)},"
    " sc AS (SELECT (SELECT avg(delta_mae) FROM ef) AS delta_overall, (SELECT count(*) FILTER (WHERE d > 0) FROM cl) AS positive_models,"
    " (SELECT count(*) FILTER (WHERE m > 0) FROM (SELECT avg(delta_mae) AS m FROM ef GROUP BY context)) AS positive_contexts, lo, hi FROM ci)"
)


@query(
    "stability_class",
    f"WITH {_STABLE}, k AS (SELECT *, CASE WHEN delta_overall > 0 AND positive_models >= 8 AND positive_contexts >= 4 AND lo > 0 THEN 'stable'"
    " WHEN delta_overall <= 0 OR positive_models <= 5 OR positive_contexts <= 2 THEN 'fragile' ELSE 'ambiguous' END AS classification FROM sc)"
    f" SELECT {R('delta_overall')} AS delta_overall, positive_models, positive_contexts, {R('lo')} AS ci_lower, {R('hi')} AS ci_upper, classification,"
    " CASE classification WHEN 'stable' THEN 'D4_CAPACITY_TIME' ELSE 'STOP' END AS next_stage FROM k",
)
def _(spark, sf):
    rows = stability(spark, sf)
    interval = resample.cluster_bootstrap(rows, [], "model_seed", "delta_mae", resamples=REPS)
    out = decisions.stability_class(rows, interval, [], row="context", col="model_seed")
    return rounded(out, "delta_overall", "ci_lower", "ci_upper")


_MECH_COLS = {
    "selected_epoch": "selected_checkpoint_epoch",
    "shadow_epoch": "shadow_mae_checkpoint_epoch",
    "stop_epoch": "stop_epoch",
    "selection_shadow_gap": "selected_checkpoint_epoch - shadow_mae_checkpoint_epoch",
    "patience_exhausted": "CAST(early_stop_reason = 'patience_exhausted' AS BIGINT)",
    **{f"prefix_{f}": f"prefix_{f}" for f in FIELDS},
}
_MECH_INT = [m for m in _MECH_COLS if not m.startswith("prefix_")]


@query(
    "pair_mechanisms",
    f"WITH {_EFF}, px AS (SELECT context, model_seed, variant, " + ", ".join(f"avg({f}) AS prefix_{f}" for f in FIELDS)
    + " FROM tr WHERE epoch <= 10 GROUP BY 1, 2, 3), ms AS (SELECT context, model_seed, "
    + ", ".join(_sides(e, n) for n, e in _MECH_COLS.items())
    + " FROM sm JOIN px USING (context, model_seed, variant) GROUP BY 1, 2)"
    f" SELECT context, model_seed, {R('delta_mae')} AS delta_mae, "
    + ", ".join(f"candidate_{n} - control_{n} AS delta_{n}" for n in _MECH_INT)
    + ", " + ", ".join(f"{R(f'candidate_prefix_{f} - control_prefix_{f}')} AS delta_prefix_{f}" for f in FIELDS)
    + " FROM ef JOIN ms USING (context, model_seed)",
)
def _(spark, sf):
    effects = stability(spark, sf).select(*PAIR, "delta_mae")
    out = traces.pair_mechanisms(
        effects, summaries(spark, sf), trace(spark, sf), PAIR, control="control", candidate="candidate", fields=FIELDS
    )
    keep = [f"delta_{n}" for n in _MECH_COLS]
    return rounded(out.select(*PAIR, "delta_mae", *keep), "delta_mae", *[f"delta_prefix_{f}" for f in FIELDS])


@query(
    "checkpoint_gap",
    f"WITH {TRACE}, gp AS (SELECT context, model_seed, variant, max(validation_mae) FILTER (WHERE epoch = selected_checkpoint_epoch)"
    " - max(validation_mae) FILTER (WHERE epoch = shadow_mae_checkpoint_epoch) AS gap FROM tr JOIN sm USING (context, model_seed, variant) GROUP BY 1, 2, 3),"
    " gw AS (SELECT context, model_seed, max(gap) FILTER (WHERE variant = 'control') AS a, max(gap) FILTER (WHERE variant = 'candidate') AS b FROM gp GROUP BY 1, 2)"
    f" SELECT context, model_seed, {R('a')} AS gap_control, {R('b')} AS gap_candidate, {R('b - a')} AS d_checkpoint FROM gw",
)
def _(spark, sf):
    return rounded(_gaps(spark, sf), "gap_control", "gap_candidate", "d_checkpoint")


def _gaps(spark, sf):
    return traces.checkpoint_gap(
        summaries(spark, sf), trace(spark, sf), PAIR, "validation_mae", control="control", candidate="candidate"
    )


# staged pairs: a model against a control, with the epochs of both sides
D1_KEYS = ["world", "cohort_seed", "subset_seed", "model_seed", "n_train"]
_D1 = (
    f"{FULL}, "
    + _trace_sql(
        "t1",
        "world, cohort_seed, subset_seed, model_seed, n_train, variant",
        "l_returnflag AS world, 401 + l_suppkey % 10 AS cohort_seed, 501 + l_suppkey % 10 AS subset_seed, 601 + l_suppkey % 10 AS model_seed,"
        " CAST(([5, 10, 20, 40])[l_partkey % 4 + 1] AS BIGINT) AS n_train, (['candidate', 'control_a', 'control_b'])[l_linenumber % 3 + 1] AS variant",
    )
    + ", " + _best_sql("t1", "world, cohort_seed, subset_seed, model_seed, n_train, variant")
    + f", d0 AS (SELECT world, {_B}, n_train, "
    + ", ".join(
        f"any_value(value) FILTER (WHERE metric = '{m}' AND model = '{v}') AS {s}_{m}"
        for m in ("mae", "latent_aligned_r2")
        for s, v in (("control", "control_a"), ("candidate", "candidate"))
    )
    + f" FROM fullm GROUP BY world, {_B}, n_train), d1 AS (SELECT *, control_mae - candidate_mae AS delta_mae,"
    " candidate_latent_aligned_r2 - control_latent_aligned_r2 AS delta_r2,"
    " CASE WHEN control_mae > candidate_mae THEN 'candidate' WHEN control_mae < candidate_mae THEN 'control_a' ELSE 'tie' END AS winner,"
    " concat_ws('-', cohort_seed, subset_seed, model_seed) AS bundle FROM d0)"
)


def d1_parts(spark, sf):
    at = (F.col("l_partkey") % 4 + 1).cast("int")
    unit = F.col("l_suppkey") % 10
    t = _aggregated_trace(
        spark,
        sf,
        {
            "world": F.col("l_returnflag"),
            "cohort_seed": unit + 401,
            "subset_seed": unit + 501,
            "model_seed": unit + 601,
            "n_train": F.element_at(F.array(*map(F.lit, (5, 10, 20, 40))), at).cast("bigint"),
            "variant": F.element_at(
                F.array(*map(F.lit, ("candidate", "control_a", "control_b"))), (F.col("l_linenumber") % 3 + 1).cast("int")
            ),
        },
    )
    b = traces.best_so_far(t, [*D1_KEYS, "variant"], "core_loss", shadow="validation_mae")
    s = traces.run_summary(b, [*D1_KEYS, "variant"], "core_loss", "validation_mae", PATIENCE)
    return full(spark, sf).withColumnRenamed("model", "variant"), s


def d1_table(spark, sf):
    rows, s = d1_parts(spark, sf)
    return decisions.paired_table(rows, s, D1_KEYS, control="control_a", candidate="candidate")


_D1_NUM = ["control_mae", "candidate_mae", "control_latent_aligned_r2", "candidate_latent_aligned_r2", "delta_mae", "delta_r2"]


@query(
    "d1_table",
    f"WITH {_D1}, es AS (SELECT world, {_B}, n_train, "
    + ", ".join(
        f"max({c}) FILTER (WHERE variant = '{v}') AS {s}_{n}"
        for s, v in (("control", "control_a"), ("candidate", "candidate"))
        for n, c in (("selected_epoch", "selected_checkpoint_epoch"), ("shadow_epoch", "shadow_mae_checkpoint_epoch"), ("stop_epoch", "stop_epoch"))
    )
    + f" FROM sm GROUP BY world, {_B}, n_train) SELECT d1.* REPLACE (" + ", ".join(f"{R(c)} AS {c}" for c in _D1_NUM)
    + f"), es.* EXCLUDE (world, {_B}, n_train) FROM d1 JOIN es USING (world, {_B}, n_train)",
)
def _(spark, sf):
    return rounded(d1_table(spark, sf), *_D1_NUM)


_D1C = (
    f"{_D1}, dc AS (SELECT world, " + ", ".join(f"avg(delta_mae) FILTER (WHERE n_train = {n}) AS mean_delta_n{n}" for n in (5, 10, 20, 40))
    + ", count(*) FILTER (WHERE n_train = 40 AND delta_mae > 0) AS final_wins, count(*) FILTER (WHERE n_train = 40) AS final_bundles FROM d1 GROUP BY 1),"
    " dd AS (SELECT *, CASE WHEN mean_delta_n5 <= 0 AND mean_delta_n10 <= 0 AND mean_delta_n20 <= 0 AND mean_delta_n40 > 0 AND final_wins >= 4 THEN 'reproduced'"
    " WHEN mean_delta_n40 <= 0 OR final_wins <= 2 THEN 'not_reproduced' ELSE 'ambiguous' END AS classification FROM dc)"
)


@query(
    "d1_class",
    f"WITH {_D1C} SELECT * REPLACE (" + ", ".join(f"{R(f'mean_delta_n{n}')} AS mean_delta_n{n}" for n in (5, 10, 20, 40)) + ") FROM dd",
)
def _(spark, sf):
    out = decisions.reproduction_class(d1_table(spark, sf), ["world"])
    return rounded(out, *[f"mean_delta_n{n}" for n in (5, 10, 20, 40)])


@query("d2_analysis")
def _(spark, sf):
    rows = arrays(spark, sf).withColumn("unit", F.col("cohort") * 5 + F.col("subset"))
    return reports.array_analysis(rows, ["design"], LEVELS, "unit", resamples=REPS)


_OVER = f"{AR}, ov AS (SELECT a.n_train, a.delta_mae AS x, b.delta_mae AS y FROM ar a JOIN ar b USING (n_train, cohort, subset, model) WHERE a.design = 'a' AND b.design = 'b')"


@query(
    "array_overlap",
    f"WITH {_OVER} SELECT n_train, count(*) AS overlap_pair_count, {R('avg(abs(x - y))')} AS mean_absolute_difference,"
    f" {R('max(abs(x - y))')} AS maximum_absolute_difference, {R('corr(x, y)')} AS pearson_correlation FROM ov GROUP BY 1",
)
def _(spark, sf):
    rows = arrays(spark, sf)
    out = decisions.array_overlap(
        rows.where("design = 'a'").drop("design"), rows.where("design = 'b'").drop("design"), ["n_train"], FACTORS
    )
    return rounded(out, "mean_absolute_difference", "maximum_absolute_difference", "pearson_correlation")


@query(
    "array_agreement",
    f"WITH {CLASSES}, df AS (SELECT design, n_train, coalesce(max(component) FILTER (WHERE factor_classification = 'dominant'), 'none') AS d FROM fc GROUP BY 1, 2),"
    " w AS (SELECT " + ", ".join(
        f"max(d) FILTER (WHERE design = '{g}' AND n_train = {n}) AS dominant_{g}_n{n}" for g in ("a", "b") for n in (5, 40)
    )
    + " FROM df) SELECT *, CASE WHEN dominant_a_n40 <> 'none' AND dominant_a_n40 = dominant_b_n40 AND dominant_a_n5 = dominant_b_n5"
    " THEN 'sufficient' ELSE 'insufficient' END AS evidence FROM w",
)
def _(spark, sf):
    return decisions.array_agreement(classes(spark, sf), [])


_STATES = (
    f"{_D1C}, dj AS (SELECT world, avg(delta_mae) FILTER (WHERE n_train = 40) AS m, avg(delta_r2) FILTER (WHERE n_train = 40) AS r,"
    " count(*) FILTER (WHERE n_train = 40 AND delta_mae > 0) AS mw, count(*) FILTER (WHERE n_train = 40 AND delta_r2 > 0) AS rw FROM d1 GROUP BY 1),"
    " hs AS (SELECT world, CASE WHEN m > 0 AND mw >= 4 AND r <= 0 AND rw <= 2 THEN 'strengthened' WHEN m > 0 AND mw >= 4 AND r > 0 AND rw >= 4 THEN 'weakened'"
    " ELSE 'unresolved' END AS disconnect_state, m, r, mw, rw FROM dj)"
)


@query(
    "disconnect_state",
    f"WITH {_STATES} SELECT world, disconnect_state, {R('m')} AS mean_delta_mae, {R('r')} AS mean_delta_r2, mw AS mae_wins, rw AS r2_wins FROM hs",
)
def _(spark, sf):
    out = decisions.disconnect_state(d1_table(spark, sf), ["world"])
    return rounded(out, "mean_delta_mae", "mean_delta_r2")


def _fs(f: str) -> str:
    strong = f"bool_or(component = '{f}' AND factor_classification = 'dominant')"
    weak = f"bool_or(component = '{f}' AND factor_classification = 'weak')"
    return f"CASE WHEN {strong} AND NOT {weak} THEN 'strengthened' WHEN {weak} AND NOT {strong} THEN 'weakened' ELSE 'unresolved' END AS state_{f}"


_HYP = (
    f"{CLASSES}, fs AS (SELECT design, {', '.join(_fs(f) for f in FACTORS)} FROM fc GROUP BY 1),"
    " ia AS (SELECT design, bool_or(res > nam) AS interaction_ambiguity FROM (SELECT design, n_train, max(variance_share) FILTER (WHERE component = 'residual') AS res,"
    " max(variance_share) FILTER (WHERE component <> 'residual') AS nam FROM cp GROUP BY 1, 2) GROUP BY 1),"
    f" {_SHIFT.removeprefix(AR + ', ')}, {_boot('ts', 'design', 'unit', 't', 20260827)},"
    " sx AS (SELECT design, avg(t) AS mean_t, count(*) FILTER (WHERE t > 0) AS ptc, count(*) AS pc, avg(delta_low) AS ml, avg(delta_high) AS mh FROM ts GROUP BY 1),"
    " sy AS (SELECT fs.*, interaction_ambiguity, CASE WHEN interaction_ambiguity THEN 'unresolved' WHEN mean_t <= 0 THEN 'absent' WHEN pc <> 25 THEN 'unresolved'"
    " WHEN ml <= 0 AND mh > 0 AND ptc >= 20 AND lo > 0 THEN 'strong' WHEN ptc < 20 OR lo <= 0 THEN 'partial' ELSE 'unresolved' END AS sample_complexity_state"
    " FROM fs JOIN ia USING (design) JOIN sx USING (design) JOIN ci USING (design))"
)


def states(spark, sf):
    """Factor and size states of each design, with the largest share standing for the frequency."""
    cls = classes(spark, sf)
    freq = cls.select("design", "n_train", F.col("component").alias("factor"), "largest_frequency")
    shift_rows = shifts(spark, sf).withColumn("unit", F.col("cohort") * 5 + F.col("subset"))
    interval = resample.bootstrap_mean_ci(shift_rows, ["design"], "unit", "t", resamples=REPS, seed=20260827)
    out = (
        decisions.factor_states(cls, ["design"], FACTORS)
        .join(decisions.interaction_ambiguity(components(spark, sf), freq, ["design"]), "design")
        .join(variance.n_shift_summary(shift_rows, ["design"]), "design")
        .join(interval.select("design", "ci_lower"), "design")
        .withColumn("classification", F.lit("reproduced"))
    )
    return decisions.sample_complexity_state(out, classification="classification", ambiguous="interaction_ambiguity")


_STATE_COLS = ["design", *[f"state_{f}" for f in FACTORS], "interaction_ambiguity", "sample_complexity_state"]


@query("hypothesis_states", f"WITH {_HYP} SELECT * FROM sy")
def _(spark, sf):
    return states(spark, sf).select(*_STATE_COLS)


_CKPT = (
    "ck AS (SELECT avg(b - a) AS md, count(*) FILTER (WHERE b - a > 0) AS pd, count(*) FILTER (WHERE b > 0) AS pb FROM"
    " (SELECT context, model_seed, max(gap) FILTER (WHERE variant = 'control') AS a, max(gap) FILTER (WHERE variant = 'candidate') AS b FROM"
    " (SELECT context, model_seed, variant, max(validation_mae) FILTER (WHERE epoch = selected_checkpoint_epoch)"
    " - max(validation_mae) FILTER (WHERE epoch = shadow_mae_checkpoint_epoch) AS gap FROM tr JOIN sm USING (context, model_seed, variant) GROUP BY 1, 2, 3) GROUP BY 1, 2)),"
    " cs AS (SELECT CASE WHEN md > 0 AND pd >= 4 AND pb >= 4 THEN 'strengthened' WHEN md <= 0 AND pd <= 2 THEN 'weakened' ELSE 'unresolved' END AS checkpoint_state FROM ck)"
)


@query(
    "checkpoint_state",
    f"WITH {TRACE}, {_CKPT} SELECT checkpoint_state, {R('md')} AS mean_d, pd AS positive_d, pb AS positive_candidate_gap FROM ck, cs",
)
def _(spark, sf):
    out = decisions.checkpoint_state(_gaps(spark, sf), []).drop("bundles")
    return rounded(out, "mean_d")


@query(
    "route",
    f"WITH {_HYP}, {TRACE}, {_CKPT}, rt AS (SELECT sy.*, checkpoint_state, list_filter(["
    "CASE WHEN interaction_ambiguity THEN 'D2B' END, CASE WHEN checkpoint_state = 'strengthened' THEN 'D4_CHECKPOINT' END,"
    " CASE WHEN state_model = 'strengthened' THEN 'D4_OPTIMIZATION' END, CASE WHEN state_subset = 'strengthened' OR state_cohort = 'strengthened' THEN 'D4_DATA_REGIME' END,"
    " CASE WHEN sample_complexity_state IN ('strong', 'partial') THEN 'D4_CAPACITY_TIME' END], lambda x: x IS NOT NULL) AS tr FROM sy, cs)"
    " SELECT design, array_to_string(tr, ',') AS triggered, coalesce(tr[1], 'STOP') AS next_stage FROM rt",
)
def _(spark, sf):
    one = F.lit(1)
    checkpoint = decisions.checkpoint_state(_gaps(spark, sf), []).select("checkpoint_state", one.alias("_one"))
    # a single decision row for the whole table
    joined = states(spark, sf).withColumn("_one", one).join(F.broadcast(checkpoint), "_one")
    out = decisions.route(joined.withColumn("disconnect_state", F.lit("unresolved")))
    return out.select("design", F.array_join("triggered", ",").alias("triggered"), "next_stage")


_IP_NUM = ["delta_standard", "delta_forced", "g", "h_candidate", "h_control"]


@query("interaction_pairs", f"WITH {CX} SELECT context, model_seed, " + ", ".join(f"{R(c)} AS {c}" for c in _IP_NUM) + " FROM ip")
def _(spark, sf):
    return rounded(interaction(spark, sf).select("context", "model_seed", *_IP_NUM), *_IP_NUM)


_STATS = (
    f"{_CROSSED}, rr AS (SELECT {_resid('delta_standard')} AS s, {_resid('delta_forced')} AS f FROM ip),"
    " st AS (SELECT (SELECT avg(g) FROM ip) AS mean_g, (SELECT count(*) FILTER (WHERE g > 0) FROM ip) AS positive_pairs,"
    " (SELECT count(*) FILTER (WHERE m > 0) FROM (SELECT avg(g) AS m FROM ip GROUP BY context)) AS positive_contexts,"
    " (SELECT count(*) FILTER (WHERE m > 0) FROM (SELECT avg(g) AS m FROM ip GROUP BY model_seed)) AS positive_models,"
    " (SELECT stddev_samp(f) / nullif(stddev_samp(s), 0) FROM rr) AS ratio, cb.* FROM cb)"
)
_STAT_NUM = ["mean_g", "ratio", "mean_ci_lower", "mean_ci_upper", "ratio_ci_lower", "ratio_ci_upper"]


def _stats(spark, sf):
    return decisions.interaction_stats(interaction(spark, sf), [], "context", "model_seed", resamples=REPS)


@query("interaction_stats", f"WITH {_STATS} SELECT * REPLACE (" + ", ".join(f"{R(c)} AS {c}" for c in _STAT_NUM) + ") FROM st")
def _(spark, sf):
    return rounded(_stats(spark, sf), *_STAT_NUM)


@query(
    "interaction_class",
    f"WITH {_STATS} SELECT CASE WHEN NOT (mean_g > 0 AND mean_ci_lower > 0 AND positive_contexts >= 4 AND positive_models >= 8) THEN 'not_established'"
    " WHEN valid_replicates = resamples AND ratio < 1 AND ratio_ci_upper < 1 THEN 'effect_and_heterogeneity' ELSE 'effect_only' END AS classification FROM st",
)
def _(spark, sf):
    return decisions.interaction_class(_stats(spark, sf)).select("classification")


@query(
    "confirm_report",
    f"WITH {_SIGN}, {_boot('pr', 'world, comparator', 'cohort_seed', 'effect', 20260824)},"
    " hm AS (SELECT *, row_number() OVER (ORDER BY round(p, 12), world || '|' || comparator) AS r, count(*) OVER () AS mm FROM sp)"
    f" SELECT world, comparator, {R('m')} AS mean_effect, units, {R('lo')} AS ci_lower, {R('hi')} AS ci_upper, resamples, wins, losses, ties, hm.n,"
    f" {R('p')} AS p_value, {R('least(1.0::DOUBLE, (SELECT max((mm - r + 1) * p) FROM hm x WHERE x.r <= hm.r))')} AS holm_p_value"
    " FROM ob JOIN ci USING (world, comparator) JOIN hm USING (world, comparator)",
)
def _(spark, sf):
    from longspark.catalog.studies import mae

    out = reports.confirm_report(mae(spark, sf), "candidate", ["control_a", "control_b"], resamples=REPS)
    return rounded(out, "mean_effect", "ci_lower", "ci_upper", "p_value", "holm_p_value")
