"""Queries over event timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from longspark.catalog.fixtures import (
    EV,
    EV1,
    H_US,
    STEPS,
    TASK,
    R,
    events,
    r6,
    rounded,
    table,
)
from longspark.catalog.registry import query
from longspark.functions.text import metadata_field
from longspark.operators import asof, history, timeline
from longspark.schema import MICROS_PER_DAY

CODES = TASK.value_codes
DAY = f"{MICROS_PER_DAY}::DOUBLE"
KEY = ["patient_id", "us"]


def _steps(spark, sf):
    return timeline.group_instants(events(spark, sf, hourly=True), TASK)


@query(
    "metadata_field",
    f"WITH {EV1} SELECT seq, CAST(json_extract_string(metadata, '$.k') AS BIGINT) AS k FROM ev1",
)
def _(spark, sf):
    e = events(spark, sf)
    return e.select("seq", metadata_field(F.col("metadata"), "k").cast("bigint").alias("k"))


def _parts_sql(length: int) -> str:
    return (
        f"WITH {EV}, placed AS (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY us, seq) - 1 AS spot FROM ev)"
        f" SELECT patient_id, spot // {length} AS part, count(*) AS n_events,"
        " string_agg(CAST(seq AS VARCHAR) || ':' || code, ',' ORDER BY us, seq) AS ordered"
        " FROM placed GROUP BY 1, 2"
    )


def _parts(spark, sf, length):
    out = timeline.timeline_array(events(spark, sf, hourly=True), max_rows=length)
    text = F.transform("events", lambda e: F.concat_ws(":", e["seq"].cast("string"), e["code"]))
    return out.select(
        "patient_id",
        "part",
        F.size("events").cast("bigint").alias("n_events"),
        F.array_join(text, ",").alias("ordered"),
    )


@query("timeline_array", _parts_sql(timeline.MAX_ARRAY))
def _(spark, sf):
    return _parts(spark, sf, timeline.MAX_ARRAY)


@query("timeline_parts", _parts_sql(7))
def _(spark, sf):
    return _parts(spark, sf, 7)


@query(
    "group_instants",
    f"WITH {STEPS} SELECT patient_id, us, step, n_events FROM steps",
)
def _(spark, sf):
    return timeline.number_steps(_steps(spark, sf)).select(*KEY, "step", "n_events")


@query(
    "pivot_values",
    f"WITH {STEPS} SELECT patient_id, us, "
    + ", ".join(f"value_{c}, mask_{c}" for c in CODES)
    + " FROM steps",
)
def _(spark, sf):
    return _steps(spark, sf).select(
        *KEY, *[f"{k}_{c}" for c in CODES for k in ("value", "mask")]
    )


@query(
    "type_indicators",
    f"WITH {STEPS} SELECT patient_id, us, is_observation, is_intervention, is_encounter FROM steps",
)
def _(spark, sf):
    return _steps(spark, sf).select(*KEY, "is_observation", "is_intervention", "is_encounter")


@query("update_mask", f"WITH {STEPS} SELECT patient_id, us, update_mask FROM steps")
def _(spark, sf):
    return _steps(spark, sf).select(*KEY, "update_mask")


@query(
    "elapsed_days",
    f"WITH {STEPS} SELECT patient_id, us,"
    f" {R(f'(us - min(us) OVER (PARTITION BY patient_id)) / {DAY}')} AS elapsed_days FROM steps",
)
def _(spark, sf):
    return rounded(timeline.elapsed_days(_steps(spark, sf)).select(*KEY, "elapsed_days"), "elapsed_days")


_GAP = (
    f"coalesce((us - lag(us) OVER (PARTITION BY patient_id ORDER BY us)) / {DAY}, 0.0::DOUBLE)"
)


@query(
    "gap_features",
    f"WITH {STEPS}, g AS (SELECT patient_id, us, {_GAP} AS d FROM steps)"
    f" SELECT patient_id, us, {R('d')} AS gap_days, {R('ln(1 + d)')} AS log_gap FROM g",
)
def _(spark, sf):
    out = timeline.gap_features(_steps(spark, sf)).select(*KEY, "gap_days", "log_gap")
    return rounded(out, "gap_days", "log_gap")


@query(
    "gap_saturation",
    f"WITH {STEPS}, g AS (SELECT patient_id, us, {_GAP} AS d FROM steps)"
    f" SELECT patient_id, us, {R('d / (30.0::DOUBLE + d)')} AS gap_saturation FROM g",
)
def _(spark, sf):
    out = timeline.gap_features(_steps(spark, sf), tau_days=30.0)
    return rounded(out.select(*KEY, "gap_saturation"), "gap_saturation")


def _lead(c):
    w = "OVER (PARTITION BY patient_id ORDER BY us)"
    return (
        f"coalesce(lead(value_{c}) {w}, 0.0::DOUBLE) AS next_value_{c},"
        f" coalesce(lead(mask_{c}) {w}, 0) AS next_mask_{c}"
    )


@query(
    "next_targets",
    f"WITH {STEPS} SELECT patient_id, us, {', '.join(_lead(c) for c in CODES)} FROM steps",
)
def _(spark, sf):
    return timeline.next_targets(_steps(spark, sf), TASK).select(
        *KEY, *[f"next_{k}_{c}" for c in CODES for k in ("value", "mask")]
    )


_HORIZON = (
    "h AS (SELECT s.patient_id, s.us,"
    f" s.us + {H_US} <= max(s.us) OVER (PARTITION BY s.patient_id) AS ok,"
    " EXISTS (SELECT 1 FROM ev e WHERE e.patient_id = s.patient_id AND e.event_type = 'intervention'"
    f" AND e.us > s.us AND e.us <= s.us + {H_US}) AS hit FROM steps s)"
)


@query(
    "horizon_label",
    f"WITH {STEPS}, {_HORIZON} SELECT patient_id, us, CAST(ok AND hit AS BIGINT) AS horizon_label FROM h",
)
def _(spark, sf):
    return timeline.horizon_label(_steps(spark, sf), TASK).select(*KEY, "horizon_label")


@query(
    "horizon_valid",
    f"WITH {STEPS}, {_HORIZON} SELECT patient_id, us, CAST(ok AS BIGINT) AS horizon_valid FROM h",
)
def _(spark, sf):
    return timeline.horizon_label(_steps(spark, sf), TASK).select(*KEY, "horizon_valid")


def _history_sql(op: str) -> str:
    # brute force: every event of the entity up to (or before) the step
    aggs = []
    outs = []
    for c in CODES:
        seen = f"e.event_type = 'observation' AND e.code = '{c}'"
        aggs.append(
            f"arg_max(e.value, [e.us, e.seq]) FILTER (WHERE {seen}) AS v_{c},"
            f" max(e.us) FILTER (WHERE {seen}) AS t_{c},"
            f" count(*) FILTER (WHERE {seen}) AS c_{c}"
        )
        outs.append(
            f"{R(f'coalesce(v_{c}, 0.0::DOUBLE)')} AS last_{c},"
            f" {R(f'coalesce((us - t_{c}) / {DAY}, (us - coalesce(t0, us)) / {DAY})')} AS since_{c},"
            f" c_{c} AS count_{c}"
        )
    return (
        f"WITH {STEPS}, h AS (SELECT s.patient_id, s.us, min(e.us) AS t0, {', '.join(aggs)},"
        " count(*) FILTER (WHERE e.event_type = 'intervention') AS n_i"
        f" FROM steps s LEFT JOIN ev e ON e.patient_id = s.patient_id AND e.us {op} s.us GROUP BY s.patient_id, s.us)"
        f" SELECT patient_id, us, {', '.join(outs)}, n_i AS count_intervention,"
        f" {R(f'(us - coalesce(t0, us)) / {DAY}')} AS elapsed_days FROM h"
    )


def _history(spark, sf, strict):
    out = history.history_features(_steps(spark, sf), TASK, strict=strict)
    names = history.feature_names(TASK)
    doubles = [n for n in names if not n.startswith("count_")]
    return rounded(out.select(*KEY, *names), *doubles)


@query("history_inclusive", _history_sql("<="))
def _(spark, sf):
    return _history(spark, sf, strict=False)


@query("history_strict", _history_sql("<"))
def _(spark, sf):
    return _history(spark, sf, strict=True)


def _projection_sql(dims: int, seed: int) -> str:
    names = history.feature_names(TASK)
    weights, bias = history.projection_matrix(len(names), dims, seed)
    outs = []
    for j in range(dims):
        terms = " + ".join(f"{n} * ({weights[i][j]!r}::DOUBLE)" for i, n in enumerate(names))
        outs.append(f"{R(f'tanh({terms} + ({bias[j]!r}::DOUBLE))')} AS rep_{j}")
    inner = _history_sql("<")
    return f"SELECT patient_id, us, {', '.join(outs)} FROM ({inner})"


@query("random_projection", _projection_sql(4, 0))
def _(spark, sf):
    out = history.history_features(_steps(spark, sf), TASK, strict=True)
    names = history.feature_names(TASK)
    # the inputs are rounded so that both engines project the same numbers
    out = rounded(out, *[n for n in names if not n.startswith("count_")])
    out = history.random_projection(out, names, dims=4, seed=0)
    reps = [f"rep_{j}" for j in range(4)]
    return rounded(out.select(*KEY, *reps), *reps)


def _running_sql_columns() -> str:
    w = "OVER (PARTITION BY patient_id ORDER BY us ROWS UNBOUNDED PRECEDING)"
    out = []
    for c in CODES:
        v = f"CASE WHEN mask_{c} = 1 THEN value_{c} END"
        out.append(
            f"coalesce(last_value({v} IGNORE NULLS) {w}, 0.0::DOUBLE) AS run_last_{c},"
            f" CAST(sum(mask_{c}) {w} AS BIGINT) AS run_count_{c},"
            f" CASE WHEN sum(mask_{c}) {w} > 0 THEN sum(coalesce({v}, 0.0::DOUBLE)) {w} / sum(mask_{c}) {w} ELSE 0.0::DOUBLE END AS run_mean_{c}"
        )
    return ", ".join(out)


RUNNING = (
    f"{STEPS}, run AS (SELECT *, {_running_sql_columns()},"
    f" (us - min(us) OVER (PARTITION BY patient_id)) / {DAY} AS elapsed, {', '.join(_lead(c) for c in CODES)} FROM steps)"
)
EXAMPLES = f"{RUNNING}, ex AS (" + " UNION ALL ".join(
    f"SELECT patient_id, us, step, '{c}' AS code, run_last_{c} AS last_value, run_mean_{c} AS running_mean,"
    f" elapsed, next_value_{c} AS target FROM run WHERE next_mask_{c} = 1"
    for c in CODES
) + ")"


@query(
    "running_features",
    f"WITH {RUNNING} SELECT patient_id, us, "
    + ", ".join(f"run_last_{c}, run_count_{c}, mask_{c}" for c in CODES)
    + f", {R('ln(1 + elapsed)')} AS log_elapsed FROM run",
)
def _(spark, sf):
    out = history.running_features(_steps(spark, sf), TASK)
    return rounded(
        out.select(
            *KEY,
            *[f"{k}_{c}" for c in CODES for k in ("run_last", "run_count", "mask")],
            "log_elapsed",
        ),
        "log_elapsed",
    )


def examples(spark, sf, features=("elapsed_days",), hourly=True):
    seq = history.cohort_sequences(events(spark, sf, hourly=hourly), TASK)
    return history.forecast_examples(seq, TASK, list(features))


@query(
    "forecast_examples",
    f"WITH {EXAMPLES} SELECT patient_id, us, step, code, {R('elapsed')} AS elapsed_days, last_value,"
    f" {R('running_mean')} AS running_mean, target, "
    + ", ".join(f"CAST(code = '{c}' AS INTEGER)::DOUBLE AS hot_{c}" for c in CODES)
    + " FROM ex",
)
def _(spark, sf):
    return rounded(examples(spark, sf), "elapsed_days", "running_mean")


@query("jump_eligible", f"WITH {STEPS} SELECT patient_id, us, jump_eligible FROM steps")
def _(spark, sf):
    return _steps(spark, sf).select(*KEY, "jump_eligible")


_TRUTH_JOIN = (
    f"{EV1}, {STEPS}, tr AS (SELECT patient_id, us, code, arg_max(value, seq) AS value FROM ev1"
    " WHERE event_type = 'observation' GROUP BY patient_id, us, code)"
)


def _asof_query(order: str, where: str) -> str:
    # brute force: rank every truth row of the entity for each step and code
    pick = (
        f"m AS (SELECT s.patient_id, s.us, t.code, t.us AS tus, t.value,"
        f" row_number() OVER (PARTITION BY s.patient_id, s.us, t.code ORDER BY {order}) AS rn"
        f" FROM steps s JOIN tr t ON t.patient_id = s.patient_id AND {where})"
    )
    outs = ", ".join(
        f"max(tus) FILTER (WHERE code = '{c}') AS truth_us_{c},"
        f" max(value) FILTER (WHERE code = '{c}') AS truth_value_{c}"
        for c in CODES
    )
    return (
        f"WITH {_TRUTH_JOIN}, {pick}, p AS (SELECT patient_id, us, {outs} FROM m WHERE rn = 1 GROUP BY 1, 2)"
        f" SELECT s.patient_id, s.us, {', '.join(f'truth_us_{c}, truth_value_{c}' for c in CODES)}"
        " FROM steps s LEFT JOIN p ON p.patient_id = s.patient_id AND p.us = s.us"
    )


@query("next_truth_asof", _asof_query("t.us", "t.us > s.us"))
def _(spark, sf):
    return asof.next_truth_asof(_steps(spark, sf), truth(spark, sf), TASK)


@query("nearest_asof", _asof_query("abs(t.us - s.us), t.us", "true"))
def _(spark, sf):
    return asof.nearest_asof(_steps(spark, sf), truth(spark, sf), TASK)


def truth(spark, sf):
    e = events(spark, sf)
    return e.where(F.col("event_type") == "observation").select(
        "patient_id", "us", "seq", "code", "value"
    )


@query(
    "truth_examples",
    f"WITH {_TRUTH_JOIN}, m AS (SELECT s.patient_id, s.us, s.step, t.code, arg_min(t.value, t.us) AS target"
    " FROM steps s JOIN tr t ON t.patient_id = s.patient_id AND t.us > s.us GROUP BY 1, 2, 3, 4)"
    f" SELECT m.patient_id, m.us, m.step, code, target, {R(f'(m.us - o.t0) / {DAY}')} AS elapsed_days"
    " FROM m JOIN (SELECT patient_id, min(us) AS t0 FROM steps GROUP BY 1) o ON o.patient_id = m.patient_id",
)
def _(spark, sf):
    seq = history.cohort_sequences(events(spark, sf, hourly=True), TASK)
    return rounded(
        asof.truth_examples(seq, truth(spark, sf), TASK, ["elapsed_days"]), "elapsed_days"
    )


_PAD = 64


@query(
    "pad_sequences",
    f"WITH {STEPS}, slots AS (SELECT p.patient_id, w.window_no, k.k FROM"
    " (SELECT patient_id, max(step) AS last FROM steps GROUP BY 1) p,"
    f" LATERAL (SELECT unnest(range(0, CAST(floor(p.last / {_PAD}) AS BIGINT) + 1)) AS window_no) w,"
    f" (SELECT unnest(range(0, {_PAD})) AS k) k)"
    " SELECT t.patient_id, t.window_no,"
    " string_agg(CAST(CAST(coalesce(s.mask_click, 0) AS BIGINT) AS VARCHAR), '' ORDER BY k) AS mask_click,"
    f" {R('sum(coalesce(s.value_click, 0.0::DOUBLE) * (k + 1))')} AS weighted_click,"
    " string_agg(CASE WHEN s.step IS NULL THEN '0' ELSE '1' END, '' ORDER BY k) AS valid"
    f" FROM slots t LEFT JOIN steps s ON s.patient_id = t.patient_id AND s.step = t.window_no * {_PAD} + t.k"
    " GROUP BY 1, 2",
)
def _(spark, sf):
    out = timeline.pad_sequences(_steps(spark, sf), ["value_click", "mask_click"], _PAD)

    def bits(name):
        return F.array_join(F.transform(name, lambda x: x.cast("int").cast("string")), "")

    weighted = F.aggregate(
        F.transform("value_click", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x
    )
    return out.select(
        "patient_id",
        "window_no",
        bits("mask_click").alias("mask_click"),
        r6(weighted).alias("weighted_click"),
        bits("valid").alias("valid"),
    )


@query(
    "step_displacement",
    "WITH d AS (SELECT label, vec_id, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS prev"
    " FROM embeddings), n AS (SELECT label, sqrt(list_sum(list_transform(list_zip(embedding,"
    " coalesce(prev, list_transform(embedding, lambda x: x * 0))),"
    " lambda p: power(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE), 2)))) AS x FROM d)"
    f" SELECT label, count(*) AS n, {R('avg(x)')} AS mean, {R('median(x)')} AS median,"
    f" {R('quantile_cont(x, 0.95)')} AS p95 FROM n GROUP BY label",
)
def _(spark, sf):
    from longspark.operators.quantiles import quantiles
    from longspark.operators.scan import add_chunks

    vectors, chunk = add_chunks(table(spark, sf, "embeddings"), ["label"], "vec_id")
    moved = timeline.step_displacement(vectors, ["label"], ["vec_id"], "embedding", chunk=chunk)
    out = quantiles(
        moved,
        ["label"],
        {"median": ("displacement", 0.5), "p95": ("displacement", 0.95)},
        extra=[F.count(F.lit(1)).alias("n"), F.avg("displacement").alias("mean")],
    )
    return rounded(out.select("label", "n", "mean", "median", "p95"), "mean", "median", "p95")


@query(
    "cohort_sequences",
    f"WITH {RUNNING}, {_HORIZON} SELECT r.patient_id, r.us, r.step, r.update_mask, r.jump_eligible,"
    f" {R('r.elapsed')} AS elapsed_days, r.run_count_click, r.next_value_view, r.next_mask_view,"
    " CAST(h.ok AND h.hit AS BIGINT) AS horizon_label, CAST(h.ok AS BIGINT) AS horizon_valid"
    " FROM run r JOIN h ON h.patient_id = r.patient_id AND h.us = r.us",
)
def _(spark, sf):
    out = history.cohort_sequences(events(spark, sf, hourly=True), TASK)
    return rounded(
        out.select(
            *KEY,
            "step",
            "update_mask",
            "jump_eligible",
            "elapsed_days",
            "run_count_click",
            "next_value_view",
            "next_mask_view",
            "horizon_label",
            "horizon_valid",
        ),
        "elapsed_days",
    )
