"""History summaries, running features and the whole-cohort sequence table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longspark.functions.draws import driver_normal
from longspark.functions.numeric import dot
from longspark.operators import timeline as tl
from longspark.operators.scan import MAX_ROWS, Run, running
from longspark.schema import EVENT_TYPES, Task

ID = tl.ID


def _history_runs(task: Task, inclusive: bool) -> dict[str, Run]:
    runs = {"_h_n_intervention": Run("sum", F.col("n_intervention"), inclusive=inclusive)}
    for code in task.value_codes:
        seen = F.col(f"mask_{code}") == 1
        pair = F.when(seen, F.struct(F.col("us"), F.col(f"value_{code}").alias("value")))
        runs[f"_h_last_{code}"] = Run("last", pair, inclusive=inclusive)
        runs[f"_h_n_{code}"] = Run("sum", F.col(f"n_{code}"), inclusive=inclusive)
    return runs


def _with_history(df: DataFrame, task: Task) -> DataFrame:
    out: list[Column] = []
    zero = F.lit(0).cast("bigint")
    for code in task.value_codes:
        last = F.col(f"_h_last_{code}")
        since = tl.days(F.col("us") - last["us"])
        out += [
            F.coalesce(last["value"], F.lit(0.0)).alias(f"last_{code}"),
            F.coalesce(since, F.col("elapsed_days")).alias(f"since_{code}"),
            F.coalesce(F.col(f"_h_n_{code}"), zero).alias(f"count_{code}"),
        ]
    out.append(F.coalesce(F.col("_h_n_intervention"), zero).alias("count_intervention"))
    drop = [c for c in df.columns if c.startswith("_h_")]
    return df.select("*", *out).drop(*drop)


def history_features(
    steps: DataFrame, task: Task, *, strict: bool = False, max_rows: int = MAX_ROWS
) -> DataFrame:
    """Per code: last value, days since it, count; plus intervention count and elapsed days.

    ``strict`` uses events before the instant only; otherwise the instant itself counts too.
    """
    cut, chunk = tl._chunks(steps, max_rows)
    runs = {**tl.origin_runs(), **_history_runs(task, inclusive=not strict)}
    out = tl._plain(running(cut, [ID], ["us"], runs, chunk=chunk), chunk)
    return _with_history(tl.with_elapsed(out), task)


def feature_names(task: Task) -> list[str]:
    per_code = [f"{k}_{c}" for c in task.value_codes for k in ("last", "since", "count")]
    return [*per_code, "count_intervention", "elapsed_days"]


def projection_matrix(inputs: int, dims: int, seed: int) -> tuple[list[list[float]], list[float]]:
    """Weights of standard deviation 0.25 and biases of 0.05, fixed by the seed."""
    weights = [
        [0.25 * driver_normal(seed, "projection", i, j) for j in range(dims)]
        for i in range(inputs)
    ]
    return weights, [0.05 * driver_normal(seed, "bias", j) for j in range(dims)]


def random_projection(
    df: DataFrame, features: list[str], *, dims: int = 16, seed: int = 0, name: str = "rep"
) -> DataFrame:
    """``tanh(x P + b)`` as one double column per output dimension."""
    weights, bias = projection_matrix(len(features), dims, seed)
    columns = [F.col(f).cast("double") for f in features]
    out = [
        F.tanh(dot(columns, [row[j] for row in weights]) + F.lit(bias[j])).alias(f"{name}_{j}")
        for j in range(dims)
    ]
    return df.select("*", *out)


def _running_runs(task: Task) -> dict[str, Run]:
    runs: dict[str, Run] = {}
    for code in task.value_codes:
        seen = F.col(f"mask_{code}") == 1
        value = F.col(f"value_{code}")
        runs[f"run_last_{code}"] = Run("last", F.when(seen, value))
        runs[f"run_count_{code}"] = Run("sum", F.col(f"mask_{code}"))
        runs[f"run_sum_{code}"] = Run("sum", F.when(seen, value).otherwise(F.lit(0.0)))
    return runs


def _with_running(df: DataFrame, task: Task) -> DataFrame:
    for code in task.value_codes:
        df = df.withColumn(f"run_last_{code}", F.coalesce(f"run_last_{code}", F.lit(0.0)))
    return df.withColumn("log_elapsed", F.log1p("elapsed_days"))


def running_features(steps: DataFrame, task: Task, *, max_rows: int = MAX_ROWS) -> DataFrame:
    """Last observed value and number of observed steps per code, up to and with this step."""
    cut, chunk = tl._chunks(steps, max_rows)
    runs = {**tl.origin_runs(), **_running_runs(task)}
    out = tl._plain(running(cut, [ID], ["us"], runs, chunk=chunk), chunk)
    return _with_running(tl.with_elapsed(out), task)


def engineered_names(task: Task) -> list[str]:
    codes = task.value_codes
    return [
        *[f"run_last_{c}" for c in codes],
        *[f"run_count_{c}" for c in codes],
        *[f"mask_{c}" for c in codes],
        *[f"is_{t}" for t in EVENT_TYPES],
        "log_elapsed",
    ]


def cohort_sequences(
    events: DataFrame,
    task: Task,
    *,
    strict: bool = True,
    tau_days: float = 30.0,
    representation_dims: int = 0,
    seed: int = 0,
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """Every step column of a cohort: one exchange to build steps, one to order them."""
    steps = tl.group_instants(events, task)
    cut, chunk = tl._chunks(steps, max_rows, events)
    runs = {
        "_position": Run("count"),
        **tl.origin_runs(),
        **tl.previous_runs(),
        **_history_runs(task, inclusive=not strict),
        **_running_runs(task),
        **tl.next_runs(task),
        **tl.horizon_runs(),
    }
    out = tl._plain(running(cut, [ID], ["us"], runs, chunk=chunk), chunk)
    out = out.withColumn("step", F.col("_position") - 1).drop("_position")
    out = tl.with_gap(tl.with_elapsed(out), tau_days)
    out = _with_running(_with_history(out, task), task)
    out = tl.with_horizon(tl.with_next(out, task), task)
    if representation_dims:
        out = random_projection(out, feature_names(task), dims=representation_dims, seed=seed)
    return out


def forecast_examples(sequences: DataFrame, task: Task, features: list[str]) -> DataFrame:
    """One row per (step, code) whose next value is observed, with the code one-hot."""
    entries = F.array(
        *[
            F.struct(
                F.lit(code).alias("code"),
                F.col(f"next_value_{code}").alias("target"),
                F.col(f"next_mask_{code}").alias("seen"),
                F.col(f"run_last_{code}").alias("last_value"),
                F.when(
                    F.col(f"run_count_{code}") > 0,
                    F.col(f"run_sum_{code}") / F.col(f"run_count_{code}"),
                )
                .otherwise(F.lit(0.0))
                .alias("running_mean"),
            )
            for code in task.value_codes
        ]
    )
    passed = [c for c in ("site",) if c in sequences.columns]
    rows = sequences.select(
        ID, "us", "step", *passed, *features, F.explode(F.filter(entries, lambda e: e["seen"] == 1)).alias("e")
    )
    hot = [
        F.when(F.col("e.code") == c, 1.0).otherwise(0.0).alias(f"hot_{c}") for c in task.value_codes
    ]
    return rows.select(
        ID,
        "us",
        "step",
        *passed,
        F.col("e.code").alias("code"),
        *features,
        *hot,
        F.col("e.last_value").alias("last_value"),
        F.col("e.running_mean").alias("running_mean"),
        F.col("e.target").alias("target"),
    )
