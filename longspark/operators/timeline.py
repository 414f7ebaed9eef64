"""From events to one row per entity and instant.

Events of one entity at one instant form a step. Steps come from an aggregation keyed by
(patient_id, us), so a burst of events combines map-side; every later running value works on
steps, which are unique per instant, and shares one partitioning by entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longspark.operators.scan import MAX_ROWS, Run, add_chunks, exact_starts, position, running
from longspark.schema import EVENT_TYPES, MICROS_PER_DAY, Task

ID = "patient_id"
# Events in one array value.
MAX_ARRAY = 50_000


def days(us: Column) -> Column:
    return us.cast("double") / F.lit(MICROS_PER_DAY)


def is_type(name: str) -> Column:
    return F.col("event_type") == name


def observed(code: str) -> Column:
    """A numeric observation of ``code``; text values and NaN do not count."""
    return (
        is_type("observation")
        & (F.col("code") == code)
        & F.col("value").isNotNull()
        & ~F.isnan("value")
    )


def _flag(condition: Column) -> Column:
    return F.max(F.when(condition, 1).otherwise(0)).cast("bigint")


def step_columns(task: Task) -> list[Column]:
    """Aggregates of one step: values, masks, type indicators, update and jump flags."""
    out: list[Column] = []
    for code in task.value_codes:
        seen = observed(code)
        last = F.max_by("value", F.when(seen, F.col("seq")))
        out += [
            F.coalesce(last, F.lit(0.0)).alias(f"value_{code}"),
            _flag(seen).alias(f"mask_{code}"),
            F.count(F.when(seen, 1)).alias(f"n_{code}"),
        ]
    out += [_flag(is_type(t)).alias(f"is_{t}") for t in EVENT_TYPES]
    anchor = is_type("encounter") & F.coalesce(F.col("opportunity"), F.lit(False))
    jump = is_type("intervention") & (
        F.col("code").isin(*task.jump_codes) if task.jump_codes else F.lit(False)
    )
    out += [
        _flag(~anchor).alias("update_mask"),
        _flag(jump).alias("jump_eligible"),
        F.count(F.when(is_type("intervention"), 1)).alias("n_intervention"),
        _flag(is_type(task.event_target_type)).alias("has_target"),
        F.count(F.lit(1)).alias("n_events"),
    ]
    return out


def group_instants(events: DataFrame, task: Task) -> DataFrame:
    """One row per (patient_id, us) with all step columns."""
    return events.groupBy(ID, "us").agg(*step_columns(task))


def _chunks(
    steps: DataFrame, max_rows: int, events: DataFrame | None = None
) -> tuple[DataFrame, str | None]:
    # events per entity bound its steps and are counted without building the steps
    return add_chunks(steps, [ID], "us", max_rows=max_rows, sized_by=events)


def _plain(df: DataFrame, chunk: str | None) -> DataFrame:
    return df.drop(chunk) if chunk else df


def number_steps(steps: DataFrame, *, max_rows: int = MAX_ROWS) -> DataFrame:
    """Add ``step``, counted from 0 inside the entity."""
    cut, chunk = _chunks(steps, max_rows)
    out = position(cut, [ID], ["us"], "_position", chunk=chunk)
    return _plain(out, chunk).withColumn("step", F.col("_position") - 1).drop("_position")


def origin_runs() -> dict[str, Run]:
    return {"origin_us": Run("min", F.col("us"))}


def previous_runs() -> dict[str, Run]:
    return {"previous_us": Run("last", F.col("us"), inclusive=False)}


def next_runs(task: Task) -> dict[str, Run]:
    # the row just after a step is the last one seen in descending order; an
    # unboundedFollowing frame would be re-evaluated for every row
    fields = [f"{kind}_{code}" for code in task.value_codes for kind in ("value", "mask")]
    return {"_next": Run("last", F.struct(*fields), inclusive=False, reverse=True)}


def horizon_runs() -> dict[str, Run]:
    target = F.when(F.col("has_target") == 1, F.col("us"))
    return {
        "next_target_us": Run("last", target, inclusive=False, reverse=True),
        "followup_end_us": Run("max", F.col("us"), reverse=True),
    }


def with_elapsed(df: DataFrame) -> DataFrame:
    return df.withColumn("elapsed_days", days(F.col("us") - F.col("origin_us"))).drop("origin_us")


def with_gap(df: DataFrame, tau_days: float = 30.0) -> DataFrame:
    """Days since the previous step, its log, and its saturation ``d / (tau + d)``."""
    if not tau_days > 0:
        raise ValueError("tau_days must be positive")
    gap = F.greatest(F.coalesce(days(F.col("us") - F.col("previous_us")), F.lit(0.0)), F.lit(0.0))
    return (
        df.withColumn("gap_days", gap)
        .withColumn("log_gap", F.log1p("gap_days"))
        .withColumn("gap_saturation", F.col("gap_days") / (F.lit(tau_days) + F.col("gap_days")))
        .drop("previous_us")
    )


def with_next(df: DataFrame, task: Task) -> DataFrame:
    out = []
    for code in task.value_codes:
        out += [
            F.coalesce(F.col(f"_next.value_{code}"), F.lit(0.0)).alias(f"next_value_{code}"),
            F.coalesce(F.col(f"_next.mask_{code}"), F.lit(0)).alias(f"next_mask_{code}"),
        ]
    return df.select("*", *out).drop("_next")


def with_horizon(df: DataFrame, task: Task) -> DataFrame:
    """Label: a target in (t, t+h]. Valid only where t+h lies inside the follow-up."""
    end = F.col("us") + F.lit(task.horizon_us)
    valid = end <= F.col("followup_end_us")
    hit = F.coalesce(F.col("next_target_us") <= end, F.lit(False))
    return (
        df.withColumn("horizon_valid", valid.cast("bigint"))
        .withColumn("horizon_label", (valid & hit).cast("bigint"))
        .drop("next_target_us", "followup_end_us")
    )


def elapsed_days(steps: DataFrame, *, max_rows: int = MAX_ROWS) -> DataFrame:
    cut, chunk = _chunks(steps, max_rows)
    return with_elapsed(_plain(running(cut, [ID], ["us"], origin_runs(), chunk=chunk), chunk))


def gap_features(
    steps: DataFrame, *, tau_days: float = 30.0, max_rows: int = MAX_ROWS
) -> DataFrame:
    cut, chunk = _chunks(steps, max_rows)
    return with_gap(_plain(running(cut, [ID], ["us"], previous_runs(), chunk=chunk), chunk), tau_days)


def next_targets(steps: DataFrame, task: Task, *, max_rows: int = MAX_ROWS) -> DataFrame:
    """Value and mask of the following step; zeros at the last step."""
    cut, chunk = _chunks(steps, max_rows)
    return with_next(_plain(running(cut, [ID], ["us"], next_runs(task), chunk=chunk), chunk), task)


def horizon_label(steps: DataFrame, task: Task, *, max_rows: int = MAX_ROWS) -> DataFrame:
    cut, chunk = _chunks(steps, max_rows)
    return with_horizon(_plain(running(cut, [ID], ["us"], horizon_runs(), chunk=chunk), chunk), task)


def timeline_array(events: DataFrame, *, max_rows: int = MAX_ARRAY, cell_rows: int = MAX_ROWS) -> DataFrame:
    """Ordered event list per entity, in parts of ``max_rows`` events numbered from 0.

    Part p holds the events at positions ``p * max_rows`` and on, whatever their instants: an entity with up to ``max_rows`` events
    has part 0 alone, one instant may be cut, and events that are equal in all columns take positions side by side.
    ``cell_rows`` bounds the rows that one task orders and changes nothing in the result.
    """
    if max_rows <= 0:
        raise ValueError("max_rows must be positive")
    columns = ["us", "seq", "code", "value", "event_type"]
    row = F.struct(*columns)
    sizes = events.groupBy(ID).agg(F.count(F.lit(1)).alias("_n"))
    largest, total = sizes.agg(F.max("_n"), F.sum("_n")).first()
    if (largest or 0) <= max_rows:
        placed = events.select(ID, F.lit(0).cast("bigint").alias("part"), row.alias("_row"))
    else:
        # equal events become one counted row, so that they can be told apart by position
        counted = events.groupBy(ID, *columns).agg(F.count(F.lit(1)).alias("_copies"))
        starts = exact_starts(counted, [ID], columns, total, weight="_copies", max_rows=cell_rows)
        copies = F.explode(F.sequence(F.col("_start"), F.col("_start") + F.col("_copies") - 1))
        spots = starts.select(ID, row.alias("_row"), copies.alias("_spot"))
        placed = spots.select(ID, F.floor(F.col("_spot") / max_rows).cast("bigint").alias("part"), "_row")
    return placed.groupBy(ID, "part").agg(F.sort_array(F.collect_list("_row")).alias("events"))


def pad_sequences(
    steps: DataFrame, columns: list[str], length: int, *, max_rows: int = MAX_ROWS
) -> DataFrame:
    """Arrays of exactly ``length`` steps, zero-padded, with a ``valid`` mask.

    An entity with more steps gives several windows, numbered by ``window_no``: every array is
    bounded and no step is dropped.
    """
    if length <= 0:
        raise ValueError("length must be positive")
    numbered = number_steps(steps, max_rows=max_rows)
    windows = (
        numbered.withColumn("window_no", F.floor(F.col("step") / length).cast("bigint"))
        .groupBy(ID, "window_no")
        .agg(F.sort_array(F.collect_list(F.struct("step", *columns))).alias("_rows"))
    )
    missing = F.lit(length) - F.size("_rows")
    arrays = [
        F.concat(
            F.col(f"_rows.{c}").cast("array<double>"),
            F.array_repeat(F.lit(0.0), missing),
        ).alias(c)
        for c in columns
    ]
    valid = F.concat(
        F.array_repeat(F.lit(1.0), F.size("_rows")), F.array_repeat(F.lit(0.0), missing)
    ).alias("valid")
    return windows.select(ID, "window_no", *arrays, valid)


def step_displacement(
    vectors: DataFrame,
    keys: list[str],
    order: list[str],
    vector: str,
    *,
    chunk: str | None = None,
    first_from_zero: bool = True,
) -> DataFrame:
    """Euclidean distance between consecutive state vectors; the first starts from zero."""
    runs = {"_previous": Run("last", F.col(vector), inclusive=False)}
    out = running(vectors, keys, order, runs, chunk=chunk)
    zero = F.transform(vector, lambda x: x * 0)
    previous = F.coalesce(F.col("_previous"), zero) if first_from_zero else F.col("_previous")
    squares = F.zip_with(
        F.col(vector), previous, lambda a, b: F.pow(a.cast("double") - b.cast("double"), F.lit(2.0))
    )
    norm = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))
    return out.withColumn("displacement", norm).drop("_previous")
