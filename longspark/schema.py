"""Fixed schemas and key lists of the data model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

MICROS_PER_DAY = 86_400_000_000.0

# Event types, in indicator-column order.
EVENT_TYPES = ("observation", "intervention", "encounter")

# Columns of an event file.
EVENT_FILE_COLUMNS = (
    "patient_id",
    "start_time",
    "code",
    "value",
    "unit",
    "event_type",
    "source",
    "metadata",
)

EVENT_FILE_SCHEMA = T.StructType(
    [T.StructField(name, T.StringType()) for name in EVENT_FILE_COLUMNS]
)

# Columns of a tidy metric row.
METRIC_COLUMNS = (
    "model",
    "ablation",
    "n_train",
    "n_fit",
    "n_validation",
    "seed",
    "cohort_seed",
    "subset_seed",
    "model_seed",
    "split",
    "site_or_shift",
    "metric",
    "value",
    "trainable_parameters",
    "backend",
    "world",
    "benchmark",
)

# The columns that identify a metric row, in sort order.
METRIC_KEY = (
    "benchmark",
    "world",
    "cohort_seed",
    "subset_seed",
    "model_seed",
    "n_train",
    "model",
    "ablation",
    "split",
    "site_or_shift",
    "metric",
)

BUNDLE = ("cohort_seed", "subset_seed", "model_seed")

_INTEGER_METRIC_COLUMNS = {
    "n_train",
    "n_fit",
    "n_validation",
    "seed",
    "cohort_seed",
    "subset_seed",
    "model_seed",
    "trainable_parameters",
}


def _metric_type(name: str) -> T.DataType:
    if name == "value":
        return T.DoubleType()
    return T.LongType() if name in _INTEGER_METRIC_COLUMNS else T.StringType()


METRIC_SCHEMA = T.StructType([T.StructField(n, _metric_type(n)) for n in METRIC_COLUMNS])

# Direction of each metric; coverage is judged by its distance from 0.90.
LOWER_IS_BETTER = ("mae", "rmse", "nll", "event_brier", "event_log_loss")
HIGHER_IS_BETTER = ("event_roc_auc", "latent_aligned_r2")
COVERAGE_TARGET = 0.90
TRAIN_SIZES = (5, 10, 20, 40)


@dataclass(frozen=True)
class Task:
    """What to forecast: the value codes, and the event whose next occurrence is labelled."""

    value_codes: tuple[str, ...]
    event_target_type: str = "intervention"
    event_horizon_days: float = 30.0
    jump_codes: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if not self.value_codes or len(set(self.value_codes)) != len(self.value_codes):
            raise ValueError("value_codes must be non-empty and unique")
        if self.event_target_type not in EVENT_TYPES:
            raise ValueError(f"unknown event type {self.event_target_type!r}")
        if not self.event_horizon_days > 0:
            raise ValueError("event_horizon_days must be positive")

    @property
    def horizon_us(self) -> int:
        return int(round(self.event_horizon_days * MICROS_PER_DAY))
