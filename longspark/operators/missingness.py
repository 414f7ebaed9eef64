"""Observation masks, noise and named parameter presets applied to a real table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longspark.functions.draws import normal, uniform
from longspark.functions.numeric import clip, sigmoid
from longspark.operators.scan import MAX_ROWS, Run, add_chunks, running

ID = "patient_id"

# Keep probabilities stay inside these bounds.
LOWEST, HIGHEST = 0.02, 0.98
# Intercepts and slopes of the keep logit per regime.
MCAR_LOGIT = -0.2
MAR_INTERCEPT, MAR_SLOPE = -0.6, 0.8
MNAR_INTERCEPT, MNAR_SLOPE = -0.8, 1.1
SITE_INTERCEPTS = (-0.35, -0.65)
SITE_SLOPE = 0.7
# Offsets of the keep logit, per site group, for the 1st, 2nd and 3rd code.
SITE_OFFSETS = ((0.9, -0.7, 0.1), (-0.8, 0.8, -0.2))
# Noise multipliers, per site group, for the 1st, 2nd and 3rd code.
NOISE_MULTIPLIERS = ((0.6, 1.5, 0.9), (1.6, 0.7, 1.3))

REGIMES = ("mcar", "mar", "mnar", "site_shift")


def _by_site_and_code(table: tuple, codes: tuple[str, ...], default: float) -> Column:
    site = F.pmod(F.col("site"), F.lit(2))
    out = None
    for group, row in enumerate(table):
        for code, value in zip(codes, row, strict=True):
            here = (site == group) & (F.col("code") == code)
            out = F.when(here, F.lit(value)) if out is None else out.when(here, F.lit(value))
    return out.otherwise(F.lit(default))


def keep_probability(
    regime: str, codes: tuple[str, ...], state: Column, previous: Column | None = None
) -> Column:
    if regime not in REGIMES:
        raise ValueError(f"unknown regime {regime!r}")
    if regime == "mcar":
        logit = F.lit(MCAR_LOGIT)
    elif regime == "mar":
        logit = F.lit(MAR_INTERCEPT) + F.lit(MAR_SLOPE) * F.coalesce(previous, F.lit(0.0))
    elif regime == "mnar":
        logit = F.lit(MNAR_INTERCEPT) + F.lit(MNAR_SLOPE) * state
    else:
        intercept = F.when(F.pmod(F.col("site"), F.lit(2)) == 0, SITE_INTERCEPTS[0]).otherwise(
            SITE_INTERCEPTS[1]
        )
        logit = intercept + _by_site_and_code(SITE_OFFSETS, codes, 0.0) + F.lit(SITE_SLOPE) * state
    return clip(sigmoid(logit), LOWEST, HIGHEST)


def apply_missingness(
    observations: DataFrame,
    regime: str,
    codes: tuple[str, ...],
    *,
    state: str = "state",
    seed: int = 0,
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """Add ``kept``. Rows carry patient_id, us, seq, code, site and the ``state`` column.

    Under ``mar`` the keep probability depends on the state of the entity's last kept row, a
    sequential rule. A draw below the lowest probability keeps its row whatever came before, so
    it starts a new, independent segment: segments are short and fold separately.
    """
    drawn = observations.withColumn(
        "_u", uniform(seed, "keep", F.col(ID), F.col("us"), F.col("seq"))
    )
    if regime != "mar":
        kept = F.col("_u") < keep_probability(regime, codes, F.col(state))
        return drawn.withColumn("kept", kept).drop("_u")

    sure = F.when(F.col("_u") < F.lit(LOWEST), 1).otherwise(0)
    cut, chunk = add_chunks(drawn, [ID], "us", ties=("seq",), max_rows=max_rows)
    runs = {"_segment": Run("sum", sure.cast("bigint"))}
    cut = running(cut, [ID], ["us", "seq"], runs, chunk=chunk)
    others = [c for c in observations.columns if c not in (ID, "us", "seq")]
    # whole rows travel with their segment, so nothing is joined back
    row = F.struct("us", "seq", "_u", *others)
    groups = cut.groupBy(ID, "_segment").agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    start = F.struct(
        F.lit(None).cast("double").alias("previous"), F.array().cast("array<boolean>").alias("kept")
    )

    def step(acc: Column, r: Column) -> Column:
        now = r[state].cast("double")
        kept = r["_u"] < keep_probability("mar", codes, now, acc["previous"])
        return F.struct(
            F.when(kept, now).otherwise(acc["previous"]).alias("previous"),
            F.concat(acc["kept"], F.array(kept)).alias("kept"),
        )

    flags = F.aggregate("_rows", start, step, lambda acc: acc["kept"])
    rows = groups.select(ID, F.explode(F.arrays_zip("_rows", flags.alias("kept"))).alias("_z"))
    names = [c for c in observations.columns if c != ID]
    out = rows.select(ID, *[F.col(f"_z._rows.{c}").alias(c) for c in names], F.col("_z.kept").alias("kept"))
    return out.select(*observations.columns, "kept")


def add_noise(
    observations: DataFrame,
    regime: str,
    codes: tuple[str, ...],
    *,
    base_scale: float,
    value: str = "value",
    seed: int = 0,
) -> DataFrame:
    """Add Gaussian noise; under ``site_shift`` its scale depends on site and code."""
    factor = (
        _by_site_and_code(NOISE_MULTIPLIERS, codes, 1.0) if regime == "site_shift" else F.lit(1.0)
    )
    z = normal(seed, "noise", F.col(ID), F.col("us"), F.col("seq"))
    return observations.withColumn("noise_scale", F.lit(base_scale) * factor).withColumn(
        "noisy_value", F.col(value) + F.col("noise_scale") * z
    )


def world_overrides(df: DataFrame, settings: dict[str, dict], defaults: dict, *, world: str = "world") -> DataFrame:
    """Add one column per parameter: what ``settings`` has for the row's label, else the default."""
    out = {}
    for name, default in defaults.items():
        value = F.lit(default)
        for label, own in settings.items():
            if name in own:
                value = F.when(F.col(world) == label, F.lit(own[name])).otherwise(value)
        out[name] = value
    return df.withColumns(out)
