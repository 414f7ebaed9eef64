"""As-of lookups into a truth table without a range join.

Steps and truth rows are put in one ordered stream per entity; the wanted row is the last truth
row seen while walking that stream, so each side is shuffled once and nothing is paired up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longspark.operators import timeline as tl
from longspark.operators.scan import MAX_ROWS, Run, add_chunks, running

ID = tl.ID
_TRUTH, _STEP = 0, 1


def _stream(steps: DataFrame, truth: DataFrame, task, max_rows: int):
    wide = truth.groupBy(ID, "us").agg(
        *[
            F.max_by("value", F.when(F.col("code") == c, F.col("seq"))).alias(f"truth_{c}")
            for c in task.value_codes
        ]
    )
    both = steps.select(ID, "us", F.lit(_STEP).alias("_kind")).unionByName(
        wide.withColumn("_kind", F.lit(_TRUTH)), allowMissingColumns=True
    )
    rows = steps.select(ID).unionByName(truth.select(ID))
    return add_chunks(both, [ID], "us", ties=("_kind",), max_rows=max_rows, sized_by=rows)


def _seen(code: str):
    value = F.col(f"truth_{code}")
    return F.when(value.isNotNull(), F.struct(F.col("us"), value.alias("value")))


def next_truth_asof(steps: DataFrame, truth: DataFrame, task, *, max_rows: int = MAX_ROWS):
    """Per step and code: the first truth value strictly after the step."""
    both, chunk = _stream(steps, truth, task, max_rows)
    # descending, a step comes before truth of its own instant and so does not see it
    runs = {f"_f_{c}": Run("last", _seen(c), False, True) for c in task.value_codes}
    out = running(both, [ID], ["us", "_kind"], runs, chunk=chunk).where(F.col("_kind") == _STEP)
    columns = []
    for c in task.value_codes:
        columns += [
            F.col(f"_f_{c}.us").alias(f"truth_us_{c}"),
            F.col(f"_f_{c}.value").alias(f"truth_value_{c}"),
        ]
    return out.select(ID, "us", *columns)


def nearest_asof(steps: DataFrame, truth: DataFrame, task, *, max_rows: int = MAX_ROWS):
    """Per step and code: the truth value nearest in time, the earlier one on a tie."""
    both, chunk = _stream(steps, truth, task, max_rows)
    runs = {}
    for c in task.value_codes:
        runs[f"_b_{c}"] = Run("last", _seen(c), False, False)
        runs[f"_f_{c}"] = Run("last", _seen(c), False, True)
    out = running(both, [ID], ["us", "_kind"], runs, chunk=chunk).where(F.col("_kind") == _STEP)
    columns = []
    for c in task.value_codes:
        back, ahead = F.col(f"_b_{c}"), F.col(f"_f_{c}")
        use_back = back.isNotNull() & (
            ahead.isNull() | (F.col("us") - back["us"] <= ahead["us"] - F.col("us"))
        )
        columns += [
            F.when(use_back, back["us"]).otherwise(ahead["us"]).alias(f"truth_us_{c}"),
            F.when(use_back, back["value"]).otherwise(ahead["value"]).alias(f"truth_value_{c}"),
        ]
    return out.select(ID, "us", *columns)


def truth_examples(
    sequences: DataFrame, truth: DataFrame, task, features: list[str], *, max_rows: int = MAX_ROWS
) -> DataFrame:
    """One row per (step, code) that has a later truth value."""
    found = next_truth_asof(sequences, truth, task, max_rows=max_rows)
    joined = sequences.select(ID, "us", "step", *features).join(found, [ID, "us"])
    entries = F.array(
        *[
            F.struct(F.lit(c).alias("code"), F.col(f"truth_value_{c}").alias("target"))
            for c in task.value_codes
        ]
    )
    rows = joined.select(ID, "us", "step", *features, F.explode(entries).alias("e"))
    return rows.select(
        ID, "us", "step", *features, F.col("e.code").alias("code"), F.col("e.target").alias("target")
    ).where(F.col("target").isNotNull())
