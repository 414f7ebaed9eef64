"""Planned cells as DataFrames: grids of axes, orthogonal arrays, what is still pending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longspark.operators.audit import row_text


def zip_seeds(df: DataFrame, columns: list[str], *, default: int | None = None) -> DataFrame:
    """Equal-length seed arrays zipped (not crossed) into one row per bundle.

    An empty first array takes the default seed; arrays of unequal length are an error.
    """
    first = F.col(columns[0])
    if default is not None:
        first = F.when(F.size(first) == 0, F.array(F.lit(default).cast("bigint"))).otherwise(first)
    arrays = [first, *[F.col(c) for c in columns[1:]]]
    sizes = F.array(*[F.size(a) for a in arrays])
    equal = F.array_min(sizes) == F.array_max(sizes)
    zipped = F.when(equal, F.arrays_zip(*[a.alias(c) for a, c in zip(arrays, columns)])).otherwise(
        F.raise_error(F.lit("seed lists must have equal lengths"))
    )
    kept = [c for c in df.columns if c not in columns]
    rows = df.select(*kept, F.posexplode(zipped).alias("bundle", "z"))
    return rows.select(
        *kept, F.col("bundle").cast("bigint").alias("bundle"), *[F.col(f"z.{c}") for c in columns]
    )


def axis(df: DataFrame, name: str, values: list) -> DataFrame:
    """Repeat every planned row for each value of a short, declared axis."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def plan_grid(
    shards: DataFrame, axes: dict[str, list], *, allowed: Column | None = None
) -> DataFrame:
    """Shards times the declared axes, without the combinations that ``allowed`` rules out."""
    out = shards
    for name, values in axes.items():
        out = axis(out, name, values)
    return out if allowed is None else out.where(allowed)


def benchmark_rules(prefix: str, observing: str, *, head_ablation: str = "no_observation_head") -> Column:
    """Ablations only for models of the prefix; the head ablation only for the observing one."""
    ours = F.col("model").startswith(prefix)
    return (ours | (F.col("ablation") == "none")) & (
        (F.col("ablation") != head_ablation) | (F.col("model") == observing)
    )


def plan_stage(
    bundles: DataFrame,
    stage: str,
    worlds: list[str],
    sizes: list[int],
    modes: dict[str, list[str]],
) -> DataFrame:
    """The cells of one stage: seed bundles times worlds, sizes and mode axes, with a cell id."""
    out = plan_grid(bundles.withColumn("stage", F.lit(stage)), {"world": worlds, "n_train": sizes, **modes})
    parts = [
        F.col("stage"),
        F.col("world"),
        F.concat(F.lit("cohort"), F.col("cohort_seed")),
        F.concat(F.lit("subset"), F.col("subset_seed")),
        F.concat(F.lit("model"), F.col("model_seed")),
        F.concat(F.lit("n"), F.col("n_train")),
        *[F.col(m) for m in modes],
    ]
    return out.withColumn("cell_id", F.concat_ws("__", *parts))


def plan_orthogonal(
    base: DataFrame, cohorts: Column, subsets: Column, models: Column, *, multiplier: int
) -> DataFrame:
    """A Latin-square array: the model of pair (i, j) is number ``(i + m j) mod k``."""
    if multiplier not in (1, 2):
        raise ValueError("multiplier is 1 or 2")
    rows = base.withColumn("_models", models).withColumn("_subsets", subsets)
    kept = [c for c in base.columns]
    rows = rows.select(*kept, "_models", "_subsets", F.posexplode(cohorts).alias("i", "cohort_seed"))
    rows = rows.select(
        *kept, "_models", "i", "cohort_seed", F.posexplode("_subsets").alias("j", "subset_seed")
    )
    at = F.pmod(F.col("i") + F.lit(multiplier) * F.col("j"), F.size("_models"))
    return rows.withColumn("model_seed", F.element_at("_models", at + 1)).drop("_models", "i", "j")


def pending_cells(plan: DataFrame, completed: DataFrame, key: list[str]) -> DataFrame:
    """Planned cells without a completed row."""
    return plan.join(completed.select(*key), key, "left_anti")


def plan_hash(plan: DataFrame, columns: list[str], *, by: tuple[str, ...] = ()) -> DataFrame:
    """One digest per plan, whatever the row order.

    Rows are hashed where they are and the row hashes are summed exactly, so no task sees the
    whole plan.
    """
    number = F.conv(F.substring(F.md5(row_text(plan, columns).cast("binary")), 1, 15), 16, 10).cast("decimal(20,0)")
    total = plan.groupBy(*by).agg(F.count(F.lit(1)).alias("n_cells"), F.sum(number).alias("_sum"))
    seal = F.concat_ws("|", F.col("n_cells").cast("string"), F.col("_sum").cast("string"))
    return total.select(*by, "n_cells", F.sha2(seal.cast("binary"), 256).alias("plan_sha256"))
