"""Benchmarks as one lazy plan: budgets, grouped fits, evaluation, tidy rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longspark.operators import metrics, sampling
from longspark.operators.fit import fit_ridge
from longspark.session import materialize

ID = "patient_id"
# Cells of one plan that may be broadcast to the test examples (a few hundred bytes each).
MAX_BROADCAST_CELLS = 50_000


def benchmark_cells(
    examples: DataFrame,
    entities: DataFrame,
    features: list[str],
    *,
    sizes: list[int],
    seeds: list[int],
    cohort: str = "site",
    alpha: float = 1.0,
    test_by: tuple[str, ...] = (),
    fit_on: object = None,
) -> DataFrame:
    """Metric rows of every (cohort, seed, size, model) cell.

    Each cell fits a ridge on its budget's ``fit`` entities and is scored, like the two naive
    forecasts, on all test entities of the cohort. ``test_by`` adds columns that split the test
    rows, such as a site. With ``fit_on``, fits come from that cohort's budgets alone, and every fit is
    scored on the test entities of each cohort: what its forecasts are worth elsewhere.
    """
    # fitted on, and scored on
    needed = dict.fromkeys([ID, cohort, *test_by, *features, "last_value", "running_mean", "target"])
    examples = materialize(examples.select(*needed))
    split = materialize(
        sampling.split_entities(
            entities, by=(cohort,), seed=0, train_fraction=0.8, val_fraction=0.0
        ).select(ID, cohort, "split")
    )
    pool = split.where(F.col("split") == "train").select(ID, cohort)
    if fit_on is not None:
        pool = pool.where(F.col(cohort) == F.lit(fit_on))
    members = sampling.budgets(pool, sizes, seeds, by=(cohort,))
    fit_members = members.where(F.col("role") == "fit").select(
        ID, "subset_seed", "n_train"
    )
    cell = (cohort, "subset_seed", "n_train")
    cohorts = entities.select(cohort).distinct().count()
    cells = cohorts * len(seeds) * len(sizes)
    rows = examples.join(fit_members, ID)
    fits = fit_ridge(rows, features, "target", by=cell, alpha=alpha)

    test = examples.join(split.where(F.col("split") == "test").select(ID), ID)
    if fit_on is not None:
        # one row: the fits of all seeds and sizes, for every test example
        every = fits.drop(cohort).agg(F.collect_list(F.struct("subset_seed", "n_train", "coefficients", "intercept")).alias("_fits"))
        scored = test.join(F.broadcast(every)).select("*", F.explode("_fits").alias("_fit")).select("*", "_fit.*")
    else:
        scored = test.join(F.broadcast(fits) if cells <= MAX_BROADCAST_CELLS else fits, cohort)
    x = F.array(*[F.col(f).cast("double") for f in features])
    terms = F.zip_with(x, F.col("coefficients"), lambda a, b: a * b)
    ridge = F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t) + F.col("intercept")
    y = F.col("target")
    aggs = []
    for name, p in (("last_value", F.col("last_value")), ("running_mean", F.col("running_mean")), ("ridge", ridge)):
        aggs += [metrics.mae(y, p).alias(f"{name}|mae"), metrics.rmse(y, p).alias(f"{name}|rmse")]
    wide = scored.groupBy(*cell, *test_by).agg(*aggs)
    names = [c for c in wide.columns if "|" in c]
    tidy = wide.unpivot([*cell, *test_by], names, "_name", "value")
    parts = F.split("_name", "\\|")
    return tidy.select(
        *cell, *test_by, parts[0].alias("model"), parts[1].alias("metric"), "value"
    )


def shift_rows(tidy: DataFrame, keys: list[str], *, train_site: int = 0, site: str = "site") -> DataFrame:
    """Per-site rows plus, for each other site, its difference from the training site."""
    base = tidy.where(F.col(site) == train_site).select(*keys, F.col("value").alias("_base"))
    label = F.concat(F.lit("site_"), F.col(site).cast("string"))
    own = tidy.select(*keys, label.alias("site_or_shift"), "value")
    others = tidy.where(F.col(site) != train_site).join(base, keys)
    shift = others.select(
        *keys,
        F.concat(label, F.lit(f"_minus_site_{train_site}")).alias("site_or_shift"),
        (F.col("value") - F.col("_base")).alias("value"),
    )
    return own.unionByName(shift)
