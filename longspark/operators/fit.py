"""Many small regressions at once, and the larger Spark ML baselines."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longspark.functions.numeric import finite
from longspark.operators.metrics import moments, unpack
from longspark.session import materialize, release

#: Groups whose coefficients may be broadcast.
MAX_BROADCAST_GROUPS = 100_000


def fit_ridge(
    df: DataFrame, features: list[str], target: str, *, by: tuple[str, ...] = (), alpha: float = 1.0
) -> DataFrame:
    """Ridge with an unpenalised intercept, one fit per group.

    Output: ``by``, ``n``, ``coefficients`` in feature order, ``intercept``. The cross moments
    are Spark aggregates; each fit is then one small Cholesky solve.
    """
    if alpha < 0:
        raise ValueError("alpha must not be negative")
    d = len(features)
    packed = moments(df, list(by), [*features, target])

    def solve(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in batches:
            coefficients, intercepts = [], []
            for means, cross in zip(pdf["means"], pdf["cross"], strict=True):
                m, c = np.asarray(means, float), unpack(np.asarray(cross, float), d + 1)
                lower = np.linalg.cholesky(c[:d, :d] + alpha * np.eye(d))
                w = np.linalg.solve(lower.T, np.linalg.solve(lower, c[:d, d]))
                coefficients.append(w.tolist())
                intercepts.append(float(m[d] - m[:d] @ w))
            out = pdf.drop(columns=["means", "cross"])
            out["coefficients"] = coefficients
            out["intercept"] = intercepts
            yield out

    keys = "".join(
        f"`{f.name}` {f.dataType.simpleString()}, " for f in packed.schema if f.name in by
    )
    return packed.mapInPandas(
        solve, f"{keys}n bigint, coefficients array<double>, intercept double"
    )


def predict_linear(df: DataFrame, fits: DataFrame, features: list[str], *, by: tuple[str, ...] = (), name="prediction"):
    """Predictions of the group's own fit."""
    x = F.array(*[F.col(f).cast("double") for f in features])
    if by:
        joined = df.join(fits.select(*by, "coefficients", "intercept"), list(by))
    else:
        # a single row: one fit for the whole table
        joined = df.withColumn("_one", F.lit(1)).join(
            F.broadcast(fits.select(F.lit(1).alias("_one"), "coefficients", "intercept")), "_one"
        ).drop("_one")
    terms = F.zip_with(x, F.col("coefficients"), lambda a, b: a * b)
    total = F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)
    return joined.withColumn(name, total + F.col("intercept")).drop("coefficients", "intercept")


def _vector(df: DataFrame, features: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=features, outputCol="_features").transform(df)


def fit_logistic_balanced(df: DataFrame, features: list[str], label: str, *, strength: float = 1.0):
    """Logistic regression with class-balanced weights ``n / (2 n_class)``; a Spark ML model.

    The penalty is that of an unscaled sum of losses with inverse strength ``strength``.
    """
    from pyspark.ml.classification import LogisticRegression

    found = df.groupBy(label).count().limit(3).collect()
    if len(found) != 2 or {r[0] for r in found} != {0, 1}:
        raise ValueError(f"{label} must hold both 0 and 1 and nothing else")
    counts = {int(r[0]): r[1] for r in found}
    n = sum(counts.values())
    weight = F.lit(None).cast("double")
    for value, count in counts.items():
        weight = F.when(F.col(label) == value, F.lit(n / (2.0 * count))).otherwise(weight)
    model = LogisticRegression(
        featuresCol="_features",
        labelCol=label,
        weightCol="_weight",
        regParam=1.0 / (strength * n),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=1000,
        tol=1e-9,
    )
    data = _vector(df.withColumn("_weight", weight), features)
    return model.fit(data.withColumn(label, F.col(label).cast("double")))


def fit_logistic_grouped(
    df: DataFrame, features: list[str], label: str, *, by: list[str], strength: float = 1.0, rounds: int = 100, tol: float = 1e-10
) -> DataFrame:
    """The regressions of ``fit_logistic_balanced``, one per group, all groups in the same few jobs.

    Output: ``by``, ``n``, ``n_positive``, ``coefficients`` (the intercept first), ``converged``. A round of Newton steps is one
    aggregation: loss, gradient and Hessian of each group are added up map-side, so a row per group and task travels,
    however many rows a group has. A step that raises the loss is halved. Groups that are done leave the next rounds.

    Rows with a feature that is missing or not finite, a label that is neither 0 nor 1 or a key without a value are left out. A group
    with one class only has null coefficients. No rows, no fits.
    """
    if strength <= 0:
        raise ValueError("strength must be positive")
    d = len(features) + 1
    upper = [(i, j) for i in range(d) for j in range(i, d)]
    x = [F.lit(1.0), *[F.col(f).cast("double") for f in features]]
    usable = F.col(label).cast("double").isin(0.0, 1.0)
    for c in x[1:]:
        usable = usable & F.coalesce(finite(c), F.lit(False))
    data = df.where(usable).dropna(subset=by).select(*by, F.array(*x).alias("_x"), F.col(label).cast("double").alias("_y"))
    data = materialize(data)

    counts = data.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("_y").cast("bigint").alias("n_positive"))
    zeros = F.array(*[F.lit(0.0)] * d)
    one_class = (F.col("n_positive") == 0) | (F.col("n_positive") == F.col("n"))
    state = counts.select(
        *by, "n", "n_positive", zeros.alias("at"), zeros.alias("best"), F.lit(None).cast("double").alias("loss"), one_class.alias("done")
    )
    state = materialize(state)
    schema = state.schema

    def move(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        penalty = np.diag([0.0] + [1.0 / strength] * (d - 1))
        for pdf in batches:
            rows = []
            for at, best, before, loss, sums in zip(pdf["at"], pdf["best"], pdf["loss"], pdf["_loss"], pdf["_sums"], strict=True):
                at, best, sums = np.asarray(at, float), np.asarray(best, float), np.asarray(sums, float)
                loss += 0.5 * at @ penalty @ at
                if before is not None and not np.isnan(before) and loss > before + 1e-12 * abs(before):
                    half = (at + best) / 2
                    rows.append((half, best, before, bool(np.abs(half - best).max() <= tol * (1 + np.abs(best).max()))))
                    continue
                hessian = np.empty((d, d))
                for (i, j), h in zip(upper, sums[d:]):
                    hessian[i, j] = hessian[j, i] = h
                step = np.linalg.lstsq(hessian + penalty, sums[:d] + penalty @ at, rcond=None)[0]
                rows.append((at - step, at, loss, bool(np.abs(step).max() <= tol * (1 + np.abs(at).max()))))
            out = pdf.drop(columns=["_loss", "_sums"])
            for i, name in enumerate(("at", "best", "loss", "done")):
                out[name] = [r[i].tolist() if i < 2 else r[i] for r in rows]
            yield out[[f.name for f in schema]]

    for _ in range(rounds):
        active = state.where("not done")
        left = active.count()
        if not left:
            break
        own = F.broadcast(active) if left <= MAX_BROADCAST_GROUPS else active
        rows = data.join(own, by)
        weight = F.col("n") / (2 * F.when(F.col("_y") == 1, F.col("n_positive")).otherwise(F.col("n") - F.col("n_positive")))
        terms = F.zip_with("_x", "at", lambda a, b: a * b)
        rows = rows.select(*by, "_x", "_y", weight.alias("_w"), F.aggregate(terms, F.lit(0.0), lambda a, t: a + t).alias("_eta"))
        p = 1 / (1 + F.exp(-F.col("_eta")))
        rows = rows.select(*by, "_x", "_y", "_w", "_eta", p.alias("_p"))
        margin = (1 - 2 * F.col("_y")) * F.col("_eta")
        loss = F.col("_w") * (F.greatest(margin, F.lit(0.0)) + F.log1p(F.exp(-F.abs(margin))))
        slope, bend = F.col("_w") * (F.col("_p") - F.col("_y")), F.col("_w") * F.col("_p") * (1 - F.col("_p"))
        at = [F.col("_x")[i] for i in range(d)]
        sums = [F.sum(slope * a) for a in at] + [F.sum(bend * at[i] * at[j]) for i, j in upper]
        moved = rows.groupBy(*by).agg(F.sum(loss).alias("_loss"), F.array(*sums).alias("_sums")).join(own, by)
        before, state = state, materialize(moved.mapInPandas(move, schema).union(state.where("done").select(schema.names)))
        release(before)
    release(data)
    fitted = (F.col("n_positive") > 0) & (F.col("n_positive") < F.col("n"))
    return state.select(
        *by, "n", "n_positive", F.when(fitted, F.col("at")).alias("coefficients"), (fitted & F.col("done")).alias("converged")
    )


def predict_logistic(df: DataFrame, fits: DataFrame, features: list[str], *, by: list[str], name: str = "probability") -> DataFrame:
    """Probabilities of the group's own fit; null where it has none or a feature is missing."""
    x = F.array(F.lit(1.0), *[F.col(f).cast("double") for f in features])
    joined = df.join(fits.select(*by, "coefficients"), by, "left")
    terms = F.zip_with(x, "coefficients", lambda a, b: a * b)
    eta = F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)
    return joined.withColumn(name, 1 / (1 + F.exp(-eta))).drop("coefficients")


def fit_gbt(df: DataFrame, features: list[str], target: str, *, trees: int = 100, depth: int = 5, seed: int = 0):
    """Gradient-boosted trees; a Spark ML model."""
    from pyspark.ml.regression import GBTRegressor

    model = GBTRegressor(
        featuresCol="_features",
        labelCol=target,
        maxIter=trees,
        maxDepth=depth,
        stepSize=0.1,
        minInstancesPerNode=20,
        seed=seed,
    )
    return model.fit(_vector(df, features))


def predict_model(model, df: DataFrame, features: list[str]) -> DataFrame:
    return model.transform(_vector(df, features)).drop("_features")
