"""Point, probabilistic and event-risk metrics as grouped aggregates."""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longspark.functions.numeric import clip
from longspark.operators.scan import MAX_ROWS, Run, add_chunks, running

# Clip of probabilities and log scales, 90% radius of a standard normal.
PROBABILITY_CLIP = 1e-7
LOG_SCALE_LIMIT = 7.0
RADIUS_90 = 1.6448536269514722
HALF_LOG_TWO_PI = 0.5 * math.log(2.0 * math.pi)

# Columns whose cross moments one aggregation takes at once.
WIDE = 8


def safe_probability(p: Column) -> Column:
    return clip(p, PROBABILITY_CLIP, 1.0 - PROBABILITY_CLIP)


def safe_log_scale(s: Column) -> Column:
    return clip(s, -LOG_SCALE_LIMIT, LOG_SCALE_LIMIT)


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg((y - p) * (y - p)))


def brier(label: Column, p: Column) -> Column:
    error = safe_probability(p) - label
    return F.avg(error * error)


def log_loss(label: Column, p: Column) -> Column:
    q = safe_probability(p)
    return -F.avg(label * F.log(q) + (F.lit(1.0) - label) * F.log(F.lit(1.0) - q))


def interval_coverage(y: Column, low: Column, high: Column) -> Column:
    return F.avg(((y >= low) & (y <= high)).cast("double"))


def gaussian_term(y: Column, mean: Column, log_scale: Column) -> Column:
    s = safe_log_scale(log_scale)
    error = y - mean
    return F.lit(0.5) * error * error * F.exp(F.lit(-2.0) * s) + s + F.lit(HALF_LOG_TWO_PI)


def gaussian_nll(y: Column, mean: Column, log_scale: Column) -> Column:
    return F.avg(gaussian_term(y, mean, log_scale))


def coverage_90(y: Column, mean: Column, log_scale: Column) -> Column:
    radius = F.lit(RADIUS_90) * F.exp(safe_log_scale(log_scale))
    return interval_coverage(y, mean - radius, mean + radius)


def half_squared_term(y: Column, mean: Column) -> Column:
    return F.lit(0.5) * (y - mean) * (y - mean)


def logit_term(label: Column, logit: Column) -> Column:
    """Cross entropy of a logit, stable for large magnitudes."""
    return F.greatest(logit, F.lit(0.0)) - logit * label + F.log1p(F.exp(-F.abs(logit)))


def masked_mean(term: Column, mask: Column) -> Column:
    """Mean of ``term`` over the rows of weight ``mask``; 0 when there are none."""
    weight = mask.cast("double")
    return F.coalesce(F.sum(term * weight), F.lit(0.0)) / F.greatest(F.sum(weight), F.lit(1.0))


def total_loss(
    value: Column, event: Column, observation: Column | None = None, *, lambda_event=1.0, lambda_obs=0.2
) -> Column:
    out = value + F.lit(lambda_event) * event
    return out if observation is None else out + F.lit(lambda_obs) * observation


def _score_counts(
    df: DataFrame, keys: list[str], label: str, score: Column, max_rows: int
) -> DataFrame:
    """Positives and negatives per (group, score), with the negatives of all lower scores.

    Rows collapse to one per distinct score first; the running count then walks those, in
    chunks where a group has many.
    """
    counts = df.groupBy(*keys, score.alias("_score")).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("_pos"),
        F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("_neg"),
    )
    # rows per group bound its distinct scores and are cheaper to count
    cut, chunk = add_chunks(counts, keys, "_score", max_rows=max_rows, sized_by=df)
    runs = {"_below": Run("sum", F.col("_neg"), inclusive=False)}
    return running(cut, keys, ["_score"], runs, chunk=chunk)


def _auc() -> Column:
    below = F.coalesce(F.col("_below"), F.lit(0)).cast("double")
    wins = F.sum(F.col("_pos") * (below + F.col("_neg") / F.lit(2.0)))
    # null, not an error, when a class is absent
    return F.try_divide(wins, F.sum("_pos").cast("double") * F.sum("_neg").cast("double"))


def roc_auc(
    df: DataFrame, by: list[str], label: str, score: Column, *, max_rows: int = MAX_ROWS
) -> DataFrame:
    """Area under the ROC curve per group, ties counted half, null for a single class."""
    keys = by or ["_all"]
    base = df if by else df.withColumn("_all", F.lit(0))
    out = _score_counts(base, keys, label, score, max_rows).groupBy(*keys).agg(_auc().alias("roc_auc"))
    return out if by else out.drop("_all")


def event_metrics(
    df: DataFrame,
    by: list[str],
    *,
    label: str = "label",
    probability: str = "probability",
    valid: str = "valid",
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """Brier score, log loss and AUC on the rows whose label is usable.

    All three come from the same counts per distinct probability.
    """
    keys = by or ["_all"]
    rows = df.where(F.col(valid) == 1)
    base = rows if by else rows.withColumn("_all", F.lit(0))
    counts = _score_counts(base, keys, label, safe_probability(F.col(probability)), max_rows)
    p, pos, neg = F.col("_score"), F.col("_pos"), F.col("_neg")
    n = F.sum(pos + neg)
    square = pos * (F.lit(1.0) - p) * (F.lit(1.0) - p) + neg * p * p
    log = pos * F.log(p) + neg * F.log(F.lit(1.0) - p)
    out = counts.groupBy(*keys).agg(
        (F.sum(square) / n).alias("event_brier"),
        (-F.sum(log) / n).alias("event_log_loss"),
        _auc().alias("event_roc_auc"),
    )
    return out if by else out.drop("_all")


def point_aggregates(y: Column, mean: Column, log_scale: Column) -> list[Column]:
    return [
        mae(y, mean).alias("mae"),
        rmse(y, mean).alias("rmse"),
        gaussian_nll(y, mean, log_scale).alias("nll"),
        coverage_90(y, mean, log_scale).alias("coverage_90"),
    ]


def evaluate(points: DataFrame, risks: DataFrame, by: list[str]) -> DataFrame:
    """All metrics per group: value forecasts (y, mean, log_scale) and event risks."""
    values = points.groupBy(*by).agg(
        *point_aggregates(F.col("y"), F.col("mean"), F.col("log_scale"))
    )
    return values.join(event_metrics(risks, by), by)


def metric_rows(wide: DataFrame, metrics: list[str]) -> DataFrame:
    """Wide metric columns to one row per metric."""
    keys = [c for c in wide.columns if c not in metrics]
    return wide.unpivot(keys, metrics, "metric", "value")


def moments(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Means and centred cross moments of ``columns`` per group, as arrays.

    Only complete rows count: a row with a null or NaN in any of the columns is left out of ``n`` too.

    Uses mergeable covariance aggregates, so a group of any size combines map-side. Many
    columns go one matrix row at a time: hundreds of aggregates in one operator are slow.
    """
    df = df.dropna(subset=list(dict.fromkeys(columns)))
    if len(columns) > WIDE:
        return _moments_by_row(df, by, columns)
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    aggs = [F.avg(c).alias(f"_m{i}") for i, c in enumerate(columns)]
    aggs += [F.covar_pop(columns[i], columns[j]).alias(f"_c{i}_{j}") for i, j in pairs]
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *aggs)
    scale = F.col("n").cast("double")
    return out.select(
        *by,
        "n",
        F.array(*[F.col(f"_m{i}") for i in range(len(columns))]).alias("means"),
        F.array(*[F.col(f"_c{i}_{j}") * scale for i, j in pairs]).alias("cross"),
    )


def _moments_by_row(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """The same for complete rows of many columns: plain sums of products about overall means."""
    size = len(columns)
    one = F.lit(1).alias("_one")
    vector = F.array(*[F.col(c).cast("double") for c in columns]).alias("_x")
    # the shift keeps the sums small; what it is does not change the centred result
    shift = df.agg(F.array(*[F.avg(c) for c in columns]).alias("_s")).select("_s", one)
    rows = df.select(*by, vector, one).join(F.broadcast(shift), "_one")
    rows = rows.select(*by, F.zip_with("_x", "_s", lambda x, s: x - s).alias("_x"))
    rows = rows.select(*by, "_x", F.posexplode("_x").alias("_i", "_xi"))
    products = [F.sum(F.col("_xi") * F.col("_x")[j]).alias(f"_p{j}") for j in range(size)]
    per_row = rows.groupBy(*by, "_i").agg(
        F.count(F.lit(1)).alias("n"), F.avg("_xi").alias("mean"), *products
    )
    whole = F.array(*[F.col(f"_p{j}") for j in range(size)])
    upper = F.slice(whole, F.col("_i") + 1, F.lit(size) - F.col("_i"))
    # one entry per column
    entries = F.sort_array(F.collect_list(F.struct("_i", "mean", upper.alias("products"))))
    out = per_row.groupBy(*by).agg(F.max("n").alias("n"), entries.alias("_r"), F.max(F.lit(1)).alias("_one"))
    out = out.join(F.broadcast(shift), "_one")
    means, n = F.col("_r.mean"), F.col("n").cast("double")

    def centred(entry: Column) -> Column:
        return F.transform(
            entry["products"],
            lambda p, k: p - n * entry["mean"] * F.get(means, entry["_i"] + k),
        )

    return out.select(
        *by,
        "n",
        F.zip_with("_s", means, lambda s, m: s + m).alias("means"),
        F.flatten(F.transform("_r", centred)).alias("cross"),
    )


def unpack(cross: np.ndarray, size: int) -> np.ndarray:
    """The symmetric matrix of an upper triangle in row order."""
    out = np.zeros((size, size))
    out[np.triu_indices(size)] = cross
    return out + np.triu(out, 1).T


def _aligned_r2(cross: np.ndarray, truth: int, size: int) -> float:
    m = unpack(cross, size)
    xx, xy = m[truth:, truth:], m[truth:, :truth]
    total = np.trace(m[:truth, :truth])
    return float(np.trace(xy.T @ np.linalg.pinv(xx, hermitian=True) @ xy) / total)


def _procrustes(cross: np.ndarray, truth: int, size: int) -> float:
    m = unpack(cross, size)
    norms = np.trace(m[:truth, :truth]) * np.trace(m[truth:, truth:])
    singular = np.linalg.svd(m[:truth, truth:] / np.sqrt(norms), compute_uv=False)
    return float(1.0 - singular.sum() ** 2)


def latent_alignment(
    df: DataFrame, by: list[str], truth: list[str], estimate: list[str]
) -> DataFrame:
    """Variance-weighted R2 of the best affine map, and Procrustes disparity, per group.

    Spark reduces every group to its cross moments; only that small matrix is solved in Python.
    The disparity is null where the dimensions differ.
    """
    t, size = len(truth), len(truth) + len(estimate)
    same = len(truth) == len(estimate)
    packed = moments(df, by, [*truth, *estimate])

    def solve(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in batches:
            cross = [np.asarray(c, dtype=float) for c in pdf["cross"]]
            out = pdf.drop(columns=["means", "cross"])
            out["aligned_r2"] = [_aligned_r2(c, t, size) for c in cross]
            out["procrustes"] = [_procrustes(c, t, size) if same else None for c in cross]
            yield out

    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in packed.schema if f.name in by)
    schema = f"{keys + ', ' if keys else ''}n bigint, aligned_r2 double, procrustes double"
    return packed.mapInPandas(solve, schema)
