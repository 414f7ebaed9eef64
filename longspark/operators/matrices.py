"""Designs of row and column labels as one matrix a row: permutations, crossed resamples, omissions.

A group's cells are gathered once, behind a check of their number (``shape``); replicates are dealt out as blocks of rows.
The callers in ``resample`` and ``variance`` keep a joined form for groups beyond that size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longspark.functions.draws import driver_draw

# Cells of one group that a task may hold as a matrix.
MAX_CELLS = 200_000
# Replicates that one row works out, and doubles that it holds at once.
REPLICATES = 1000
MAX_DOUBLES = 2_000_000


@dataclass(frozen=True)
class Shape:
    """The most cells of a group, whether a cell is repeated, and whether every group has all its cells."""

    largest: int
    repeated: bool
    complete: bool

    @property
    def fits(self) -> bool:
        return self.largest <= MAX_CELLS and not self.repeated


def shape(cells: DataFrame, by: list[str], row: str, col: str) -> Shape:
    """Sizes of all groups in one aggregation, combined before the shuffle."""
    once = cells.where(F.col(row).isNotNull() & F.col(col).isNotNull()).groupBy(*by, row, col).agg(F.count(F.lit(1)).alias("_n"))
    sizes = once.groupBy(*by).agg(
        F.sum("_n").alias("_cells"),
        F.max("_n").alias("_most"),
        (F.count_distinct(row) * F.count_distinct(col) > F.count(F.lit(1))).alias("_holes"),
    )
    largest, most, holes = sizes.agg(F.max("_cells"), F.max("_most"), F.max("_holes")).first()
    return Shape(largest or 0, (most or 0) > 1, not holes)


def gathered(cells: DataFrame, by: list[str], row: str, col: str, values: list[str]) -> DataFrame:
    """One row per group: the labels of its cells, their text, and their values, as arrays side by side."""
    fields = {"_rows": F.col(row), "_cols": F.col(col), "_row_text": F.col(row).cast("string"), "_col_text": F.col(col).cast("string")}
    fields |= {f"_v{i}": F.col(v).cast("double") for i, v in enumerate(values)}
    known = cells.where(F.col(row).isNotNull() & F.col(col).isNotNull())
    packed = known.groupBy(*by).agg(F.collect_list(F.struct(*[c.alias(n) for n, c in fields.items()])).alias("_cells"))
    return packed.select(*by, *[F.col(f"_cells.{n}").alias(n) for n in fields])


def dealt(groups: DataFrame, by: list[str], resamples: int) -> DataFrame:
    """Each group once for every block of replicates (``_first``), spread over the tasks."""
    if resamples <= 0:
        raise ValueError("the number of replicates must be positive")
    firsts = F.explode(F.sequence(F.lit(1), F.lit(resamples), F.lit(REPLICATES)))
    return groups.withColumn("_first", firsts).repartition(*by, "_first")


class Matrix:
    """Values by sorted row and column label; absent cells are NaN."""

    def __init__(self, record: dict, count: int):
        self.rows, self.cols = sorted(set(record["_rows"])), sorted(set(record["_cols"]))
        at_row = {v: i for i, v in enumerate(self.rows)}
        at_col = {v: i for i, v in enumerate(self.cols)}
        i = np.array([at_row[v] for v in record["_rows"]], int)
        j = np.array([at_col[v] for v in record["_cols"]], int)
        self.row_text, self.col_text = [None] * len(self.rows), [None] * len(self.cols)
        for k, (a, b) in enumerate(zip(i, j)):
            self.row_text[a], self.col_text[b] = record["_row_text"][k], record["_col_text"][k]
        self.values = []
        for k in range(count):
            m = np.full((len(self.rows), len(self.cols)), np.nan)
            m[i, j] = np.array([np.nan if v is None else v for v in record[f"_v{k}"]], float)
            self.values.append(m)


def pearson(x: np.ndarray, y: np.ndarray, least: int = 3) -> np.ndarray:
    """Correlation along the last axis over the places that both have; NaN for few or constant ones."""
    both = ~(np.isnan(x) | np.isnan(y))
    n = both.sum(-1)

    def centred(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        spread = np.where(both, v, -np.inf).max(-1, initial=-np.inf) - np.where(both, v, np.inf).min(-1, initial=np.inf)
        mean = np.where(both, v, 0.0).sum(-1) / np.maximum(n, 1)
        return np.where(both, v - mean[..., None], 0.0), spread

    (a, wide_a), (b, wide_b) = centred(x), centred(y)
    scale = np.sqrt((a * a).sum(-1) * (b * b).sum(-1))
    usable = (n >= least) & (wide_a > 0) & (wide_b > 0) & (scale > 0)
    return np.where(usable, (a * b).sum(-1) / np.where(usable, scale, 1.0), np.nan)


def average_rank(v: np.ndarray) -> np.ndarray:
    """Ranks from 1; equal values share their average rank."""
    _, number, counts = np.unique(v, return_inverse=True, return_counts=True)
    return (np.cumsum(counts) - (counts - 1) / 2)[number.reshape(v.shape)]


def spearman(x: np.ndarray, y: np.ndarray) -> float:
    both = ~(np.isnan(x) | np.isnan(y))
    return float(pearson(average_rank(x[both]), average_rank(y[both])))


@dataclass
class Margins:
    """Sums and counts by row, by column and in all, from which a row or column can be taken out."""

    m: np.ndarray

    def __post_init__(self):
        seen = ~np.isnan(self.m)
        filled = np.where(seen, self.m, 0.0)
        self.seen, self.filled = seen, filled
        self.row_sum, self.row_n = filled.sum(1), seen.sum(1)
        self.col_sum, self.col_n = filled.sum(0), seen.sum(0)

    def residuals(self, without_row: int | None = None, without_col: int | None = None) -> np.ndarray:
        """Value less row and column mean plus the grand mean, of what is left."""
        rows, cols = (self.row_sum, self.row_n), (self.col_sum, self.col_n)
        total, count = self.row_sum.sum(), self.row_n.sum()
        if without_row is not None:
            cols = (cols[0] - self.filled[without_row], cols[1] - self.seen[without_row])
            total, count = total - self.row_sum[without_row], count - self.row_n[without_row]
        if without_col is not None:
            rows = (rows[0] - self.filled[:, without_col], rows[1] - self.seen[:, without_col])
            total, count = total - self.col_sum[without_col], count - self.col_n[without_col]
        row_mean, col_mean = rows[0] / np.maximum(rows[1], 1), cols[0] / np.maximum(cols[1], 1)
        out = self.m - row_mean[:, None] - col_mean[None, :] + total / max(count, 1)
        if without_row is not None:
            out = np.delete(out, without_row, 0)
        return out if without_col is None else np.delete(out, without_col, 1)


def residual_correlations(x: np.ndarray, y: np.ndarray) -> tuple[int, float, float]:
    """Cells, Pearson and Spearman of residuals, whose last bits are noise: ties are taken at 12 decimals."""
    x, y = np.round(x.ravel(), 12), np.round(y.ravel(), 12)
    r = float(pearson(x, y))
    return int((~(np.isnan(x) & np.isnan(y))).sum()), r, float("nan") if np.isnan(r) else spearman(x, y)


def omissions(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[str, int, int, float, float]]:
    """(axis, label number, cells, Pearson, Spearman) of the residuals without each row and without each column."""
    a, b = Margins(x), Margins(y)
    for i in range(x.shape[0]):
        yield "context", i, *residual_correlations(a.residuals(without_row=i), b.residuals(without_row=i))
    for j in range(x.shape[1]):
        yield "model", j, *residual_correlations(a.residuals(without_col=j), b.residuals(without_col=j))


class Draws:
    """Draws of the labels of an axis, kept for groups with the same labels."""

    def __init__(self, seed: int):
        self.seed, self.kept = seed, {}

    def get(self, axis: str, n: int, first: int, count: int) -> np.ndarray:
        key = (axis, n, first, count)
        if key not in self.kept:
            self.kept = dict(list(self.kept.items())[-7:])
            drawn = [[driver_draw(self.seed, r, axis, k) for k in range(1, n + 1)] for r in range(first, first + count)]
            self.kept[key] = np.array(drawn, np.int64).reshape(count, n)
        return self.kept[key]

    def permutations(self, axis: str, n: int, first: int, count: int) -> np.ndarray:
        """For each replicate the place of each label in the order of the draws."""
        return np.argsort(np.argsort(self.get(axis, n, first, count), axis=1, kind="stable"), axis=1, kind="stable")


def _pieces(first: int, resamples: int, cells: int) -> Iterator[tuple[int, int]]:
    end, step = min(resamples + 1, first + REPLICATES), max(1, MAX_DOUBLES // max(cells, 1))
    for at in range(first, end, step):
        yield at, min(step, end - at)


def _key_fields(df: DataFrame, by: list[str]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema if f.name in by)


def permutation_counts(groups: DataFrame, by: list[str], resamples: int, seed: int) -> DataFrame:
    """(observed, exceedances) per group: both axes of the first value are permuted against the second."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        draws = Draws(seed)
        for pdf in frames:
            out = []
            for record in pdf.to_dict("records"):
                x, y = Matrix(record, 2).values
                observed, hits = float(pearson(x.ravel(), y.ravel())), 0
                if not np.isnan(observed):
                    for first, count in _pieces(record["_first"], resamples, x.size):
                        pi = draws.permutations("i", x.shape[0], first, count)
                        pj = draws.permutations("j", x.shape[1], first, count)
                        moved = x[pi[:, :, None], pj[:, None, :]].reshape(count, -1)
                        # the identical arrangement may differ in the last bits of its sum
                        hits += int((np.abs(pearson(moved, y.ravel()[None, :])) >= abs(observed) - 1e-12).sum())
                out.append({**{k: record[k] for k in by}, "observed": None if np.isnan(observed) else observed, "exceedances": hits})
            yield pd.DataFrame(out, columns=[*by, "observed", "exceedances"])

    counted = dealt(groups, by, resamples).mapInPandas(run, f"{_key_fields(groups, by)}observed double, exceedances long")
    return counted.groupBy(*by).agg(F.max("observed").alias("observed"), F.sum("exceedances").alias("exceedances"))


def crossed_resamples(groups: DataFrame, by: list[str], resamples: int, seed: int, zero_share: float) -> DataFrame:
    """(replicate, mean, ratio): mean of the third value and ratio of the residual sizes of the second and first value.

    Rows and columns of complete matrices are drawn with replacement; residuals are taken about the margins of each
    draw. ``ratio`` is null where the first value has no residual variation.
    """

    def squares(m: np.ndarray) -> np.ndarray:
        rest = m - m.mean(2, keepdims=True) - m.mean(1, keepdims=True) + m.mean((1, 2), keepdims=True)
        inside = (rest * rest).sum((1, 2))
        total = ((m - m.mean((1, 2), keepdims=True)) ** 2).sum((1, 2))
        return np.where(inside <= zero_share * total, 0.0, inside)

    def run(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        draws = Draws(seed)
        for pdf in frames:
            for record in pdf.to_dict("records"):
                standard, forced, effect = Matrix(record, 3).values
                for first, count in _pieces(record["_first"], resamples, 3 * standard.size):
                    i = draws.get("row", standard.shape[0], first, count) % standard.shape[0]
                    j = draws.get("column", standard.shape[1], first, count) % standard.shape[1]
                    s, f, g = (m[i[:, :, None], j[:, None, :]] for m in (standard, forced, effect))
                    below, above = squares(s), squares(f)
                    ratio = np.where(below > 0, np.sqrt(above / np.where(below > 0, below, 1.0)), np.nan)
                    out = pd.DataFrame({"replicate": np.arange(first, first + count), "mean": g.mean((1, 2)), "ratio": ratio})
                    for k in by:
                        out[k] = record[k]
                    yield out

    found = dealt(groups, by, resamples).mapInPandas(run, f"{_key_fields(groups, by)}replicate int, mean double, ratio double")
    return found.withColumn("ratio", F.when(~F.isnan("ratio"), F.col("ratio")))


def omitted_rows(groups: DataFrame, by: list[str]) -> DataFrame:
    """(omitted_axis, omitted_level, n, pearson, spearman) without each label of either axis."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        names = [*by, "omitted_axis", "omitted_level", "n", "pearson", "spearman"]
        for pdf in frames:
            out = []
            for record in pdf.to_dict("records"):
                matrix = Matrix(record, 2)
                for axis, at, n, r, rank in omissions(*matrix.values):
                    if n:
                        label = (matrix.row_text if axis == "context" else matrix.col_text)[at]
                        out.append([*[record[k] for k in by], axis, label, n, r, rank])
            yield pd.DataFrame(out, columns=names)

    fields = "omitted_axis string, omitted_level string, n long, pearson double, spearman double"
    found = groups.mapInPandas(run, _key_fields(groups, by) + fields)
    return found.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("pearson", "spearman")})


SCREENED = ["raw_pearson", "raw_spearman", "context_pearson", "context_spearman", "pearson", "spearman", "same_sign_context", "same_sign_model"]


def screened(groups: DataFrame, by: list[str]) -> DataFrame:
    """Correlations of raw values, of values less their row mean and of two-way residuals, and how often the sign stays without a label."""

    def one(x: np.ndarray, y: np.ndarray) -> list[float]:
        out = [float(pearson(x.ravel(), y.ravel()))]
        out.append(float("nan") if np.isnan(out[0]) else spearman(x.ravel(), y.ravel()))
        centred = [m - (Margins(m).row_sum / np.maximum(Margins(m).row_n, 1))[:, None] for m in (x, y)]
        out += residual_correlations(*centred)[1:]
        whole = residual_correlations(Margins(x).residuals(), Margins(y).residuals())[1:]
        found = list(omissions(x, y))
        for axis in ("context", "model"):
            signs = [np.sign(r) == np.sign(whole[0]) for a, _, _, r, _ in found if a == axis and not np.isnan(r)]
            usable = not np.isnan(whole[0]) and whole[0] != 0
            out.append(float(np.mean(signs)) if usable and signs else 0.0)
        return [*out[:4], *whole, *out[4:]]

    def run(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in frames:
            rows = [[*[r[k] for k in by], *one(*Matrix(r, 2).values)] for r in pdf.to_dict("records")]
            yield pd.DataFrame(rows, columns=[*by, *SCREENED])

    found = groups.mapInPandas(run, _key_fields(groups, by) + ", ".join(f"{c} double" for c in SCREENED))
    return found.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in SCREENED})
