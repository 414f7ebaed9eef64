"""Whitening of embeddings by an incremental eigendecomposition.

Each partition of the distinct vectors keeps the eigenvalues and eigenvectors of its scatter matrix and takes in one
vector after the other: centred on the running mean, a vector is a rank-one change, whose eigenvalues are the roots
of a secular equation. Entries that cannot move an eigenvalue are deflated first. Two spectra are combined by as many
rank-one changes as the second has eigenvalues, and one more for the distance of the means, group by group until one is
left. As last step the covariance is taken in that basis (Rayleigh and Ritz), again partition by partition, which gives the
eigenpairs to the precision of a double.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longspark.llm import vectors
from longspark.session import materialize

SCALE = 64
SHIFT = 1_000_000
#: Scaled entries beyond it stand at it; sums of a billion vectors stay exact.
LIMIT = 1 << 31
COMPONENTS = 16
#: Distinct vectors of a partition, and spectra that one task combines.
VECTORS = 8192
SPECTRA = 16

_EPS = float(np.finfo(float).eps)
_PARTS = "part long, n long, sums array<long>, mean array<double>, spectrum array<double>, basis array<double>"


def secular_roots(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """The eigenvalues of ``diag(d) + rho z z'`` and, as ``[i, j]``, ``d[j]`` less eigenvalue ``i``.

    ``d`` ascends strictly, no entry of ``z`` is 0, ``rho`` is positive. Each root lies between two poles; it is
    counted from the nearer one, so that the differences are precise. The steps solve an equation with both poles
    of the root, and halve the bracket where that leaves it.
    """
    m, squares = len(d), z * z
    above = np.append(d[1:], d[-1] + rho * squares.sum())
    width = above - d
    inverse = 1.0 / rho
    apart = d[None, :] - d[:, None]
    middle = inverse + (1.0 / (apart - (width / 2)[:, None])) @ squares
    near = middle >= 0
    near[-1] = True
    origin = np.where(near, d, above)
    apart = d[None, :] - origin[:, None]
    lo, hi = np.where(near, 0.0, -width / 2), np.where(near, width / 2, 0.0)
    if middle[-1] < 0:
        lo[-1], hi[-1] = width[-1] / 2, width[-1]
    tau = (lo + hi) / 2
    below = np.tri(m)
    at = np.arange(m)
    next_pole = above - origin
    open_ = np.ones(m, bool)
    for _ in range(100):
        parts = 1.0 / (apart - tau[:, None])
        f = inverse + parts @ squares
        open_ &= np.abs(f) > 4 * _EPS * m * (inverse + np.abs(parts) @ squares)
        open_ &= (hi - lo) > 2 * _EPS * np.abs(tau)
        if not open_.any():
            break
        lo, hi = np.where(f < 0, tau, lo), np.where(f < 0, hi, tau)
        one, two = apart[at, at] - tau, next_pole - tau
        parts *= parts
        slope = parts @ squares
        left = (parts * below) @ squares
        right = slope - left
        c = f - one * left - two * right
        a = (one + two) * f - one * two * slope
        b = one * two * f
        with np.errstate(all="ignore"):
            root = np.sqrt(np.abs(a * a - 4 * b * c))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            guess = tau + step
            inside = (guess > lo) & (guess < hi)
        tau = np.where(open_, np.where(inside, guess, (lo + hi) / 2), tau)
    return origin + tau, apart - tau[:, None]


def rank_one(values: np.ndarray, basis: np.ndarray, vector: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """The eigenpairs of ``basis diag(values) basis' + weight vector vector'``; ``values`` ascend, ``weight >= 0``."""
    z = basis.T @ vector
    norm = float(np.sqrt(z @ z))
    rho = weight * norm * norm
    if not rho > 0:
        return values, basis
    z = z / norm
    small = 8 * _EPS * max(float(np.abs(values).max()), rho)
    live = np.flatnonzero(rho * np.abs(z) > small)
    z[np.abs(z) * rho <= small] = 0.0
    values, close = values.copy(), False
    if len(live) > 1:
        c, s = z[live[1:]], z[live[:-1]]
        close = bool((np.diff(values[live]) * np.abs(c * s) <= small * (c * c + s * s)).any())
    if close:
        # equal eigenvalues: turn their eigenvectors until only one of them meets the vector
        basis, kept, last = basis.copy(), [], live[0]
        for j in live[1:]:
            length = float(np.hypot(z[j], z[last]))
            c, s = z[j] / length, z[last] / length
            if (values[j] - values[last]) * abs(c * s) <= small:
                basis[:, last], basis[:, j] = c * basis[:, last] - s * basis[:, j], s * basis[:, last] + c * basis[:, j]
                low, high = values[last], values[j]
                values[last], values[j] = low * c * c + high * s * s, low * s * s + high * c * c
                z[last], z[j] = 0.0, length
            else:
                kept.append(last)
            last = j
        live = np.array([*kept, last])
    if len(live) == 1:
        values[live] += rho * z[live] ** 2
    elif len(live):
        d, part = values[live], z[live]
        order = np.argsort(d, kind="stable")
        live, d, part = live[order], d[order], part[order]
        roots, gap = secular_roots(d, part, rho)
        # the vector for which these roots are exact gives orthogonal eigenvectors
        ratio = -gap
        between = d[:, None] - d[None, :]
        np.fill_diagonal(between, 1.0)
        exact = np.sqrt(np.abs((ratio / between).prod(0))) * np.sign(part)
        turned = exact[None, :] / gap
        turned /= np.sqrt((turned * turned).sum(1))[:, None]
        basis = basis.copy()
        basis[:, live] = basis[:, live] @ turned.T
        values[live] = roots
    order = np.argsort(values, kind="stable")
    return np.maximum(values[order], 0.0), basis[:, order]


@dataclass
class Spectrum:
    """Rows seen, their exact sums, their mean less a fixed origin, and the eigenpairs of their scatter matrix."""

    n: int
    sums: np.ndarray
    mean: np.ndarray
    values: np.ndarray
    basis: np.ndarray

    @classmethod
    def empty(cls, width: int) -> Spectrum:
        return cls(0, np.zeros(width, np.int64), np.zeros(width), np.zeros(width), np.eye(width))

    def add(self, x: np.ndarray, origin: np.ndarray) -> None:
        away = (x - origin).astype(float) - self.mean
        self.n += 1
        self.sums = self.sums + x
        self.values, self.basis = rank_one(self.values, self.basis, away, (self.n - 1) / self.n)
        self.mean = self.mean + away / self.n

    def join(self, other: Spectrum) -> None:
        if not other.n:
            return
        away, n = other.mean - self.mean, self.n + other.n
        for value, vector in zip(other.values, other.basis.T):
            self.values, self.basis = rank_one(self.values, self.basis, vector, float(value))
        self.values, self.basis = rank_one(self.values, self.basis, away, self.n * other.n / n)
        self.mean = self.mean + away * (other.n / n)
        self.sums = self.sums + other.sums
        self.n = n

    def row(self, part: int) -> tuple:
        return part, self.n, self.sums.tolist(), self.mean.tolist(), self.values.tolist(), self.basis.ravel().tolist()

    @classmethod
    def of(cls, row: pd.Series) -> Spectrum:
        width = len(row["sums"])
        basis = np.array(row["basis"], float).reshape(width, width)
        return cls(int(row["n"]), np.array(row["sums"], np.int64), np.array(row["mean"], float), np.array(row["spectrum"], float), basis)


def _combined(parts: DataFrame, schema: str, merge: Callable[[pd.DataFrame], tuple], group: int = SPECTRA) -> tuple | None:
    """One row of all: neighbouring ``group`` rows are merged in a task each, level by level; every level is written."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *merge(rows.sort_values("part")))], columns=names)

    parts = materialize(parts)
    while (most := parts.agg(F.max("part")).first()[0]) is not None and most > 0:
        parts = materialize(parts.groupBy(F.floor(F.col("part") / group).alias("_group")).applyInPandas(run, schema))
    return parts.first()


@dataclass(frozen=True)
class Whitening:
    """A fitted transform: the fit list's size and sums, eigenvalues by falling size, and their unit vectors in columns."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float


def integers(rows: DataFrame, vector: str = "embedding", name: str = "x") -> tuple[DataFrame, int]:
    """The rows whose vector is whole, with the integers of its entries as ``name``; the length of the vectors.

    Vectors shorter or longer than most go too, since nothing can be said about their entries.
    """
    kept = rows.where(vectors.is_whole(F.col(vector)))
    width = vectors.usual_length(kept, vector)
    kept = kept.where(F.size(vector) == width)
    return kept.withColumn(name, vectors.scaled(F.col(vector), SCALE, LIMIT, SHIFT)), width


def _moments(fit: DataFrame, sums: np.ndarray, n: int, basis: np.ndarray) -> np.ndarray:
    """The covariance of the centred vectors in the columns of ``basis``, summed up partition by partition."""
    width, size = basis.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            inside = ((vectors.matrix(batch.column(0), width) * n - sums) / n) @ basis
            total += inside.T @ inside
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["part", "moments"])

    def merge(rows: pd.DataFrame) -> tuple:
        return (np.sum(np.stack(rows["moments"].to_numpy()), axis=0).tolist(),)

    schema = "part long, moments array<double>"
    row = _combined(fit.mapInArrow(run, schema), schema, merge)
    return np.array(row["moments"]).reshape(size, size) / n


def fit(rows: DataFrame, width: int, x: str = "x", components: int = COMPONENTS) -> Whitening | None:
    """The transform fitted on each distinct vector of column ``x`` once; None without rows.

    The driver sees one row of sums and square matrices of the vectors' length, whatever the rows.
    Components whose eigenvalue is 0 to the precision of a double (constant directions, fewer vectors than entries)
    cannot be whitened and are left out.
    """
    distinct = materialize(rows.select(F.col(x).alias("x")).distinct())
    count = distinct.count()
    if not count:
        return None
    origin = np.array(distinct.first()["x"], np.int64)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Spectrum.empty(width)
        for batch in batches:
            for one in vectors.matrix(batch.column(0), width):
                seen.add(one, origin)
        row = seen.row(TaskContext.get().partitionId())
        yield pa.RecordBatch.from_pandas(pd.DataFrame([row], columns=[f.split()[0] for f in _PARTS.split(", ")]), preserve_index=False)

    def merge(parts: pd.DataFrame) -> tuple:
        spectra = [Spectrum.of(row) for _, row in parts.iterrows()]
        first = max(range(len(spectra)), key=lambda i: spectra[i].n)
        whole = spectra.pop(first)
        for other in spectra:
            whole.join(other)
        return whole.row(0)[1:]

    dealt = distinct.repartition(-(-count // VECTORS), "x")
    row = _combined(dealt.mapInArrow(scan, _PARTS), _PARTS, merge)
    n, sums = int(row["n"]), np.array(row["sums"], np.int64)
    basis = np.linalg.qr(np.array(row["basis"]).reshape(width, width))[0]
    ritz = _moments(distinct, sums, n, basis)
    values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
    order = np.argsort(values)[::-1]
    values, vectors_ = values[order], (basis @ turn)[:, order]
    trace = float(np.trace(ritz))
    sound = values > width * _EPS * max(trace, 0.0)
    chosen = np.flatnonzero(sound)[:components]
    values, vectors_ = values[chosen], vectors_[:, chosen]
    # of the two signs the one whose largest entry is positive
    largest = np.abs(vectors_).argmax(0) if len(chosen) else np.zeros(0, int)
    vectors_ = vectors_ * np.where(vectors_[largest, np.arange(len(chosen))] < 0, -1.0, 1.0)
    error = 0.0
    if len(chosen):
        error = float(np.abs(_moments(distinct, sums, n, vectors_ / np.sqrt(values)) - np.eye(len(chosen))).max())
    return Whitening(n, sums, values, vectors_, trace, error)


def transform(rows: DataFrame, fitted: Whitening, x: str = "x", prefix: str = "") -> DataFrame:
    """Add ``whitened`` (array of doubles, one a component) and ``deviation`` to rows with a column ``x`` of integers.

    ``deviation``: the sum over the entries of the square of ``n * x`` less their sums, exact; null where it is over 2^63.
    Other columns and repeated rows stay; columns of these names are replaced.
    """
    width, n, sums = len(fitted.sums), fitted.n, fitted.sums
    weights = fitted.components / np.sqrt(fitted.values)

    @F.arrow_udf("whitened array<double>, deviation long")
    def run(column: pa.Array) -> pa.Array:
        away = vectors.matrix(column, width) * n - sums
        rough = (away.astype(float) ** 2).sum(1)
        fits = rough < 2.0**62
        squares = np.where(fits[:, None], away, 0)
        deviation = pa.array((squares * squares).sum(1), mask=~fits)
        inside = (away / n) @ weights
        k = inside.shape[1]
        whitened = pa.ListArray.from_arrays(pa.array(np.arange(len(column) + 1) * k, pa.int32()), pa.array(inside.ravel()))
        return pa.StructArray.from_arrays([whitened, deviation], names=["whitened", "deviation"])

    names = [f"{prefix}whitened", f"{prefix}deviation"]
    rows = rows.drop(*names)
    out = rows.withColumn("_white", run(F.col(x)))
    return out.select(*rows.columns, F.col("_white.whitened").alias(names[0]), F.col("_white.deviation").alias(names[1]))


_LONG = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Fit on the distinct vectors of the table and transform all of it: a row for each row and component.

    The columns of ``rows`` without ``vector`` and (component, n, deviation, whitened, explained, identity_error);
    columns of these names are replaced. ``component`` counts from 1, by falling eigenvalue. Rows whose vector is null, empty, of unusual
    length or not finite have no rows here, nor does a table whose vectors are all equal. Repeated rows are repeated in the result.
    """
    names = [f.split()[0] for f in _LONG.split(", ")]
    plain = rows.select(*[c for c in rows.columns if c not in (*names, vector)], vector)
    x = "_corpus_x"
    kept, width = integers(plain, vector, x)
    found = fit(kept, width, x, components)
    if found is None or not len(found.values):
        out = plain.drop(vector).where(F.lit(False))
        for field in _LONG.split(", "):
            out = out.withColumn(field.split()[0], F.lit(None).cast(field.split()[1]))
        return out
    # one pass of Python a row, before the row is repeated for its components
    done = transform(kept.drop(vector), found, x, "_corpus_").drop(x)
    shares = F.array(*[F.lit(float(v)) for v in found.values / found.trace])
    out = done.select("*", F.posexplode("_corpus_whitened").alias("_corpus_at", "_corpus_one"))
    return out.select(
        *[c for c in plain.columns if c != vector],
        (F.col("_corpus_at") + 1).alias("component"),
        F.lit(found.n).cast("long").alias("n"),
        F.col("_corpus_deviation").alias("deviation"),
        F.col("_corpus_one").alias("whitened"),
        F.get(shares, F.col("_corpus_at")).alias("explained"),
        F.lit(found.identity_error).alias("identity_error"),
    )
