import math

import numpy as np
import pytest

from longspark.llm import catalog, whitening

SCHEMA = "vec_id long, embedding array<float>, n string, component string, label int"


@pytest.mark.parametrize("width", [1, 2, 3, 8, 33])
def test_rank_one(width):
    rng = np.random.default_rng(width)
    whole, values, basis = np.zeros((width, width)), np.zeros(width), np.eye(width)
    for k in range(150):
        vector = rng.normal(size=width) * 10.0 ** rng.integers(-5, 4)
        if k % 5 == 0:
            vector = np.eye(width)[rng.integers(width)]
        if k % 11 == 0:
            vector = vector * 0
        weight = rng.random()
        whole += weight * np.outer(vector, vector)
        values, basis = whitening.rank_one(values, basis, vector, weight)
        assert np.allclose(basis.T @ basis, np.eye(width), atol=1e-12)
        assert np.allclose((basis * values) @ basis.T, whole, atol=1e-11 * max(np.abs(whole).max(), 1e-300))
    assert np.all(np.diff(values) >= 0)


def test_equal_eigenvalues():
    values, basis = whitening.rank_one(np.array([1.0, 1.0, 1.0, 2.0, 2.0]), np.eye(5), np.ones(5), 0.5)
    want = np.linalg.eigvalsh(np.diag([1.0, 1, 1, 2, 2]) + 0.5 * np.ones((5, 5)))
    assert np.allclose(values, want) and np.allclose(basis.T @ basis, np.eye(5))


def test_spectra_combine():
    rng = np.random.default_rng(1)
    rows = rng.integers(-500, 500, size=(120, 6)) + 1_000_000
    whole, parts = whitening.Spectrum.empty(6), []
    for block in np.array_split(rows, 5):
        one = whitening.Spectrum.empty(6)
        for x in block:
            one.add(x, rows[0])
        parts.append(one)
    for one in [*parts, whitening.Spectrum.empty(6)]:
        whole.join(one)
    centred = rows - rows.mean(0)
    assert whole.n == 120 and (whole.sums == rows.sum(0)).all()
    assert np.allclose((whole.basis * whole.values) @ whole.basis.T, centred.T @ centred, rtol=1e-10)


def plain(vectors, components=16):
    """(fit size, deviations, whitened up to sign, shares) by a dense eigenvalue solver."""
    x = np.floor(np.array(vectors, np.float32).astype(float) * 64).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    centred = (fit * n - sums) / n
    values, turn = np.linalg.eigh(centred.T @ centred / n)
    keep = np.argsort(values)[::-1][:components]
    whitened = ((x * n - sums) / n) @ turn[:, keep] / np.sqrt(values[keep])
    return n, [sum(int(v) ** 2 for v in row) for row in (x * n - sums)], whitened, values[keep] / values.sum()


def test_against_dense_solver(spark, monkeypatch):
    monkeypatch.setattr(whitening, "VECTORS", 20)  # several partitions and two levels
    monkeypatch.setattr(whitening, "SPECTRA", 3)
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(300, 20)) * np.linspace(0.3, 3, 20)).round(3).tolist() + [[0.25] * 20] * 150
    rows = [(i if i % 50 else None, v, "text", None, 1) for i, v in enumerate(vectors)]
    bad = [(900, None, "", "", 1), (901, [1.0] * 19 + [None], "", "", 1), (902, [math.nan] * 20, "", "", 1), (903, [math.inf] * 20, "", "", 1)]
    bad += [(904, [], "", "", 1), (905, [1.0, 2.0], "", "", 1)]
    df = spark.createDataFrame(rows + bad, SCHEMA).repartition(5)
    got = whitening.whiten(df)
    assert got.columns == ["vec_id", "label", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = got.collect()
    n, deviations, whitened, shares = plain(vectors)
    assert n == 301 and {r.n for r in got} == {301} and len(got) == 450 * 16
    assert all(r.identity_error < 1e-10 for r in got)
    by_id = {(r.vec_id, r.component): r for r in got if r.vec_id is not None}
    for i, (row, deviation) in enumerate(zip(whitened, deviations)):
        if i % 50:
            for k in range(16):
                r = by_id[i, k + 1]
                assert r.deviation == deviation and r.explained == pytest.approx(shares[k], rel=1e-9)
    for k in range(16):
        mine = np.array([by_id[i, k + 1].whitened for i in range(450) if i % 50])
        want = np.array([whitened[i, k] for i in range(450) if i % 50])
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-8


def test_few_or_equal_vectors(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    one = spark.createDataFrame([(i, [0.5, 1.0], "", "", 1) for i in range(9)], SCHEMA)
    assert whitening.whiten(one).count() == 0
    two = spark.createDataFrame([(1, [0.0, 1.0], "", "", 1), (2, [1.0, 1.0], "", "", 1), (2, [1.0, 1.0], "", "", 1)], SCHEMA)
    got = whitening.whiten(two).collect()
    assert sorted((r.vec_id, r.component, abs(r.whitened)) for r in got) == [(1, 1, 1.0), (2, 1, 1.0), (2, 1, 1.0)]
    huge = spark.createDataFrame([(1, [3.0e38, 1.0], "", "", 1), (2, [-3.0e38, 1.0], "", "", 1), (3, [0.0, 0.0], "", "", 1)], SCHEMA)
    # the second direction is nothing beside the first, to the precision of a double
    assert whitening.whiten(huge).count() == 3


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    n, deviations, whitened, shares = plain([r.embedding for r in rows])
    got = {(r.vec_id, r.component): r for r in catalog.QUERIES["op12_embedding_whitening"](spark, sf).collect()}
    assert len(got) == 16 * len(rows)
    signs = [np.sign(got[rows[0].vec_id, k + 1].whitened * whitened[0, k]) for k in range(16)]
    for r, row, deviation in zip(rows, whitened, deviations):
        for k in range(16):
            g = got[r.vec_id, k + 1]
            assert (g.n, g.deviation) == (n, deviation) and g.whitened * signs[k] == pytest.approx(row[k], abs=1e-8)
            assert g.explained == pytest.approx(shares[k], rel=1e-9) and g.identity_error < 1e-10
