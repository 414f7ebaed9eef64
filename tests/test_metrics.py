import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from longspark.operators import fit, metrics


@pytest.fixture(scope="module")
def scores():
    rng = np.random.default_rng(3)
    n = 400
    g = np.where(rng.random(n) < 0.6, "hot", "cold")
    p = np.round(rng.random(n), 2)
    return pd.DataFrame({"g": g, "y": (rng.random(n) < p).astype(int), "p": p})


def auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return np.mean((pos[:, None] > neg[None]) + 0.5 * (pos[:, None] == neg[None]))


@pytest.mark.parametrize("max_rows", [7, 1000])
def test_auc_counts_ties_half(spark, scores, max_rows):
    out = metrics.roc_auc(spark.createDataFrame(scores), ["g"], "y", F.col("p"), max_rows=max_rows)
    for r in out.collect():
        part = scores[scores.g == r.g]
        assert r.roc_auc == pytest.approx(auc(part.y.values, part.p.values))


def test_auc_is_null_for_one_class(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.7)], "y int, p double")
    assert metrics.roc_auc(df, [], "y", F.col("p")).first().roc_auc is None


def test_probabilities_and_scales_are_clipped(spark):
    df = spark.createDataFrame([(1.0, 0.0, 0.0, -100.0)], "y double, p double, m double, s double")
    row = df.agg(
        metrics.log_loss(F.col("y"), F.col("p")).alias("l"),
        metrics.gaussian_nll(F.col("y"), F.col("m"), F.col("s")).alias("n"),
    ).first()
    assert row.l == pytest.approx(-np.log(1e-7))
    assert row.n == pytest.approx(0.5 * np.exp(14) - 7 + 0.5 * np.log(2 * np.pi))


def test_event_metrics_match_numpy(spark, scores):
    df = spark.createDataFrame(scores).withColumn("valid", (F.col("p") < 0.9).cast("int"))
    part = scores[scores.p < 0.9]
    p, y = np.clip(part.p.values, 1e-7, 1 - 1e-7), part.y.values
    for rows in (7, 1000):
        row = metrics.event_metrics(df, [], label="y", probability="p", max_rows=rows).first()
        assert row.event_brier == pytest.approx(np.mean((p - y) ** 2))
        assert row.event_log_loss == pytest.approx(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))
        assert row.event_roc_auc == pytest.approx(auc(y, p))


def test_trees_beat_the_mean(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(-3, 3, size=400)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": np.sin(x)}))
    model = fit.fit_gbt(df, ["x"], "y", trees=20, depth=3)
    got = fit.predict_model(model, df, ["x"]).agg(metrics.mae(F.col("y"), F.col("prediction"))).first()[0]
    assert got < 0.1 < np.abs(np.sin(x) - np.sin(x).mean()).mean()


def test_logistic_needs_both_classes(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 1)], "x double, y int")
    with pytest.raises(ValueError, match="both 0 and 1"):
        fit.fit_logistic_balanced(df, ["x"], "y")


def test_interval_ends_are_inside(spark):
    df = spark.createDataFrame([(1.0, 1.0, 2.0), (2.0, 1.0, 2.0), (2.1, 1.0, 2.0)], "y double, lo double, hi double")
    assert df.agg(metrics.interval_coverage(F.col("y"), F.col("lo"), F.col("hi"))).first()[0] == pytest.approx(2 / 3)


def test_masked_mean_of_nothing_is_zero(spark):
    df = spark.createDataFrame([(5.0, 0)], "t double, m int")
    assert df.agg(metrics.masked_mean(F.col("t"), F.col("m"))).first()[0] == 0.0


def test_logit_term_is_stable(spark):
    df = spark.createDataFrame([(1.0, 800.0), (0.0, -800.0), (1.0, 0.0)], "y double, x double")
    got = [r[0] for r in df.select(metrics.logit_term(F.col("y"), F.col("x"))).collect()]
    assert got == pytest.approx([0.0, 0.0, np.log(2)])


@pytest.fixture(scope="module")
def states():
    rng = np.random.default_rng(5)
    z = rng.normal(size=(200, 3))
    turn = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    h = 2.0 * z @ turn + 1.0 + 0.1 * rng.normal(size=(200, 3))
    names = [f"z{i}" for i in range(3)] + [f"h{i}" for i in range(3)]
    return pd.DataFrame(np.hstack([z, h]), columns=names)


def test_alignment_matches_least_squares_and_svd(spark, states):
    z, h = states.values[:, :3], states.values[:, 3:]
    design = np.column_stack([h, np.ones(len(h))])
    rest = z - design @ np.linalg.lstsq(design, z, rcond=None)[0]
    r2 = 1 - (rest**2).sum() / ((z - z.mean(0)) ** 2).sum()
    a, b = z - z.mean(0), h - h.mean(0)
    s = np.linalg.svd((a / np.linalg.norm(a)).T @ (b / np.linalg.norm(b)), compute_uv=False).sum()
    df = spark.createDataFrame(states).withColumn("g", F.lit(1))
    row = metrics.latent_alignment(df, ["g"], ["z0", "z1", "z2"], ["h0", "h1", "h2"]).first()
    assert row.aligned_r2 == pytest.approx(r2) and row.procrustes == pytest.approx(1 - s**2)
    row = metrics.latent_alignment(df, ["g"], ["z0", "z1"], ["h0", "h1", "h2"]).first()
    assert row.procrustes is None and 0 < row.aligned_r2 <= 1


def test_ridge_matches_the_normal_equations(spark, states):
    x, y = states.values[:, :4], states.values[:, 5]
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + 1.0 * np.eye(4), xc.T @ yc)
    names = list(states.columns[:4])
    df = spark.createDataFrame(states)
    row = fit.fit_ridge(df, names, states.columns[5]).first()
    assert np.allclose(row.coefficients, w) and row.intercept == pytest.approx(y.mean() - x.mean(0) @ w)
    got = fit.predict_linear(df, fit.fit_ridge(df, names, states.columns[5]), names).toPandas()
    assert np.allclose(np.sort(got.prediction), np.sort(x @ w + row.intercept))


def test_wide_moments_equal_narrow_ones(spark, states, monkeypatch):
    df = spark.createDataFrame(states).withColumn("g", (F.col("z0") > 0).cast("int"))
    narrow = metrics.moments(df, ["g"], list(states.columns)).orderBy("g").collect()
    monkeypatch.setattr(metrics, "WIDE", 2)
    wide = metrics.moments(df, ["g"], list(states.columns)).orderBy("g").collect()
    for a, b in zip(narrow, wide, strict=True):
        assert a.n == b.n and np.allclose(a.means, b.means) and np.allclose(a.cross, b.cross)
    whole = metrics.moments(df, [], list(states.columns)).first()
    want = np.cov(states.values.T, ddof=0)[np.triu_indices(6)] * 200
    assert whole.n == 200 and np.allclose(whole.cross, want)


def test_ridge_per_group(spark, states):
    df = spark.createDataFrame(states).withColumn("g", (F.col("z0") > 0).cast("int"))
    fits = fit.fit_ridge(df, ["h0", "h1"], "z1", by=("g",))
    assert fits.count() == 2 and fits.agg(F.sum("n")).first()[0] == 200
    assert fit.predict_linear(df, fits, ["h0", "h1"], by=("g",)).count() == 200


def test_balanced_logistic_minimises_the_weighted_loss(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=300)
    y = (rng.random(300) < 1 / (1 + np.exp(-(2 * x - 2)))).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    model = fit.fit_logistic_balanced(df, ["x"], "y")
    w = np.where(y == 1, 300 / (2 * y.sum()), 300 / (2 * (1 - y).sum()))

    def loss(a, b):
        t = a * x + b
        return 0.5 * a * a + (w * (np.logaddexp(0, t) - y * t)).sum()

    a, b = model.coefficients[0], model.intercept
    best = loss(a, b)
    for da, db in ((1e-3, 0), (-1e-3, 0), (0, 1e-3), (0, -1e-3)):
        assert loss(a + da, b + db) >= best - 1e-6


@pytest.mark.parametrize("wide", [0, 8])
def test_moments_use_complete_rows_only(spark, monkeypatch, wide):
    monkeypatch.setattr(metrics, "WIDE", wide)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50, 3))
    rows = [[None if rng.random() < 0.2 and j == 1 else float(v) for j, v in enumerate(r)] for r in x]
    rows[0][2] = float("nan")
    out = metrics.moments(spark.createDataFrame(rows, "a double, b double, c double"), [], ["a", "b", "c"]).first()
    whole = np.array([r for r in rows if None not in r and r[2] == r[2]])
    centred = whole - whole.mean(0)
    assert out.n == len(whole) < 50
    np.testing.assert_allclose(out.means, whole.mean(0), atol=1e-12)
    np.testing.assert_allclose(metrics.unpack(np.array(out.cross), 3), centred.T @ centred, atol=1e-9)


def test_grouped_logistic_fits_equal_the_single_ones(spark):
    rng = np.random.default_rng(5)
    rows = []
    for g, n in (("a", 400), ("b", 60), ("c", 30)):
        for _ in range(n):
            u, v = rng.normal(), 20 * rng.normal() + 5
            rows.append((g, float(u), float(v), int(rng.random() < 1 / (1 + np.exp(1.5 - u - 0.05 * v)))))
    rows += [("apart", float(i), 0.0, int(i >= 10)) for i in range(20)]  # separable: the penalty keeps it finite
    rows += [("one", 1.0, 2.0, 1), ("one", 2.0, 1.0, 1)]
    noise = [("a", None, 1.0, 1), ("a", float("nan"), 1.0, 0), ("a", 1.0, float("inf"), 0), ("a", 1.0, 1.0, None), ("a", 1.0, 1.0, 7), (None, 1.0, 1.0, 1)]
    df = spark.createDataFrame(rows + noise, "g string, u double, v double, y int").repartition(3)
    fits = fit.fit_logistic_grouped(df, ["u", "v"], "y", by=["g"])
    got = {r.g: r for r in fits.collect()}
    assert set(got) == {"a", "b", "c", "apart", "one"}
    assert got["one"].coefficients is None and not got["one"].converged and got["one"].n == got["one"].n_positive == 2
    for g in ("a", "b", "c", "apart"):
        own = [(u, v, y) for k, u, v, y in rows if k == g]
        x = np.array([(1, u, v) for u, v, _ in own], float)
        y = np.array([r[2] for r in own], float)
        w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
        b = np.array(got[g].coefficients)
        slope = x.T @ (w * (1 / (1 + np.exp(-x @ b)) - y)) + np.r_[0, b[1:]]
        assert got[g].converged and got[g].n == len(y) and np.abs(slope).max() < 1e-6
    model = fit.fit_logistic_balanced(df.where("g = 'b'"), ["u", "v"], "y")
    assert np.allclose([model.intercept, *model.coefficients], got["b"].coefficients, atol=1e-3)
    out = fit.predict_logistic(df, fits, ["u", "v"], by=["g"]).collect()
    assert len(out) == len(rows) + len(noise)
    assert all((r.probability is None) == (r.u is None or r.g in (None, "one")) or np.isnan(r.probability) for r in out)
    assert fit.fit_logistic_grouped(df.limit(0), ["u", "v"], "y", by=["g"]).count() == 0
    with pytest.raises(ValueError, match="strength"):
        fit.fit_logistic_grouped(df, ["u"], "y", by=["g"], strength=0.0)


def test_grouped_logistic_fits_do_not_depend_on_the_join(spark, monkeypatch):
    rows = [(i % 7, float(i % 5), int(i * 7919 % 11 < 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "g int, u double, y int")
    near = {r.g: r.coefficients for r in fit.fit_logistic_grouped(df, ["u"], "y", by=["g"]).collect()}
    monkeypatch.setattr(fit, "MAX_BROADCAST_GROUPS", 2)
    far = {r.g: r.coefficients for r in fit.fit_logistic_grouped(df, ["u"], "y", by=["g"]).collect()}
    assert near.keys() == far.keys() and all(np.allclose(near[g], far[g], atol=1e-8) for g in near)
